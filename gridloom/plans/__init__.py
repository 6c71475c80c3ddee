"""The driver's queries; importing a module adds its own."""

from . import catalogue, feeders, files, measurements, served, studies  # noqa: F401
