"""Marts, read queries, dashboards and assertions over the warehouse."""
