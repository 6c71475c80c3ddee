"""Solar geometry, irradiance limits and a photovoltaic model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
SOLAR_CONSTANT = 1361.0
TEMPERATURE_COEFFICIENT, LOSSES, NOMINAL_CELL_C = -0.0037, 0.14, 45.0


def day_angle(ts: Column) -> Column:
    days = F.when(F.dayofmonth(F.last_day(F.make_date(F.year(ts), F.lit(2), F.lit(1)))) == 29, 366.0).otherwise(365.0)
    return 2 * F.pi() * (F.dayofyear(ts) - 1) / days


def declination(angle: Column) -> Column:
    return (
        0.006918 - 0.399912 * F.cos(angle) + 0.070257 * F.sin(angle) - 0.006758 * F.cos(2 * angle)
        + 0.000907 * F.sin(2 * angle) - 0.002697 * F.cos(3 * angle) + 0.00148 * F.sin(3 * angle)
    )


def time_equation(angle: Column) -> Column:
    """Minutes between clock and sun."""
    return 229.18 * (0.000075 + 0.001868 * F.cos(angle) - 0.032077 * F.sin(angle) - 0.014615 * F.cos(2 * angle) - 0.040849 * F.sin(2 * angle))


def cos_zenith(ts: Column, latitude: float, longitude: float) -> Column:
    """``ts`` in UTC."""
    angle = day_angle(ts)
    minutes = F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0 + time_equation(angle) + 4.0 * longitude
    turn = F.radians(minutes / 4.0 - 180.0)
    lat = F.radians(F.lit(latitude))
    return F.sin(lat) * F.sin(declination(angle)) + F.cos(lat) * F.cos(declination(angle)) * F.cos(turn)


def extraterrestrial(ts: Column) -> Column:
    return SOLAR_CONSTANT * (1 + 0.033 * F.cos(day_angle(ts)))


def irradiance_limit(ts: Column, mu: Column, factor: float, offset: float) -> Column:
    """``factor * S0 * mu^1.2 + offset``: 1.5 and 100 bound the possible, 1.2 and 50 the rare."""
    return factor * extraterrestrial(ts) * F.pow(F.greatest(mu, F.lit(0.0)), F.lit(1.2)) + offset


def pv_per_unit(irradiance: Column, air_c: Column) -> Column:
    cell = air_c + (NOMINAL_CELL_C - 20.0) / 800.0 * irradiance
    made = irradiance / 1000.0 * (1 + TEMPERATURE_COEFFICIENT * (cell - 25.0)) * (1 - LOSSES)
    return F.least(F.greatest(made, F.lit(0.0)), F.lit(1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
