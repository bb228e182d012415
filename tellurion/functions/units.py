"""Units of length, area and angle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in a unit of length, exact.
METRES = {
    "meters": 1.0, "kilometers": 1000.0, "centimeters": 0.01, "millimeters": 0.001, "miles": 1609.344,
    "nauticalmiles": 1852.0, "feet": 0.3048, "yards": 0.9144, "inches": 0.0254,
}
# The sphere and the rounded factors of the planar helper layer.
EARTH_RADIUS = 6371008.8
FACTORS = {
    "centimeters": EARTH_RADIUS * 100, "degrees": 360 / (2 * math.pi), "feet": EARTH_RADIUS * 3.28084, "inches": EARTH_RADIUS * 39.37,
    "kilometers": EARTH_RADIUS / 1000, "meters": EARTH_RADIUS, "miles": EARTH_RADIUS / 1609.344, "millimeters": EARTH_RADIUS * 1000,
    "nauticalmiles": EARTH_RADIUS / 1852, "radians": 1.0, "yards": EARTH_RADIUS / 0.9144,
}
AREA_FACTORS = {
    "acres": 0.000247105, "centimeters": 10000.0, "feet": 10.763910417, "hectares": 0.0001, "inches": 1550.003100006,
    "kilometers": 0.000001, "meters": 1.0, "miles": 3.86e-7, "nauticalmiles": 2.9155334959812285e-7, "millimeters": 1000000.0, "yards": 1.195990046,
}
SPELLINGS = {"metres": "meters", "kilometres": "kilometers", "centimetres": "centimeters", "millimetres": "millimeters", "metre": "meters", "meter": "meters", "kilometre": "kilometers", "kilometer": "kilometers", "m": "meters", "km": "kilometers"}


def unit(name: str, table: dict[str, float]) -> float:
    key = SPELLINGS.get(name.lower(), name.lower())
    if key not in table:
        raise ValueError(f"{name} is no unit here")
    return table[key]


def metres(units: str) -> float:
    """Metres in a unit of length; angular units are refused."""
    return unit(units, METRES)


def _not_negative(x: Column, what: str) -> Column:
    return F.when(x < 0, F.raise_error(F.lit(f"{what} must be a positive number")).cast("double")).otherwise(x)


def radians_to_length(x: Column, units: str = "kilometers") -> Column:
    return x * unit(units, FACTORS)


def length_to_radians(x: Column, units: str = "kilometers") -> Column:
    return x / unit(units, FACTORS)


def length_to_degrees(x: Column, units: str = "kilometers") -> Column:
    return radians_to_degrees(length_to_radians(x, units))


def radians_to_degrees(x: Column) -> Column:
    """Degrees in [0, 360) of the same sign."""
    return (x % (2 * math.pi)) * (180 / math.pi)


def degrees_to_radians(x: Column) -> Column:
    return (x % 360) * (math.pi / 180)


def bearing_to_azimuth(x: Column) -> Column:
    y = x % 360
    return F.when(y < 0, y + 360).otherwise(y)


def azimuth_to_bearing(x: Column) -> Column:
    y = x % 360
    return F.when(y > 180, y - 360).when(y < -180, y + 360).otherwise(y)


def convert_length(x: Column, source: str = "kilometers", target: str = "kilometers") -> Column:
    return radians_to_length(length_to_radians(_not_negative(x, "length"), source), target)


def convert_area(x: Column, source: str = "meters", target: str = "kilometers") -> Column:
    return _not_negative(x, "area") / unit(source, AREA_FACTORS) * unit(target, AREA_FACTORS)


def round_to(x: Column, precision: int = 0) -> Column:
    return F.round(x, precision)
