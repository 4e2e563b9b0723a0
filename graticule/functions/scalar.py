"""Column expressions used across the pipeline."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x):
    return F.col(x) if isinstance(x, str) else x


def lon_wrap(lon) -> Column:
    """Longitude 0..360 to -180..180."""
    return F.pmod(_col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def tile_name(lat, lon) -> Column:
    """Name of a one-degree tile, such as N05E007 or S12W120."""
    lat, lon = _col(lat), _col(lon)
    digits = lambda v, n: F.lpad(F.abs(v).cast("int").cast("string"), n, "0")
    return F.concat(
        F.when(lat >= 0, "N").otherwise("S"), digits(lat, 2),
        F.when(lon >= 0, "E").otherwise("W"), digits(lon, 3),
    )


def wind_speed(u, v) -> Column:
    u, v = _col(u), _col(v)
    return F.sqrt(u * u + v * v)


def wind_direction(u, v, calm=0.3) -> Column:
    """Direction the wind comes from in degrees; north is 360, calm is 0."""
    u, v = _col(u), _col(v)
    angle = F.degrees(F.atan2(u, v)) + F.lit(180.0)
    angle = F.when(angle <= 0, F.lit(360.0)).otherwise(angle)
    return F.when(wind_speed(u, v) < F.lit(calm), F.lit(0.0)).otherwise(angle)


def wind_cardinal(direction) -> Column:
    """0 north, 1 north-east ... 7 north-west; 8 when missing."""
    d = _col(direction)
    code = F.when((d <= 22.5) | (d > 337.5), 0)
    for i in range(1, 8):
        code = code.when((d > 45.0 * i - 22.5) & (d <= 45.0 * i + 22.5), i)
    return code.otherwise(8)


def kelvin_to_celsius(x) -> Column:
    return _col(x) - F.lit(273.15)


def m_to_mm(x) -> Column:
    return _col(x) * F.lit(1000.0)


def ms_to_kmh(x) -> Column:
    return _col(x) * F.lit(3.6)


def tenth(x) -> Column:
    return _col(x) / F.lit(10.0)


def saturation_pressure(kelvin) -> Column:
    """Saturation vapour pressure over water in Pa (Sonntag 1990)."""
    # Fixed values of the published formula.
    t = _col(kelvin)
    return 100.0 * F.exp(
        F.lit(-6096.9385) / t + F.lit(16.635794) + F.lit(-2.711193e-2) * t
        + F.lit(1.673952e-5) * t * t + F.lit(2.433502) * F.log(t)
    )


def rel_humidity(temperature, dewpoint) -> Column:
    """Relative humidity in % from temperature and dewpoint in K, kept in 0..100."""
    ratio = saturation_pressure(dewpoint) / saturation_pressure(temperature) * 100.0
    return F.least(F.greatest(ratio, F.lit(0.0)), F.lit(100.0))


def vei_radius(vei) -> Column:
    """Reach of an eruption in km by explosivity index; unknown: 0.01 km."""
    return F.coalesce(F.lit(3.0408) * F.exp(F.lit(0.6956) * _col(vei)), F.lit(0.01))


def haversine_km(lat1, lon1, lat2, lon2, radius=6371.0088) -> Column:
    """Great-circle distance in km."""
    a1, o1, a2, o2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def clipped_probability(p, eps=1e-7) -> Column:
    """Missing -> 0, then kept within [eps, 1 - eps]."""
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.coalesce(_col(p), F.lit(0.0))))


def degrees_to_radians(x) -> Column:
    return _col(x) * F.lit(math.pi / 180.0)
