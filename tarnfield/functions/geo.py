"""Distances, slippy tiles and the local azimuthal-equidistant projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield import config
from tarnfield.operators.grid import GridSpec


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * config.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def tile_x(lon: Column, zoom: Column | int) -> Column:
    """Fractional slippy tile column."""
    return (lon + 180) / 360 * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)


def tile_y(lat: Column, zoom: Column | int) -> Column:
    """Fractional slippy tile row; latitudes stop at the mercator limit."""
    limit = config.MERCATOR_MAX_LAT
    phi = F.radians(F.greatest(F.lit(-limit), F.least(F.lit(limit), lat)))
    world = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * world


def tile_range(west: Column, south: Column, east: Column, north: Column, zoom: int) -> dict[str, Column]:
    """Tiles of a bounding box with one tile of margin, clamped to the world."""
    last = (1 << zoom) - 1
    floor = lambda c: F.floor(c).cast("int")
    return {
        "x0": F.greatest(F.lit(0), floor(tile_x(west, zoom)) - 1),
        "x1": F.least(F.lit(last), floor(tile_x(east, zoom)) + 1),
        "y0": F.greatest(F.lit(0), floor(tile_y(north, zoom)) - 1),
        "y1": F.least(F.lit(last), floor(tile_y(south, zoom)) + 1),
    }


def mercator_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    half = config.MERCATOR_HALF_WORLD_M
    limit = config.MERCATOR_MAX_LAT
    phi = F.radians(F.greatest(F.lit(-limit), F.least(F.lit(limit), lat)))
    return lon / 180 * half, F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi * half


# The local projection follows the ellipsoidal azimuthal-equidistant series of Snyder (1987),
# "Map projections: a working manual", good to well below a millimetre at the few-kilometre
# extents used here.
_E2 = config.WGS84_F * (2 - config.WGS84_F)


def _radius(sin_phi):
    """Prime-vertical radius of curvature."""
    return config.WGS84_A / F.sqrt(1 - _E2 * sin_phi * sin_phi)


def _steps(given: dict[str, Column], steps: list) -> dict[str, Column]:
    """The outcome of each step handed to the next as plain columns."""
    for step in steps:
        given = step(**given)
    return given


def _each(points: Column, steps: list) -> Column:
    """Steps on every struct of an array; an array between two steps, as nothing in a lambda is worked out only once."""

    def bound(step):
        names = step.__code__.co_varnames[: step.__code__.co_argcount]
        return lambda p: F.struct(*[v.alias(k) for k, v in step(**{n: p[n] for n in names}).items()])

    for step in steps:
        points = F.transform(points, bound(step))
    return points


def _local_steps(lon0: float | Column, lat0: float | Column) -> list:
    lon0, lat0 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lon0, lat0))
    phi1 = F.radians(lat0)
    sin1, cos1 = F.sin(phi1), F.cos(phi1)
    n1, ep = _radius(sin1), math.sqrt(_E2 / (1 - _E2))

    def seen(lon, lat):
        """Latitude seen from the centre's normal."""
        phi = F.radians(lat)
        n = _radius(F.sin(phi))
        psi = F.atan((1 - _E2) * F.tan(phi) + _E2 * n1 * sin1 / (n * F.cos(phi)))
        return {"dlam": F.radians(lon - lon0), "psi": psi}

    def arc(dlam, psi):
        """Haversine form of the arc keeps full precision close to the centre."""
        az = F.atan2(F.sin(dlam), cos1 * F.tan(psi) - sin1 * F.cos(dlam))
        half = F.sin((psi - phi1) / 2) * F.sin((psi - phi1) / 2) + cos1 * F.cos(psi) * F.sin(dlam / 2) * F.sin(dlam / 2)
        return {"az": az, "s": 2 * F.asin(F.sqrt(F.least(F.lit(1.0), half)))}

    def bent(az, s):
        return {"az": az, "s": s, "h": ep * cos1 * F.cos(az)}

    def reach(az, s, h):
        g, h2 = ep * sin1, h * h
        series = 1 - s * s * h2 * (1 - h2) / 6 + F.pow(s, F.lit(3)) / 8 * g * h * (1 - 2 * h2)
        series = series + F.pow(s, F.lit(4)) / 120 * (h2 * (4 - 7 * h2) - 3 * g * g * (1 - 7 * h2))
        series = series - F.pow(s, F.lit(5)) / 48 * g * h
        return {"az": az, "c": n1 * s * series}

    def placed(az, c):
        return {"x": c * F.sin(az), "y": c * F.cos(az)}

    return [seen, arc, bent, reach, placed]


def to_local(lon: Column, lat: Column, lon0: float | Column, lat0: float | Column) -> tuple[Column, Column]:
    """Longitude / latitude to metres east and north of the centre."""
    found = _steps({"lon": lon, "lat": lat}, _local_steps(lon0, lat0))
    return found["x"], found["y"]


def _lonlat_steps(lon0: float | Column, lat0: float | Column) -> list:
    lon0, lat0 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lon0, lat0))
    phi1 = F.radians(lat0)
    sin1, cos1 = F.sin(phi1), F.cos(phi1)
    n1 = _radius(sin1)

    def polar(x, y):
        az = F.atan2(x, y)
        return {"az": az, "cos_az": F.cos(az), "d": F.sqrt(x * x + y * y) / n1}

    def bent(az, cos_az, d):
        a = -_E2 * cos1 * cos1 * cos_az * cos_az / (1 - _E2)
        return {"az": az, "cos_az": cos_az, "d": d, "a": a, "b": 3 * _E2 * (1 - a) * sin1 * cos1 * cos_az / (1 - _E2)}

    def arc(az, cos_az, d, a, b):
        e = d - a * (1 + a) * F.pow(d, F.lit(3)) / 6 - b * (1 + 3 * a) * F.pow(d, F.lit(4)) / 24
        return {"az": az, "cos_az": cos_az, "e": e, "a": a, "b": b}

    def seen(az, cos_az, e, a, b):
        psi = F.asin(sin1 * F.cos(e) + cos1 * F.sin(e) * cos_az)
        return {"az": az, "e": e, "f": 1 - a * e * e / 2 - b * F.pow(e, F.lit(3)) / 6, "psi": psi}

    def placed(az, e, f, psi):
        lam = lon0 + F.degrees(F.asin(F.sin(az) * F.sin(e) / F.cos(psi)))
        # The ratio keeps its meaning near the equator, where both sines vanish.
        lat = F.degrees(F.atan(F.tan(psi) * (1 - _E2 * f * sin1 / F.sin(psi)) / (1 - _E2)))
        near_equator = F.abs(F.sin(psi)) < 1e-12
        return {"lon": lam, "lat": F.when(near_equator, F.degrees(psi)).otherwise(lat)}

    return [polar, bent, arc, seen, placed]


def to_lonlat(x: Column, y: Column, lon0: float | Column, lat0: float | Column) -> tuple[Column, Column]:
    """Metres east and north of the centre to longitude / latitude."""
    found = _steps({"x": x, "y": y}, _lonlat_steps(lon0, lat0))
    return found["lon"], found["lat"]


def project_points(points: Column, lon0: float | Column, lat0: float | Column) -> Column:
    """Array of (lon, lat) structs to local (x, y) structs; one expression however long the array."""
    return _each(points, _local_steps(lon0, lat0))


def unproject_points(points: Column, lon0: float | Column, lat0: float | Column) -> Column:
    """Array of local (x, y) structs to (lon, lat) structs."""
    return _each(points, _lonlat_steps(lon0, lat0))


def _ends(points: Column, field: str) -> tuple[Column, Column]:
    values = F.transform(points, lambda p: p[field])
    return F.array_min(values), F.array_max(values)


def area_bounds(areas: DataFrame, margin_m: float = 0.0) -> DataFrame:
    """Longitude / latitude box of local rectangles (lon0, lat0, width_m, height_m) from their corners."""
    xs, ys = F.col("width_m") / 2 + margin_m, F.col("height_m") / 2 + margin_m
    corners = F.array(
        *[F.struct((sx * xs).alias("x"), (sy * ys).alias("y")) for sx in (-1, 1) for sy in (-1, 1)]
    )
    placed = areas.withColumn("_c", unproject_points(corners, F.col("lon0"), F.col("lat0")))
    (west, east), (south, north) = _ends(F.col("_c"), "lon"), _ends(F.col("_c"), "lat")
    return placed.withColumns({"west": west, "south": south, "east": east, "north": north}).drop("_c")


def viewport_cells(views: DataFrame, grid: GridSpec) -> DataFrame:
    """Half-open row and column box of viewports (west, south, east, north).

    Four projected corners, then floor / ceil and a clamp to the grid.
    """
    corners = F.array(
        *[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x in ("west", "east") for y in ("south", "north")]
    )
    placed = views.withColumn("_c", project_points(corners, grid.lon0, grid.lat0))
    (x0, x1), (y0, y1) = _ends(F.col("_c"), "x"), _ends(F.col("_c"), "y")

    def clamp(value: Column, limit: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(limit), value.cast("int")))

    half_w, half_h = grid.width_m / 2, grid.height_m / 2
    return placed.withColumns(
        {
            "row0": clamp(F.floor((y0 + half_h) / grid.dy), grid.height),
            "row1": clamp(F.ceil((y1 + half_h) / grid.dy), grid.height),
            "col0": clamp(F.floor((x0 + half_w) / grid.dx), grid.width),
            "col1": clamp(F.ceil((x1 + half_w) / grid.dx), grid.width),
        }
    ).drop("_c")
