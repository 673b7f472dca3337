"""Spatial operators: radius search and join by geohash cells, map clusters, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions import scalars as S


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive box; one whose west exceeds its east crosses the antimeridian."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def covering_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """A box that holds the whole circle, also near the poles (then all longitudes) and across the antimeridian."""
    reach = math.degrees(km / S.EARTH_KM) * (1 + 1e-9)
    south, north = max(-90.0, lat - reach), min(90.0, lat + reach)
    if lat - reach <= -90 or lat + reach >= 90:
        return south, -180.0, north, 180.0
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat)))))
    west, east = lon - wide, lon + wide
    if wide >= 180:
        return south, -180.0, north, 180.0
    return south, (west + 540) % 360 - 180, north, (east + 540) % 360 - 180


def covering_precision(lat: float, km: float) -> int:
    """The finest number of geohash digits whose cells at this latitude are no smaller than the radius either way; 1 at least."""
    for digits in range(9, 1, -1):
        high, wide = S.cell_km(digits)
        if min(high, wide * max(0.01, math.cos(math.radians(lat)))) >= km:
            return digits
    return 1


def in_covering(lat_column: Column, lon_column: Column, lat: float, lon: float, km: float) -> Column:
    """Whether a place lies in the geohash cell of (lat, lon) or one of the eight around it, of covering_precision() digits.

    By numbers of cells, so that it needs no list of prefixes; columns go on across the antimeridian, rows end at the poles.
    Cells that hold a stored geohash prefix are the same ones.
    """
    bits = 5 * covering_precision(lat, km)
    columns, rows = 2 ** ((bits + 1) // 2), 2 ** (bits // 2)
    x, y = min(columns - 1, int((lon + 180) / 360 * columns)), min(rows - 1, int((lat + 90) / 180 * rows))
    at = lambda c, low, span, n: F.least(F.lit(n - 1), F.floor((c - low) / span * n))
    apart = F.abs(at(lon_column, -180.0, 360.0, columns) - x)
    return (F.least(apart, F.lit(columns) - apart) <= 1) & (F.abs(at(lat_column, -90.0, 180.0, rows) - y) <= 1)


def near(df: DataFrame, lat: float, lon: float, km: float, limit: int | None = None, prelimit: int | None = None, order: tuple[str, str] = ("ts", "id")) -> DataFrame:
    """Rows within km of a place, newest first: a box that pushes down, then the exact distance, then the limit.

    prelimit cuts the box's rows before the exact check, as the catalogue's own search does.
    """
    rows = df.where(in_box(F.col("lat"), F.col("lon"), *covering_box(lat, lon, km)))
    by = [F.desc(order[0]), F.desc(order[1])]
    if prelimit is not None:
        rows = rows.orderBy(*by).limit(prelimit)
    rows = rows.withColumn("km", S.haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).where(F.col("km") <= km)
    return rows.orderBy(*by).limit(limit) if limit is not None else rows


def radius_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """(id, other, km) of all pairs id < other within km: rows meet in cells of a grid of latitude bands, then the exact distance.

    Bands are km high; within a band the columns are so wide that a circle reaches the next column at most. A row of the
    right side goes to its own cell and the eight around it; towards the poles a band has fewer columns.
    """
    step = math.degrees(km / S.EARTH_KM) * (1 + 1e-9)
    bands = math.ceil(180 / step)

    def columns(band: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)) + step)
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(step))) / F.greatest(F.lit(1e-9), F.cos(F.radians(edge))))))
        return F.when(edge >= 90 - step, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / wide))).cast("int")

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("int"), n)

    own = F.least(F.lit(bands - 1), F.floor((F.col("lat") + 90) / step)).cast("int")
    l_rows = left.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("b", own)
    l_rows = l_rows.select(F.col("id"), "lat", "lon", "b", cell(F.col("lon"), columns(F.col("b"))).alias("c"))
    around = F.array(*[F.col("b") + i for i in (-1, 0, 1)])
    r = right.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("b", own).select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(around).alias("b")).where(F.col("b").between(0, bands - 1))
    n = columns(F.col("b"))
    r = r.withColumn("n", n).withColumn("at", cell(F.col("lon2"), F.col("n")))
    sides = F.array_distinct(F.array(*[F.pmod(F.col("at") + i, F.col("n")) for i in (-1, 0, 1)]))
    r = r.select("other", "lat2", "lon2", "b", F.explode(sides).alias("c"))
    j = l_rows.join(r, ["b", "c"]).where("id < other")
    return j.select("id", "other", S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")).where(F.col("km") <= km)


def clusters(df: DataFrame, zoom: int, box: tuple[float, float, float, float], edge: str = "cell", key: str = "ts", own: str = "id") -> DataFrame:
    """(cx, cy, n, x, y, lat, lon, file_id): points per map cell of depth zoom + 2 (24 at most) that the box shows.

    edge='cell' keeps cells that touch the box with all their points, edge='point' counts only points within. The
    representative has the largest key, ties to the larger id. A box across the antimeridian counts each cell once.
    """
    depth = min(max(zoom, 0) + 2, 24)
    south, west, north, east = box
    x, y = S.mercator(F.col("lat"), F.col("lon"))
    rows = df.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"mx": x, "my": y})
    rows = rows.withColumns({"cx": F.floor(F.col("mx") * 2**depth).cast("long"), "cy": F.floor(F.col("my") * 2**depth).cast("long")})
    if edge == "point":
        rows = rows.where(in_box(F.col("lat"), F.col("lon"), south, west, north, east))
    else:
        side = lambda v: S.mercator(F.lit(0.0), F.lit(v))[0]
        deep = lambda v: S.mercator(F.lit(v), F.lit(0.0))[1]
        at = lambda c: F.floor(c * 2**depth)
        low, high = at(side(west)), at(side(east))
        across = F.col("cx").between(low, high) if west <= east else (F.col("cx") >= low) | (F.col("cx") <= high)
        rows = rows.where(across & F.col("cy").between(at(deep(north)), at(deep(south))))
    out = rows.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg("mx").alias("x"), F.avg("my").alias("y"), F.max_by(own, F.struct(key, own)).alias("file_id"))
    lat, lon = S.unmercator(F.col("x"), F.col("y"))
    return out.withColumns({"lat": lat, "lon": lon})
