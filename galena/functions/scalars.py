"""Scalar functions of the catalogue as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Latitude at which the square Mercator map ends.
MERCATOR_LAT = 85.05112878
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def suffix(name: Column) -> Column:
    """Lower-case last suffix with its dot; none for dot files, names that end in a dot, or no dot."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.*[^.](\.[^.]+)$|^[^.]+(\.[^.]+)$", 1))


def human_bytes(n: Column, base: int = 1024) -> Column:
    """'12 B', '1.5 KB' ...: one decimal above bytes."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = F.concat(F.format_string("%.1f", n / float(base ** (len(units) - 1))), F.lit(" " + units[-1]))
    for i in range(len(units) - 2, 0, -1):
        out = F.when(n < base ** (i + 1), F.concat(F.format_string("%.1f", n / float(base**i)), F.lit(" " + units[i]))).otherwise(out)
    return F.when(n < base, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def duration(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def ago(then: Column, now: Column) -> Column:
    """'just now', 'n min ago', 'n h ago', 'n d ago'."""
    gap = now - then
    part = lambda size, unit: F.concat(F.floor(gap / size).cast("long").cast("string"), F.lit(unit))
    return F.when(gap < 60, F.lit("just now")).when(gap < 3600, part(60, " min ago")).when(gap < 86400, part(3600, " h ago")).otherwise(part(86400, " d ago"))


def byte_range(header: Column, size: Column) -> Column:
    """struct<start, end, status>: HTTP Range `bytes=a-b`, `a-`, `-n` against a size; end is exclusive; 416 if it can't be met."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    ok = header.rlike(r"^bytes=\d*-\d*$") & ((a != "") | (b != ""))
    x, y = a.try_cast("long"), b.try_cast("long")
    start = F.when(a == "", F.greatest(F.lit(0), size - y)).otherwise(x)
    end = F.when((a == "") | (b == ""), size).otherwise(F.least(y + 1, size))
    good = ok & (start < size) & (start < end)
    return F.struct(F.when(good, start).alias("start"), F.when(good, end).alias("end"), F.when(header.isNull(), 200).when(good, 206).otherwise(416).alias("status"))


def iso6709(value: Column) -> Column:
    """struct<lat, lon> of '+27.5916+086.5640/'; null out of range or at (0, 0)."""
    pattern = r"^([+-]\d+\.?\d*)([+-]\d+\.?\d*)"
    lat, lon = (F.regexp_extract(value, pattern, i).try_cast("double") for i in (1, 2))
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))


def dms(parts: Column, ref: Column) -> Column:
    """Degrees from [d, m, s] (missing m or s: 0); S and W are negative."""
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))
    value = F.get(parts, F.lit(0)) + at(1) / 60 + at(2) / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def exif_time(value: Column, offset: Column) -> Column:
    """struct<ts: epoch seconds, has_tz>: 'YYYY:MM:DD HH:MM:SS' with an optional '+HH:MM'; a bad offset counts as UTC without zone."""
    stamp = F.try_to_timestamp(F.substring(F.trim(value), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))
    sign, hours, minutes = (F.regexp_extract(F.trim(offset), r"^([+-])(\d{2}):(\d{2})$", i) for i in (1, 2, 3))
    zoned = F.coalesce(sign != "", F.lit(False))
    shift = F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60)
    return F.struct((F.unix_timestamp(stamp) - F.when(zoned, shift).otherwise(0)).cast("double").alias("ts"), (zoned & stamp.isNotNull()).alias("has_tz"))


def quicktime_epoch(seconds: Column) -> Column:
    """Epoch seconds of a time counted from 1904."""
    return seconds - 2_082_844_800


def capture_time(exif: Column, has_tz: Column, client: Column, fallback: Column) -> Column:
    """Zoned EXIF, then the client's, then naive EXIF, then the fallback; 0 counts as absent."""
    some = lambda c: F.when(c != 0, c)
    return F.coalesce(F.when(has_tz, some(exif)), some(client), some(exif), fallback)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Place on the unit square."""
    top = 1 - 1e-12
    clamp = lambda c: F.least(F.lit(top), F.greatest(F.lit(0.0), c))
    s = F.sin(F.radians(F.least(F.lit(MERCATOR_LAT), F.greatest(F.lit(-MERCATOR_LAT), lat))))
    return clamp((lon + 180) / 360), clamp(F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * F.pi()))


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y)))), x * 360 - 180


def geohash(lat: Column, lon: Column, precision: int = 9) -> Column:
    """Base-32 geohash: bits of the longitude's and latitude's binary fractions, in turn, the longitude first."""
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.lit(2**n - 1), F.greatest(F.lit(0), F.floor((v - low) / span * float(2**n)))).cast("long")
    x, y = cell(lon, -180.0, 360.0, nlon), cell(lat, -90.0, 180.0, nlat)
    out = []
    for d in range(precision):
        digit = F.lit(0)
        for b in range(5):
            at = 5 * d + b  # bit of the interleaved word, from the left
            own, n, i = (x, nlon, at // 2) if at % 2 == 0 else (y, nlat, at // 2)
            digit = digit + F.shiftright(own, n - 1 - i).bitwiseAND(F.lit(1)) * (16 >> b)
        out.append(F.substring(F.lit(GEOHASH_DIGITS), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def geohash_box(code: Column, precision: int = 9) -> Column:
    """struct<south, north, west, east> of a geohash cell of so many digits."""
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for d in range(precision):
        digit = F.instr(F.lit(GEOHASH_DIGITS), F.substring(code, d + 1, 1)) - 1
        for b in range(5):
            bit = F.shiftright(digit, 4 - b).bitwiseAND(F.lit(1))
            if (5 * d + b) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    at = lambda v, low, span, n: F.lit(low) + v * F.lit(span / 2**n)
    return F.struct(at(y, -90.0, 180.0, nlat).alias("south"), at(y + 1, -90.0, 180.0, nlat).alias("north"), at(x, -180.0, 360.0, nlon).alias("west"), at(x + 1, -180.0, 360.0, nlon).alias("east"))


def cell_km(precision: int) -> tuple[float, float]:
    """Height of a geohash cell, and its width at the equator, in km."""
    bits = 5 * precision
    return 180 / 2 ** (bits // 2) * 111.32, 360 / 2 ** ((bits + 1) // 2) * 111.32


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def band(code: Column, i: int, width: int = 16) -> Column:
    """The i-th group of `width` bits, lowest first."""
    return F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def shard_size(length: Column, k: int, most: int | None = None) -> Column:
    """Bytes per shard: an equal share in whole 64-byte units, 64 at least."""
    size = F.when(length > 0, F.ceil(F.ceil(length / k) / 64) * 64).otherwise(64).cast("long")
    return size if most is None else F.least(size, F.lit(most)).cast("long")


def key_values(header: Column) -> Column:
    """map of 'key base64,key base64' with decoded values; a missing value is empty, a bad one null."""
    pairs = F.transform(F.split(header, ","), lambda p: F.split(F.trim(p), " ", 2))
    pairs = F.filter(pairs, lambda p: F.get(p, F.lit(0)) != "")
    decoded = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.when(F.size(p) > 1, F.try_to_binary(F.get(p, F.lit(1)), F.lit("base64")).cast("string")).otherwise("").alias("value")))
    return F.map_from_entries(decoded)
