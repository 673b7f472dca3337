"""Ingest: classification by leading bytes, container metadata, job states."""

from __future__ import annotations

import mimetypes
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions import scalars as S

#: Name suffixes of raw images, brands of the ISO base media container, first boxes of bare movies.
RAW_SUFFIXES = (".dng", ".cr2", ".cr3", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".raf", ".orf", ".rw2", ".pef", ".srw", ".x3f", ".3fr", ".iiq", ".erf", ".kdc", ".mrw")
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs")
AVIF_BRANDS = ("avif", "avis")
STILL_BRANDS = ("mif1", "msf1")
MP4_BRANDS = ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "M4V ", "M4VP", "dash", "MSNV", "XAVC", "mmp4")
GPP_BRANDS = ("3gp4", "3gp5", "3gp6", "3g2a", "3g2b")
MOVIE_SUFFIXES = (".mov", ".qt")
MOVIE_BOXES = ("moov", "mdat", "wide", "free", "skip")


def guessed_mime(name: Column) -> Column:
    """The type that a name's suffix stands for, null if none: the standard library's table, the inner name of compressed ones."""
    known = mimetypes.MimeTypes()
    table = F.create_map(*[F.lit(x) for pair in sorted(known.types_map[1].items()) for x in pair])
    packed = "|".join(sorted(re.escape(x) for x in known.encodings_map))
    return F.try_element_at(table, S.suffix(F.regexp_replace(name, f"(?i)({packed})$", "")))


def classify(name: Column, head: Column) -> Column:
    """struct<mime, kind, tier> from a name and leading bytes (64 at least, or all).

    Compressed pictures and films are media. Raw images, by suffix or by the brand crx, and all else aren't, whatever their
    bytes; those have the type that their name stands for.
    """
    latin = lambda start, size: F.decode(F.substring(head, start + 1, size), "ISO-8859-1")
    is_ = lambda start, raw: F.substring(head, start + 1, len(raw)) == F.lit(raw)
    out = lambda mime, kind, tier="media": F.struct((F.lit(mime) if isinstance(mime, str) else mime).alias("mime"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"))
    own, mime = S.suffix(name), guessed_mime(name)
    ends = F.least(F.conv(F.hex(F.substring(head, 1, 4)), 16, 10).cast("long"), F.octet_length(head).cast("long")) - 4
    further = F.when(ends >= 16, F.transform(F.sequence(F.lit(16).cast("long"), F.greatest(ends, F.lit(16)), F.lit(4).cast("long")), lambda i: F.decode(F.substring(head, (i + 1).cast("int"), F.lit(4)), "ISO-8859-1"))).otherwise(F.array().cast("array<string>"))
    major = latin(8, 4)
    has = lambda brands: F.arrays_overlap(F.array_append(further, major), F.array(*map(F.lit, brands)))
    ftyp = is_(4, b"ftyp")
    return (
        F.when(own.isin(*RAW_SUFFIXES), out(F.coalesce(mime, F.lit("image/x-raw")), "image", "nonmedia"))
        .when(is_(0, b"\xff\xd8\xff"), out("image/jpeg", "image"))
        .when(is_(0, b"\x89PNG\r\n\x1a\n"), out("image/png", "image"))
        .when(is_(0, b"GIF87a") | is_(0, b"GIF89a"), out("image/gif", "image"))
        .when(is_(0, b"RIFF") & is_(8, b"WEBP"), out("image/webp", "image"))
        .when(ftyp & (major == "crx "), out(F.coalesce(mime, F.lit("image/x-canon-cr3")), "other", "nonmedia"))
        .when(ftyp & major.isin(*AVIF_BRANDS, *STILL_BRANDS) & has(AVIF_BRANDS), out("image/avif", "image"))
        .when(ftyp & (major.isin(*HEIF_BRANDS) | major.isin(*STILL_BRANDS) & has(HEIF_BRANDS)), out("image/heic", "image"))
        .when(ftyp & major.isin(*STILL_BRANDS), out("image/heif", "image"))
        .when(ftyp & (major == "qt  "), out("video/quicktime", "video"))
        .when(ftyp & major.isin(*GPP_BRANDS), out("video/3gpp", "video"))
        .when(ftyp & has(MP4_BRANDS), out("video/mp4", "video"))
        .when(own.isin(*MOVIE_SUFFIXES) & latin(4, 4).isin(*MOVIE_BOXES), out("video/quicktime", "video"))
        .otherwise(out(F.coalesce(mime, F.lit("application/octet-stream")), "other", "nonmedia"))
    )


def ingest_batch(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """(id, outcome, sha256, size, mime, kind, tier, file_id, device_id) of uploads (id, filename, content binary, sha256 as
    declared, device_id).

    'known': a file (also a tombstone) has the declared hash already, so the device is linked to it and the content isn't
    read; 'corrupt': the content has another hash, or is missing; 'stored': a new file, classified by name and content;
    'linked': an upload whose hash is stored by one with a smaller id of the same batch. file_id is the known file's, or the
    id of the upload that stores. The texts of equal uploads never meet in one task: hashes and ids do.
    """
    u = uploads.withColumns({"sha256": F.lower("sha256"), "actual": F.sha2("content", 256)})
    known = files.select(F.lower("sha256").alias("sha256"), F.col("id").alias("known_id")).groupBy("sha256").agg(F.min("known_id").alias("known_id"))
    u = u.join(known, "sha256", "left")
    good = F.col("known_id").isNull() & (F.col("actual") == F.col("sha256"))
    first = u.where(good).groupBy("sha256").agg(F.min("id").alias("first_id"))
    u = u.join(first, "sha256", "left")
    outcome = F.when(F.col("known_id").isNotNull(), "known").when(F.col("actual").isNull() | (F.col("actual") != F.col("sha256")), "corrupt").when(F.col("id") == F.col("first_id"), "stored").otherwise("linked")
    u = u.withColumn("outcome", outcome).withColumn("c", F.when(F.col("outcome") == "stored", classify(F.coalesce("filename", "sha256"), F.substring("content", 1, 512))))
    to = F.when(F.col("outcome") != "corrupt", F.coalesce("known_id", "first_id"))
    return u.select("id", "outcome", "sha256", F.when(F.col("outcome") == "stored", F.octet_length("content").cast("long")).alias("size"), "c.mime", "c.kind", "c.tier", to.alias("file_id"), F.when(to.isNotNull(), F.col("device_id")).alias("device_id"))


# -- container metadata ------------------------------------------------------
def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end): 32- and 64-bit sizes, size 0 runs to the end; a size under its header, or past the end, stops."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8], 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def movie(data: bytes) -> dict:
    """created (epoch seconds), duration, width, height, lat, lon, model of the first moov box; empty for anything broken."""
    try:
        return _movie(data)
    except (struct.error, ValueError, IndexError, UnicodeDecodeError):
        return {}


def _movie(data: bytes) -> dict:
    out: dict = {}
    for kind, a, b in boxes(data):
        if kind != b"moov":
            continue
        keys: list[str] = []
        for k, x, y in boxes(data, a, b):
            if k == b"mvhd":
                long = data[x] == 1
                made, scale, length = struct.unpack_from(">Q8xIQ" if long else ">I4xII", data, x + 4)
                out["created"] = float(made - 2_082_844_800) if made else None
                out["duration"] = length / scale if scale else None
            elif k == b"trak":
                side, film = None, False
                for k2, x2, y2 in boxes(data, x, y):
                    if k2 == b"tkhd":
                        side = tuple(v >> 16 for v in struct.unpack_from(">II", data, y2 - 8))
                    elif k2 == b"mdia":
                        film = any(k3 == b"hdlr" and data[x3 + 8 : x3 + 12] == b"vide" for k3, x3, _ in boxes(data, x2, y2))
                if film and side and side[0] and "width" not in out:  # the first video track
                    out |= {"width": side[0], "height": side[1]}
            elif k == b"udta":
                for k2, x2, y2 in boxes(data, x, y):
                    if k2 == b"\xa9xyz":
                        out.setdefault("ISO6709", data[x2 + 4 : y2].decode("utf-8", "ignore"))
            elif k == b"meta":
                full = 4 if data[x : x + 4] == b"\0\0\0\0" else 0
                for k2, x2, y2 in boxes(data, x + full, y):
                    if k2 == b"keys":
                        keys, at = [], x2 + 8
                        for _ in range(struct.unpack_from(">I", data, x2 + 4)[0]):
                            n = struct.unpack_from(">I", data, at)[0]
                            keys.append(data[at + 8 : at + n].decode())
                            at += n
                    elif k2 == b"ilst":
                        for k3, x3, y3 in boxes(data, x2, y2):
                            i = struct.unpack(">I", k3)[0] - 1
                            for k4, x4, y4 in boxes(data, x3, y3):
                                if k4 == b"data" and 0 <= i < len(keys):
                                    out[keys[i].rpartition(".")[2]] = data[x4 + 8 : y4].decode()
        return out
    return out


def movie_metadata(content: Column) -> Column:
    """struct<created, duration, width, height, model, location, creationdate> of container bytes; nulls for broken ones."""
    kind = pa.struct([("created", pa.float64()), ("duration", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("model", pa.string()), ("location", pa.string()), ("creationdate", pa.string())])

    @F.arrow_udf("struct<created:double,duration:double,width:int,height:int,model:string,location:string,creationdate:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            found = [movie(x) if x else {} for x in array.to_pylist()]
            for f in found:
                f["location"] = f.pop("ISO6709", None) or f.get("location")
            yield pa.array([{n: f.get(n) for n in (c.name for c in kind)} for f in found], kind)

    return run(content)


def resolved_movie(meta: Column) -> Column:
    """created (the creation date with its zone before the header's time), place and model of movie_metadata()."""
    date = F.regexp_replace(F.col("creationdate") if meta is None else meta["creationdate"], r"([+-]\d\d):?(\d\d)$", "$1:$2")
    zoned = F.unix_timestamp(F.try_to_timestamp(date, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))).cast("double")
    place = S.iso6709(meta["location"])
    return F.struct(F.coalesce(zoned, meta["created"]).alias("created"), place["lat"].alias("lat"), place["lon"].alias("lon"), meta["model"].alias("model"))


# -- jobs --------------------------------------------------------------------
def job_outcome(attempts: Column, ok: Column, most: int = 5) -> Column:
    """State after an attempt: done, failed after the last attempt, else queued again."""
    return F.when(ok, "done").when(attempts >= most, "failed").otherwise("queued")


def queue_head(jobs: DataFrame, n: int) -> DataFrame:
    """The next n queued jobs; running ones count as queued after a restart."""
    return jobs.where(F.col("state").isin("queued", "running")).orderBy("id").limit(n)
