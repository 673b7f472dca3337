"""Erasure-coded stripes: placement, shard files, encode, degraded reads, verification, repair, index recovery."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions import kernels as K
from galena.functions import scalars as S

HEADER = 256
_MAGIC = b"GLNASHRD"
_FIELDS = struct.Struct("<8sI32sIIIQQQ32s")


def placement(stripes: DataFrame, disks: DataFrame, n: int) -> DataFrame:
    """(stripe_id, idx, disk_id): the n freest writable disks by id, rotated by the stripe's leading hex digits; null where disks lack."""
    w = Window.partitionBy(F.lit(0))
    chosen = disks.where(F.col("status").isin("online", "rebuilding")).withColumn("r", F.row_number().over(w.orderBy(F.desc("free_bytes"), "id"))).where(F.col("r") <= n)
    ordered = chosen.agg(F.array_sort(F.collect_list("id")).alias("ids"))  # n ids at most
    turn = F.conv(F.substring("stripe_id", 1, 8), 16, 10).cast("long") % n
    rows = stripes.select("stripe_id", turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    return rows.join(F.broadcast(ordered)).select("stripe_id", "idx", F.get("ids", ((F.col("idx") + F.col("turn")) % n).cast("int")).alias("disk_id"))


def encode(stripes: DataFrame, content: str = "content") -> DataFrame:
    """(object_id, seq, idx, payload, checksum): shards of stripe rows (object_id, seq, k, m, shard_size, content binary)."""
    kinds = pa.schema([("object_id", pa.int64()), ("seq", pa.int32()), ("idx", pa.int32()), ("payload", pa.binary()), ("checksum", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for o, s, k, m, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(o, s, i, p, K.blake(p)) for i, p in enumerate(K.encode_stripe(data or b"", k, m, size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], schema=kinds)

    return stripes.select("object_id", "seq", "k", "m", "shard_size", content).mapInArrow(run, "object_id long, seq int, idx int, payload binary, checksum binary")


def decode(shards: DataFrame, stripes: DataFrame) -> DataFrame:
    """(object_id, seq, data_offset, data, lost): each stripe's bytes from its readable shards (a stripe's shards are k + m rows at most); null if too few."""
    held = shards.groupBy("object_id", "seq").agg(F.collect_list(F.struct("idx", "payload")).alias("s"))
    j = stripes.join(held, ["object_id", "seq"], "left").select("object_id", "seq", "data_offset", "k", "m", "data_len", "s")
    kinds = pa.schema([("object_id", pa.int64()), ("seq", pa.int32()), ("data_offset", pa.int64()), ("data", pa.binary()), ("lost", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for o, q, at, k, m, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {x["idx"]: x["payload"] for x in s or []}
                rows.append((o, q, at, K.decode_stripe(own, k, m, n), k + m - len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], schema=kinds)

    return j.mapInArrow(run, "object_id long, seq int, data_offset long, data binary, lost int")


def object_bytes(decoded: DataFrame) -> DataFrame:
    """(object_id, content): null if a stripe is lost."""
    whole = F.expr("listagg(data) WITHIN GROUP (ORDER BY data_offset)")
    return decoded.groupBy("object_id").agg(F.when(F.bool_and(F.col("data").isNotNull()), whole).alias("content"))


def repair(shards: DataFrame, stripes: DataFrame, states: DataFrame) -> DataFrame:
    """(object_id, seq, idx, payload, checksum): the shards that are not ok, computed again from the others; lost stripes give none."""
    good = shards.join(states.where("state = 'ok'"), ["object_id", "seq", "idx"], "left_semi")
    data = decode(good, stripes).where("data IS NOT NULL").select("object_id", "seq", F.col("data").alias("content"))
    bad = states.where("state <> 'ok'").select("object_id", "seq", "idx")
    broken = stripes.select("object_id", "seq", "k", "m", "shard_size").join(bad.select("object_id", "seq").distinct(), ["object_id", "seq"], "left_semi").join(data, ["object_id", "seq"])
    return encode(broken).join(bad, ["object_id", "seq", "idx"], "left_semi")


def rebuild(shards: DataFrame, stripes: DataFrame, moves: DataFrame, disks: DataFrame) -> DataFrame:
    """(object_id, seq, idx, disk_id, payload, checksum): the shards of `moves` (object_id, seq, idx, disk_id) computed from
    the stripes' other shards, with their new disks. Shards that no disk can take, and those of stripes with too few others, are absent."""
    able = moves.where("disk_id IS NOT NULL").join(disks.where(F.col("status").isin("online", "rebuilding")).select(F.col("id").alias("disk_id")), "disk_id", "left_semi")
    place = ["object_id", "seq", "idx"]
    left = shards.join(moves.select(*place), place, "left_anti")
    own = able.select("object_id", "seq").distinct()
    data = decode(left.join(own, ["object_id", "seq"], "left_semi"), stripes.join(own, ["object_id", "seq"], "left_semi")).where("data IS NOT NULL")
    content = data.select("object_id", "seq", F.col("data").alias("content")).join(stripes.select("object_id", "seq", "k", "m", "shard_size"), ["object_id", "seq"])
    return encode(content).join(able.select(*place, "disk_id"), place).select(*place, "disk_id", "payload", "checksum")


def restripe(shards: DataFrame, stripes: DataFrame, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(stripes, shards) of the objects whose profile isn't (k, m), read and coded again stripe by stripe with it; offsets and
    lengths stay. Stripes that can't be read are absent."""
    old = stripes.where((F.col("k") != k) | (F.col("m") != m))
    data = decode(shards.join(old.select("object_id", "seq"), ["object_id", "seq"], "left_semi"), old).where("data IS NOT NULL")
    new = data.select("object_id", "seq", F.lit(k).alias("k"), F.lit(m).alias("m"), S.shard_size(F.octet_length("data").cast("long"), k).alias("shard_size"), "data_offset", F.octet_length("data").cast("long").alias("data_len"), F.col("data").alias("content"))
    return new.drop("content"), encode(new)


def scrub_pass(stripes: DataFrame, states: DataFrame, most: int, before: float) -> DataFrame:
    """(object_id, seq, bad, outcome) of the stripes that a pass takes: those with known bad shards first, then those never or
    longest not scrubbed, if that is before `before`; `most` at most. outcome: ok, repaired or lost."""
    bad = states.groupBy("object_id", "seq").agg(F.count_if(F.col("state") != "ok").alias("bad"), F.count_if(F.col("state") == "ok").alias("good"))
    s = stripes.select("object_id", "seq", "k", F.coalesce("last_scrubbed_at", F.lit(0.0)).alias("at")).join(bad, ["object_id", "seq"])
    due = s.where((F.col("bad") > 0) | (F.col("at") < before)).orderBy((F.col("bad") > 0).desc(), "at", "object_id", "seq").limit(most)
    return due.select("object_id", "seq", "bad", F.when(F.col("bad") == 0, "ok").when(F.col("good") >= F.col("k"), "repaired").otherwise("lost").alias("outcome"))


# -- shard files -------------------------------------------------------------
def pack_header(stripe: str, idx: int, k: int, m: int, size: int, offset: int, length: int, checksum: bytes) -> bytes:
    body = _FIELDS.pack(_MAGIC, 1, stripe.encode()[:32].ljust(32, b"\0"), idx, k, m, size, offset, length, checksum).ljust(HEADER - 4, b"\0")
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_header(raw: bytes) -> dict | None:
    """The fields of a shard header, or none if its magic or checksum doesn't hold."""
    if len(raw) < HEADER or raw[:8] != _MAGIC or struct.unpack_from("<I", raw, HEADER - 4)[0] != zlib.crc32(raw[: HEADER - 4]):
        return None
    _, _, stripe, idx, k, m, size, offset, length, checksum = _FIELDS.unpack_from(raw)
    return {"stripe_id": stripe.rstrip(b"\0").decode(), "idx": idx, "k": k, "m": m, "shard_size": size, "data_offset": offset, "data_len": length, "checksum": checksum}


def shard_files(stripe: Column, idx: Column, k: Column, m: Column, size: Column, offset: Column, length: Column, checksum: Column, payload: Column) -> Column:
    """The bytes of each shard's file: header and payload."""

    @F.arrow_udf("binary")
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([pack_header(*r[:-1]) + r[-1] for r in rows], pa.binary())

    return run(stripe, idx, k, m, size, offset, length, checksum, payload)


def headers(content: Column) -> Column:
    """Header struct of shard-file bytes; null for a bad one."""

    @F.arrow_udf("struct<stripe_id:string,idx:int,k:int,m:int,shard_size:long,data_offset:long,data_len:long,checksum:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("stripe_id", pa.string()), ("idx", pa.int32()), ("k", pa.int32()), ("m", pa.int32()), ("shard_size", pa.int64()), ("data_offset", pa.int64()), ("data_len", pa.int64()), ("checksum", pa.binary())])
        for array in batches:
            yield pa.array([unpack_header(x or b"") for x in array.to_pylist()], kind)

    return run(content)


def verify(content: Column, stripe: Column, idx: Column, checksum: Column) -> Column:
    """'ok', 'missing' (no bytes) or 'corrupt' (header, identity, length or checksum) of a shard file."""

    @F.arrow_udf("string")
    def run(c: pa.Array, s: pa.Array, i: pa.Array, d: pa.Array) -> pa.Array:
        out = []
        for raw, own, at, want in zip(c.to_pylist(), s.to_pylist(), i.to_pylist(), d.to_pylist(), strict=True):
            if raw is None:
                out.append("missing")
                continue
            h = unpack_header(raw)
            body = raw[HEADER:]
            good = h and h["stripe_id"] == own and h["idx"] == at and len(body) == h["shard_size"] and K.blake(body) == h["checksum"] and (want is None or want == h["checksum"])
            out.append("ok" if good else "corrupt")
        return pa.array(out, pa.string())

    return run(content, stripe, idx, checksum)


def scan_shards(spark, glob: str) -> DataFrame:
    """(path, disk, header) of shard files below a folder: Spark's binary source, bad headers as null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.shd").load(glob)
    return files.select("path", headers(F.substring("content", 1, HEADER)).alias("header"))


def recover_index(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables from shard headers (stripe_id, object_id, seq, idx, k, m, shard_size, data_offset, data_len, disk_id): (objects, shards).

    Per stripe and index the copy on the smallest disk id counts; absent indexes are missing on no disk; stripes that are
    known already are left out. An object's size is the largest end of its stripes.
    """
    new = found.join(known, "stripe_id", "left_anti")
    best = new.groupBy("stripe_id", "idx").agg(F.min("disk_id").alias("disk_id"))
    stripe = new.groupBy("stripe_id").agg(*[F.min_by(c, F.struct("disk_id", "idx")).alias(c) for c in ("object_id", "seq", "k", "m", "data_offset", "data_len")])
    grid = stripe.select("stripe_id", "object_id", "seq", F.explode(F.sequence(F.lit(0), F.col("k") + F.col("m") - 1)).alias("idx"))
    shards = grid.join(best, ["stripe_id", "idx"], "left").select("stripe_id", "object_id", "seq", "idx", "disk_id", F.when(F.col("disk_id").isNull(), "missing").otherwise("ok").alias("state"))
    objects = stripe.groupBy("object_id").agg(F.max(F.col("data_offset") + F.col("data_len")).alias("size"), F.count("*").alias("stripes"))
    return objects, shards
