"""Chunk deduplication: cuts, first occurrences, batch layout, references, reads, Bloom membership."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions import kernels as K


def chunk(df: DataFrame, key: str, content: str, low: int = 16 << 10, bits: int = 16, high: int = 256 << 10) -> DataFrame:
    """(file_id, seq, offset, size, hash, data): content-defined chunks of binary or text values; hash is BLAKE2b-256."""
    kinds = pa.schema([("file_id", pa.int64()), ("seq", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("hash", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for key_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = 0
                for seq, end in enumerate(K.cuts(data or b"", low, bits, high)):
                    piece = data[start:end]
                    for c, x in zip(cols, (key_, seq, start, end - start, K.blake(piece), piece), strict=True):
                        c.append(x)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return df.select(F.col(key).cast("long"), F.col(content).cast("binary")).mapInArrow(run, "file_id long, seq int, offset long, size long, hash binary, data binary")


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """(hash, size, file_id, seq, refcount) of each distinct chunk: where it occurs first, and how often it occurs at all."""
    at = F.min(F.struct("file_id", "seq"))
    g = chunks.groupBy("hash").agg(F.first("size").alias("size"), at.alias("at"), F.count("*").alias("refcount"))
    return g.select("hash", "size", "at.file_id", "at.seq", "refcount")


def stats(chunks: DataFrame) -> DataFrame:
    """One row: logical and unique bytes, their ratio (null for none), chunks, distinct chunks, average size of distinct ones."""
    per = chunks.groupBy("hash").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    logical, unique = F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))
    return per.agg(logical.alias("logical_bytes"), unique.alias("unique_bytes"), F.try_divide(logical, unique).alias("ratio"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("distinct_chunks"), F.avg("size").alias("avg_size"))


def layout(distinct: DataFrame, files_per_batch: int) -> DataFrame:
    """(batch_id, hash, size, raw_offset): new chunks appended to the batch of their file in (file, seq) order."""
    batch = F.floor(F.col("file_id") / files_per_batch).cast("long")
    w = Window.partitionBy("batch_id").orderBy("file_id", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return distinct.withColumn("batch_id", batch).select("batch_id", "hash", "size", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("raw_offset"), "refcount")


def batches(placed: DataFrame, live: DataFrame) -> DataFrame:
    """(batch_id, raw_bytes, live_bytes): live bytes are those of chunks that a live file refers to."""
    alive = live.select("hash").distinct().withColumn("_l", F.lit(True))
    j = placed.join(alive, "hash", "left")
    return j.groupBy("batch_id").agg(F.sum("size").alias("raw_bytes"), F.coalesce(F.sum(F.when(F.col("_l"), F.col("size"))), F.lit(0)).alias("live_bytes"))


def compaction_victims(b: DataFrame, below: float = 0.5) -> DataFrame:
    return b.where((F.col("raw_bytes") > 0) & (F.col("live_bytes") / F.col("raw_bytes") < below))


def seal_due(now: Column, most_bytes: int = 1 << 30, most_age: float = 6 * 3600) -> Column:
    """Whether an open batch is large or old enough; a batch without data has no age."""
    age = F.when(F.coalesce(F.col("first_data_at"), F.lit(0)) != 0, now - F.col("first_data_at"))
    return (F.col("state") == "open") & ((F.col("raw_bytes") >= most_bytes) | F.coalesce(age >= most_age, F.lit(False)))


def frames(placed: DataFrame, most: int, order: list[str]) -> DataFrame:
    """(batch_id, idx, raw_start, raw_len, chunks): chunks are packed in order, a frame ends with the chunk that fills it.

    The fold restarts at each frame, so it isn't a division of running sums; a batch is bounded by its sealing size and
    is folded by one task.
    """
    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        sizes = table["size"].to_pylist()
        rows, start, held, n = [], 0, 0, 0
        for s in sizes:
            held, n = held + s, n + 1
            if held >= most:
                rows.append((start, held, n))
                start, held, n = start + held, 0, 0
        if n:
            rows.append((start, held, n))
        key = table["batch_id"][0].as_py() if len(table) else None
        return pa.table({"batch_id": pa.array([key] * len(rows), pa.int64()), "idx": pa.array(range(len(rows)), pa.int32()), "raw_start": pa.array([r[0] for r in rows], pa.int64()), "raw_len": pa.array([r[1] for r in rows], pa.int64()), "chunks": pa.array([r[2] for r in rows], pa.int64())})

    return placed.groupBy("batch_id").applyInArrow(fold, "batch_id long, idx int, raw_start long, raw_len long, chunks long")


def floor_join(points: DataFrame, steps: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """points with the `value` of the step with the greatest start <= at of equal keys (null for none): a union and one window, no range join."""
    s = steps.select(*keys, F.col(start).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_k"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in keys])
    p = points.withColumns({"_at": F.col(at), "_v": F.lit(None).cast(steps.schema[value].dataType), "_k": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(p).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_k = 1").drop("_at", "_v", "_k").withColumnRenamed("_last", value)


def overlap(parts: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """parts (key, start, size) that meet [from, to) of asked (key, from, to), with the slice of each: an equi-join and a range check."""
    j = parts.join(asked, key).where((F.col("start") < F.col("to")) & (F.col("start") + F.col("size") > F.col("from")))
    low, high = F.greatest(F.lit(0), F.col("from") - F.col("start")), F.least("size", F.col("to") - F.col("start"))
    return j.withColumns({"skip": low, "take": high - low})


def running_offsets(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def reassemble(chunks: DataFrame, data: str = "data", joint: str = "") -> DataFrame:
    """(file_id, content): a file's chunks in order of seq; a file is one value, as it was read."""
    if dict(chunks.dtypes)[data] == "string":
        ordered = F.array_sort(F.collect_list(F.struct("seq", data)))
        content = F.array_join(F.transform(ordered, lambda s: s[data]), joint)
    else:
        content = F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY seq)")
    return chunks.groupBy("file_id").agg(content.alias("content"))


def range_read(parts: DataFrame, asked: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, from, content): the bytes of [from, to) of each asked range, cut out of the parts (key, start, size, data) that
    meet it and joined; null if one of those has no bytes. Ranges that meet no part are absent."""
    cut_ = overlap(parts, asked, key).withColumn("piece", F.expr(f"substring(`{data}`, CAST(skip + 1 AS INT), CAST(take AS INT))"))
    whole = F.expr("listagg(piece) WITHIN GROUP (ORDER BY start)")
    return cut_.groupBy(key, "from").agg(F.when(F.bool_and(F.col("piece").isNotNull()), whole).alias("content"))


def sealed(placed: DataFrame, most: int, order: list[str], level: int = 12) -> DataFrame:
    """(batch_id, idx, raw_start, raw_len, frame): chunks (batch_id, size, data and `order`) of each batch packed in order into
    zstd frames, a frame ending with the chunk that fills it. A batch, bounded by its sealing size, is folded as a stream."""
    kinds = pa.schema([("batch_id", pa.int64()), ("idx", pa.int32()), ("raw_start", pa.int64()), ("raw_len", pa.int64()), ("frame", pa.binary())])

    def run(rows_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level)
        now, held, size, start, idx = None, [], 0, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"batch_id": now, "idx": idx, "raw_start": start, "raw_len": size, "frame": press.compress(b"".join(held))}], kinds)

        for batch in rows_in:
            for b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    if held:
                        yield out()
                    now, held, size, start, idx = b, [], 0, 0, 0
                held.append(data)
                size += len(data)
                if size >= most:
                    yield out()
                    held, start, size, idx = [], start + size, 0, idx + 1
        if held:
            yield out()

    dealt = placed.repartition("batch_id").sortWithinPartitions("batch_id", *order)
    return dealt.select("batch_id", F.col("data").cast("binary").alias("data")).mapInArrow(run, "batch_id long, idx int, raw_start long, raw_len long, frame binary")


def read_chunks(placed: DataFrame, frames_: DataFrame) -> DataFrame:
    """(hash, data, ok) of chunks (hash, batch_id, raw_offset, size): each is cut out of the frame with the greatest start at or
    before its offset and verified against its hash (SHA-256, hex). A frame is decompressed once for all its chunks; a chunk
    whose frame is missing or too short has no data and isn't ok."""
    own = floor_join(placed.select("hash", "batch_id", "raw_offset", "size"), frames_, ["batch_id"], "raw_offset", "raw_start", "idx")
    places = frames_.select("batch_id", "idx", "raw_start", "frame")

    def read(a: pa.Table, b: pa.Table) -> pa.Table:
        import zstandard

        raw, start = b"", 0
        if len(b):
            start = b["raw_start"][0].as_py()
            raw = zstandard.ZstdDecompressor().decompress(b["frame"][0].as_py())
        found = []
        for h, at, size in zip(a["hash"].to_pylist(), a["raw_offset"].to_pylist(), a["size"].to_pylist(), strict=True):
            piece = raw[at - start : at - start + size]
            good = bool(len(b)) and len(piece) == size and hashlib.sha256(piece).hexdigest() == h
            found.append((h, piece if good else None, good))
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({"hash": pa.array(cols[0], pa.string()), "data": pa.array(cols[1], pa.binary()), "ok": pa.array(cols[2], pa.bool_())})

    return own.groupBy("batch_id", "idx").cogroup(places.groupBy("batch_id", "idx")).applyInArrow(read, "hash string, data binary, ok boolean")


def batch_of_chunks(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """(file_id, seq, hash, size, batch_id, raw_offset): where each chunk of each file lies; null for chunks in no batch."""
    return chunks.select("file_id", "seq", "hash", "size").join(placed.select("hash", "batch_id", "raw_offset"), "hash", "left")


def bloom(items: DataFrame, column: str, n: int, p: float = 0.01) -> bytes:
    """A filter's bits from binary digests (16 bytes at least): tasks return distinct places, each once."""
    m, k = K.bloom_size(n, p)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(K.bloom_places([x for x in batch.column(0).to_pylist() if x], m, k))
            words, bits = at >> 16, at & 65535
            rows = []
            for w in np.unique(words):
                page = np.zeros(65536, bool)
                page[bits[words == w]] = True
                rows.append((int(w), np.packbits(page).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["page", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()]))
        return pa.table({"page": table["page"].slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    pages = items.select(column).mapInArrow(places, "page long, bits binary").groupBy("page").applyInArrow(merge, "page long, bits binary")
    out = np.zeros(-(-m // 65536) * 8192, np.uint8)
    for r in pages.toLocalIterator():
        out[r.page * 8192 : (r.page + 1) * 8192] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def bloom_probe(column: Column, bits, m: int, k: int) -> Column:
    """Whether a digest may be in the filter (a broadcast of bloom()); never false for a member."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = np.frombuffer(bits.value, np.uint8)
        for array in batches:
            at = K.bloom_places([x or bytes(16) for x in array.to_pylist()], m, k)
            yield pa.array(((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return run(column)


def expected_fpr(bits: Column, probes: Column, n: Column) -> Column:
    return F.pow(1 - F.exp(-probes * n / bits), probes)


def compressed(placed: DataFrame, level: int = 12, dict_bytes: int = 112 << 10, sample: int = 16 << 10) -> DataFrame:
    """(batch_id, raw_bytes, plain_bytes, dict_bytes): zstd per chunk, and with a dictionary of the batch's sampled chunks (none under 8 samples)."""
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        data = table["data"].to_pylist()
        step = max(1, len(data) // 2000)
        samples = [d[:sample] for d in data[::step] if d]
        own = None
        if len(samples) >= 8:
            try:
                own = zstandard.train_dictionary(min(dict_bytes, max(1024, sum(map(len, samples)) // 8)), samples)
            except zstandard.ZstdError:
                own = None
        plain = zstandard.ZstdCompressor(level=level)
        rich = zstandard.ZstdCompressor(level=level, dict_data=own) if own else plain
        total = lambda c: sum(len(c.compress(d)) for d in data)
        return pa.table({"batch_id": table["batch_id"].slice(0, 1), "raw_bytes": pa.array([sum(map(len, data))], pa.int64()), "plain_bytes": pa.array([total(plain)], pa.int64()), "dict_bytes": pa.array([total(rich)], pa.int64())})

    return placed.groupBy("batch_id").applyInArrow(run, "batch_id long, raw_bytes long, plain_bytes long, dict_bytes long")
