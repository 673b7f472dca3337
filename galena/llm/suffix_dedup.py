"""Removal of repeated byte strings by longest-previous-factor arrays (operator 3).

A byte goes if a string of `length` bytes that covers it also starts earlier in the collection (smaller id, or earlier
in the same document). All such strings are found, of any two documents, in four steps:

1. A string of `length` bytes is dealt by its minimizer, the smallest hash of its GRAM-byte substrings: equal strings meet,
   and runs of neighbouring strings with one minimizer travel as one segment (minimizer, hash of its content, place).
   Segments repeated in a batch of documents are found there and sent once.
2. Of segments with equal contents the earliest stays and all strings of the others go.
3. Minimizers with segments of several contents go on: the earliest segment of each content is cut out of its text, the
   segments of a task are put in order, their suffix array is built by prefix doubling up to `length` bytes, and a string
   goes if its previous or next smaller position in suffix order shares its first `length` bytes: its longest previous
   factor reaches `length`.
4. The strings found are joined with their documents.

Contents of segments are compared by 128 bits (minimizer and hash, or two hashes of the string), not byte by byte; where
a minimizer has several contents, bytes are compared.

Minimizers that many documents of a sample hold next to unlike contents are dealt by the hash of the whole string, so
that no common line or passage gathers its surroundings of all documents in one task. The sample only steers the deal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm import hashing
from galena.session import cut

LENGTH, GRAM = 100, 32
#: Bytes per batch; sampled documents; sampled documents with unlike contents from which a minimizer counts as common; bytes per suffix array.
BATCH, SAMPLE, COMMON, PIECE = 4_000_000, 4000, 12, 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _double(h: np.ndarray, size: int, power: int) -> tuple[np.ndarray, int]:
    """Hashes of all substrings twice as long; power: base ** size mod 2**64."""
    return h[:-size] * np.uint64(power) + h[size:], power * power % 2**64


def grams(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all GRAM-byte substrings and plain hashes of all `length`-byte substrings of a text of at least `length` bytes."""
    level = {1: hashing.mix(raw.astype(np.uint64) + np.uint64(1))}
    powers = {1: _BASE}
    size = 1
    while 2 * size <= length:
        level[2 * size], powers[2 * size] = _double(level[size], size, powers[size])
        size *= 2
    short = level[GRAM]
    whole, done, left = None, 0, length
    while left:
        size = max(s for s in level if s <= left)
        part = level[size][done : done + len(raw) - length + 1]
        whole = part if whole is None else whole * np.uint64(powers[size]) + part
        done, left = done + size, left - size
    return hashing.mix(short), whole


def _slide(x: np.ndarray, width: int, better) -> np.ndarray:
    """better (minimum or maximum) over every `width` neighbours."""
    size, out = 1, x
    while 2 * size <= width:
        out = better(out[:-size], out[size:])
        size *= 2
    return better(out[: len(x) - width + 1], out[width - size :][: len(x) - width + 1]) if size < width else out


def segments(raw: np.ndarray, length: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimizer, content hash, first, last, self) of the runs of window starts of one text.

    self: the minimizer lies in the segment more than once, so it may repeat a string in itself. Windows whose minimizer
    is common become segments of their own under the hash of their content.
    """
    short, whole = grams(raw, length)
    width = length - GRAM + 1
    low = _slide(short, width, np.minimum)
    n = len(low)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[first, n])
    if (size > width).any():  # periodic text: no longer runs than a minimizer's own reach
        first = np.concatenate([np.arange(f, f + s, width) for f, s in zip(first.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.r_[first, n])
    last = first + size - 1
    value = low[first]
    chosen = np.flatnonzero(short <= _slide(np.r_[np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)], width, np.maximum))
    again = (short[chosen][1:] == short[chosen][:-1]) & (chosen[1:] - chosen[:-1] <= 2 * width)
    pairs = np.flatnonzero(again)
    own = np.zeros(len(first), bool)
    if len(pairs):  # a pair of equal minimizers within one segment's substrings
        a, b = chosen[pairs], chosen[pairs + 1]
        at = np.searchsorted(a, first, side="left")
        inside = at < len(a)
        own[inside] = b[np.minimum(at, len(a) - 1)][inside] <= (last + width - 1)[inside]
        own &= np.isin(value, short[a])
    sig = hashing.mix(whole[first] * np.uint64(3) + hashing.mix(whole[last] + size.astype(np.uint64)))
    if len(common):
        hot = np.isin(value, common)
        if hot.any():
            alone = np.concatenate([np.arange(f, e + 1) for f, e in zip(first[hot].tolist(), last[hot].tolist(), strict=True)])
            content = hashing.mix(whole[alone] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            again = np.zeros(len(alone), np.uint64)  # a second hash, of the hashes of its pieces
            for at in [*range(0, length - GRAM, GRAM), length - GRAM]:
                again = hashing.mix(again * np.uint64(5) + short[alone + at])
            value, sig = np.r_[value[~hot], content], np.r_[sig[~hot], again]
            first, last, own = np.r_[first[~hot], alone], np.r_[last[~hot], alone], np.r_[own[~hot], np.zeros(len(alone), bool)]
    return value, sig, first, last, own


_KINDS = {"part": pa.int32(), "kind": pa.int32(), "h": pa.binary(), "sig": pa.binary(), "doc": pa.binary(), "runs": pa.binary(), "first": pa.binary(), "reach": pa.binary()}
_SCHEMA = "part int, kind int, h binary, sig binary, doc binary, runs binary, first binary, reach binary"
_ARROW = pa.schema(list(_KINDS.items()))
_OPEN, _GONE = 0, 1
#: A document's place: its id (null last), then the hash that tells rows of one id apart.
_PLACE = np.dtype([("none", "u1"), ("id", "<i8"), ("key", "<u8")])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _ARROW, strict=True)], schema=_ARROW)


def _place_runs(doc: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes]:
    cuts = np.r_[0, np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)] if len(doc) else np.zeros(1, np.int64)
    return places[doc[cuts[:-1]]].tobytes(), np.diff(cuts).astype(np.uint32).tobytes()


def _rows_of(part: np.ndarray, kind: int, h, sig, doc, places, first, reach) -> list[tuple]:
    """Blob rows per part; entries are sorted by part, then by document."""
    order = np.lexsort((doc, part))
    part, doc, first, reach = part[order], doc[order], first[order], reach[order]
    h, sig = (None if x is None else x[order] for x in (h, sig))
    rows = []
    for p, a, b in hashing.pieces(part):
        docs, runs = _place_runs(doc[a:b], places)
        rows.append((p, kind, None if h is None else h[a:b].tobytes(), None if sig is None else sig[a:b].tobytes(), docs, runs, first[a:b].astype(np.uint32).tobytes(), reach[a:b].astype(np.uint8).tobytes()))
    return rows


def _unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(place index, places, first, reach) of blob rows; equal places have equal indexes, in order."""
    held = np.frombuffer(b"".join(t["doc"].to_pylist()), _PLACE)
    runs = hashing.joined(t["runs"], np.uint32)
    places, inverse = np.unique(held, return_inverse=True)
    return np.repeat(inverse, runs), places, hashing.joined(t["first"], np.uint32).astype(np.int64), hashing.joined(t["reach"], np.uint8)


def _repeats(h: np.ndarray, sig: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, sig, place), and whether an entry is the first of its content."""
    order = np.argsort(doc * (1 << 32) + first)
    order = order[np.argsort(sig[order], kind="stable")]
    order = order[np.argsort(h[order], kind="stable")]
    head = np.ones(len(order), bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (sig[order][1:] != sig[order][:-1])
    return order, head


def _deal(parts: int, length: int, common):
    def flush(rows: list[tuple]) -> pa.Table:
        places = np.array([(own is None, own or 0, key % 2**64) for key, own, _ in rows], _PLACE)
        places, by = np.unique(places, return_index=True)  # rows equal in id and text count as one
        found = []
        for at, i in enumerate(by.tolist()):
            raw = np.frombuffer(rows[i][2], np.uint8)
            if len(raw) >= length:
                s = segments(raw, length, common.value)
                found.append((*s, np.full(len(s[0]), at)))
        if not found:
            return _table([])
        h, sig, first, last, own, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order, head = _repeats(h, sig, doc, first)
        keep, gone = order[head], order[~head]
        reach = (last - first) | (own.astype(np.int64) << 7)
        part = lambda i: ((h[i] >> np.uint64(16)) % np.uint64(parts)).astype(np.uint32)
        bucket = (places["key"][doc[gone]] % np.uint64(parts)).astype(np.uint32)
        out = _rows_of(part(keep), _OPEN, h[keep], sig[keep], doc[keep], places, first[keep], reach[keep])
        return _table(out + _rows_of(bucket, _GONE, None, None, doc[gone], places, first[gone], (last - first)[gone]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for key, own, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if text:
                    rows.append((key, own, text.encode("utf-8", "surrogatepass")))
                    size += len(rows[-1][2])
                if size >= BATCH:
                    yield from flush(rows).to_batches()
                    rows, size = [], 0
        if rows:
            yield from flush(rows).to_batches()

    return run


def _settle(parts: int):
    """The segments of one part -> strings that go, and earliest segments of minimizers that have several contents (with h)."""

    def run(table: pa.Table) -> pa.Table:
        out = [tuple(r[c] for c in _KINDS) for r in table.filter(pc.equal(table["kind"], _GONE)).to_pylist()]
        t = table.filter(pc.equal(table["kind"], _OPEN))
        h, sig = hashing.joined(t["h"]), hashing.joined(t["sig"])
        doc, places, first, reach = _unpack(t)
        order, head = _repeats(h, sig, doc, first)
        same = np.zeros(len(order), bool)  # a row that is repeated elsewhere
        same[1:] = ~head[1:] & (doc[order][1:] == doc[order][:-1]) & (first[order][1:] == first[order][:-1])
        gone, keep = order[~head & ~same], order[head]
        own = (reach >> 7).astype(bool)
        cuts = np.r_[0, np.flatnonzero(np.diff(h[keep])) + 1, len(keep)] if len(keep) else np.zeros(1, np.int64)
        many = np.diff(cuts) > 1
        alone = np.add.reduceat(own[keep].astype(np.int64), cuts[:-1]) > 0 if len(keep) else np.zeros(0, bool)
        go = keep[np.repeat(many | alone, np.diff(cuts))]
        bucket = lambda i: (places["key"][doc[i]] % np.uint64(parts)).astype(np.uint32)
        out += _rows_of(bucket(gone), _GONE, None, None, doc[gone], places, first[gone], reach[gone] & 127)
        return _table(out + _rows_of(bucket(go), _OPEN, h[go], None, doc[go], places, first[go], reach[go] & 127))

    return run


def _per_document(table: pa.Table) -> pa.Table:
    """The rows of one bucket of documents -> a row per document: window runs that go; segments that a suffix array must judge."""
    schema = pa.schema([("key", pa.int64()), ("gone", pa.binary()), ("h", pa.binary()), ("open", pa.binary())])
    g = table.filter(pc.equal(table["kind"], _GONE))
    o = table.filter(pc.equal(table["kind"], _OPEN))
    gd, gp, gf, gr = _unpack(g)
    od, op, of, orr = _unpack(o)
    h = hashing.joined(o["h"])
    rows: dict[int, list] = {}

    def pairs(first: np.ndarray, reach: np.ndarray) -> bytes:
        return np.stack([first, first + reach], axis=1).astype(np.uint32).tobytes()

    by = np.argsort(gd, kind="stable")
    for d, a, b in hashing.pieces(gd[by]):
        rows.setdefault(int(gp["key"][d]), [b"", b"", b""])[0] = pairs(gf[by[a:b]], gr[by[a:b]])
    by = np.argsort(od, kind="stable")
    for d, a, b in hashing.pieces(od[by]):
        row = rows.setdefault(int(op["key"][d]), [b"", b"", b""])
        row[1], row[2] = h[by[a:b]].tobytes(), pairs(of[by[a:b]], orr[by[a:b]])
    keys = np.array(list(rows), np.uint64).view(np.int64)
    return pa.Table.from_arrays([pa.array(keys), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(3))], schema=schema)


def suffix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the substrings of `length` bytes that start at `at`, by prefix doubling over all suffixes."""
    padded = np.r_[data, np.zeros(2 * length + 8, np.uint8)]
    n = len(data) + length
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= padded[j : j + n]

    def dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)  # ties get one rank, so their order is of no matter
        key = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        return rank

    rank, size = dense(key), 8
    while size < length:
        step = min(size, length - size)
        more = np.r_[rank[step:], np.zeros(step, np.int64)]
        rank, size = dense(rank.astype(np.uint64) * np.uint64(n + 1) + more.astype(np.uint64)), size + step
    return rank[at]


def nearest_smaller(position: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest earlier entry with a smaller value, or -1: pointers jump until all hold."""
    back = np.arange(-1, len(position) - 1)
    todo = np.flatnonzero(back >= 0)
    while len(todo):
        todo = todo[position[back[todo]] > position[todo]]
        back[todo] = back[back[todo]]
        todo = todo[back[todo] >= 0]
    return back


def previous_factors(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor at each of the ascending places reaches `length`.

    The places are taken in suffix order; the longest common prefix with an earlier place is met by the previous or the
    next smaller place in that order.
    """
    rank = suffix_ranks(data, at, length)
    order = np.lexsort((at, rank))
    place, rank = at[order], rank[order]
    before = nearest_smaller(place)
    after = nearest_smaller(place[::-1])
    after = np.where(after >= 0, len(place) - 1 - after, -1)[::-1]
    long = ((before >= 0) & (rank[before] == rank)) | ((after >= 0) & (rank[after] == rank))
    out = np.zeros(len(at), bool)
    out[order] = long
    return out


def _judge(length: int):
    """The segments of a task -> window starts that go, as (key, gone blobs). Ties and order are those of the places."""

    def run(table: pa.Table) -> pa.Table:
        none, own, key = np.asarray(table["id"].is_null()), np.asarray(pc.fill_null(table["id"], 0)), np.asarray(table["key"]).view(np.uint64)
        first = np.asarray(table["first"])
        order = np.lexsort((first, key, own, none))
        new = np.ones(len(order), bool)  # rows equal in id and text send each segment again: it counts once
        new[1:] = (key[order][1:] != key[order][:-1]) | (first[order][1:] != first[order][:-1])
        order = order[new]
        raw = table["bytes"].to_pylist()
        parts = [np.frombuffer(raw[i], np.uint8) for i in order]
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        total = np.cumsum(windows)
        owner = np.repeat(np.arange(len(parts)), windows)
        offset = np.arange(total[-1] if len(total) else 0) - np.repeat(total - windows, windows)
        at = starts[owner] + offset
        # windows of one text that lie in overlapping segments are one place of the text: the same start never precedes itself
        long = previous_factors(np.concatenate(parts), at, length) if len(parts) else np.zeros(0, bool)
        keys, blobs = [], []
        hit = np.flatnonzero(long)
        begin = first[order][owner[hit]] + offset[hit]
        for seg, a, b in hashing.pieces(owner[hit]):
            s = begin[a:b]
            cuts = np.r_[0, np.flatnonzero(np.diff(s) > 1) + 1, len(s)]
            keys.append(key[order[seg]])
            blobs.append(np.stack([s[cuts[:-1]], s[cuts[1:] - 1]], axis=1).astype(np.uint32).tobytes())
        return pa.table({"key": pa.array(np.array(keys, np.uint64).view(np.int64)), "gone": pa.array(blobs, pa.binary())})

    return run


def _common(keyed: DataFrame, length: int) -> np.ndarray:
    """Minimizers that at least COMMON sampled documents hold with unlike contents. At most SAMPLE documents or so are read."""
    n = keyed.count()
    every = max(1, n // SAMPLE)
    nothing = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_h, out_s = [], []
            for text in batch.column(0).to_pylist():
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(raw) >= length:
                    h, sig, *_ = segments(raw, length, nothing)
                    out_h.append(h)
                    out_s.append(sig)
            if out_h:
                both = np.unique(np.stack([np.concatenate(out_h), np.concatenate(out_s)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], ["h", "sig"])

    picked = keyed.where(F.pmod(F.xxhash64(F.lit(1), "id", "key"), F.lit(every)) == 0).select("text").where(F.col("text").isNotNull())
    found = picked.mapInArrow(run, "h long, sig long").distinct().groupBy("h").count().where(F.col("count") >= COMMON).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def _cutter(length: int):
    """Documents with their open segments -> a row per segment with its bytes."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for key, own, text, h, pairs in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if key == before:  # a repeated row; those that lie apart are merged by _judge
                    continue
                before = key
                raw = text.encode("utf-8", "surrogatepass")
                for value, (a, b) in zip(np.frombuffer(h, np.int64).tolist(), np.frombuffer(pairs, np.uint32).reshape(-1, 2).tolist(), strict=True):
                    for c, x in zip(cols, (value, own, key, a, raw[a : b + length]), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def spans(gone: bytes | None, length: int) -> np.ndarray:
    """Merged byte ranges [start, end) that runs of window starts cover; ranges that touch are one."""
    p = np.frombuffer(gone or b"", np.uint32).astype(np.int64).reshape(-1, 2)
    if not len(p):
        return p
    p = p[np.argsort(p[:, 0], kind="stable")]
    reach = np.maximum.accumulate(p[:, 1] + length)
    new = np.r_[True, p[1:, 0] > reach[:-1]]
    at = np.flatnonzero(new)
    return np.stack([p[at, 0], reach[np.r_[at[1:] - 1, len(p) - 1]]], axis=1)


def repeated(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, gone): per document hash the runs of window starts that go, as pairs of 32-bit numbers. Documents without any are absent."""
    spark = docs.sparkSession
    parts = hashing.parts(docs, text)
    keyed = docs.select(F.xxhash64(key, text).alias("key"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    common = spark.sparkContext.broadcast(_common(keyed, length))  # of a bounded sample
    dealt = keyed.mapInArrow(hashing.trimmed(_deal(parts, length, common)), _SCHEMA)
    settled = dealt.groupBy("part").applyInArrow(hashing.trimmed_group(_settle(parts)), _SCHEMA)
    found = cut(settled.groupBy("part").applyInArrow(_per_document, "key long, gone binary, h binary, open binary"), "repeats")
    opened = found.where(F.length("open") > 0).select("key", "h", "open")
    load = opened.agg(F.sum(F.length("open"))).first()[0] or 0
    tasks = max(1, load // 8 * (length + length // 3) // PIECE)
    segs = keyed.join(opened, "key").select("key", "id", "text", "h", "open").mapInArrow(hashing.trimmed(_cutter(length)), "h long, id long, key long, first long, bytes binary")
    judged = segs.withColumn("task", F.pmod(F.xxhash64("h"), F.lit(int(tasks)))).groupBy("task").applyInArrow(hashing.trimmed_group(_judge(length)), "key long, gone binary")
    runs = found.where(F.length("gone") > 0).select("key", "gone").union(judged)
    return runs.groupBy("key").agg(F.listagg("gone").alias("gone"))


def remaining(raw: bytes, gone: bytes | None, length: int) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    s = spans(gone, length)
    if not len(s):
        return raw, 0, 0
    edges = [0, *s.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((s[:, 1] - s[:, 0]).sum()), len(s)


def _with_runs(docs: DataFrame, length: int, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with the runs of window starts that go, null for none, and the name of that column."""
    place, gone = hashing.free(docs, "place"), hashing.free(docs, "gone")
    runs = repeated(docs, length, key, text).withColumnsRenamed({"key": place, "gone": gone})
    return docs.join(runs, F.xxhash64(key, text) == F.col(place), "left").drop(place), gone


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (binary: the remaining bytes joined). Columns of these names are replaced.

    A null text is empty. Matches never cross documents. Rows that repeat an id with another text are documents of their
    own, ordered by a hash; rows equal in id and text count as one and get the same result. Null ids come last.
    """

    @F.arrow_udf("struct<n_removed:long,n_spans:long,kept:binary>")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blobs in batches:
            kept, removed, count = [], [], []
            for t, g in zip(texts.to_pylist(), blobs.to_pylist(), strict=True):
                for c, x in zip((kept, removed, count), remaining((t or "").encode("utf-8", "surrogatepass"), g, length), strict=True):
                    c.append(x)
            yield pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])

    run = apply.asNondeterministic()  # evaluated once for all its fields
    joined, gone = _with_runs(docs, length, key, text)
    own = hashing.free(joined, "own")
    size = F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long"))
    joined = joined.withColumns({own: run(F.col(text), F.col(gone)), "n_bytes": size})
    out = joined.withColumns({c: F.col(own).getField(c) for c in ("n_removed", "n_spans", "kept")})
    return out.drop(own, gone)


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their texts less the repeated bytes; all other columns stay.

    Characters of which a byte went go whole. Rows whose text went whole go; texts that were empty or null before stay.
    """

    @F.arrow_udf("struct<text:string,stays:boolean>")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blobs in batches:
            out, stays = [], []
            for t, g in zip(texts.to_pylist(), blobs.to_pylist(), strict=True):
                if g:
                    kept, _, _ = remaining(t.encode("utf-8", "surrogatepass"), g, length)
                    t = kept.decode("utf-8", "ignore")
                    stays.append(bool(kept))
                else:
                    stays.append(True)
                out.append(t)
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(stays)], ["text", "stays"])

    run = apply.asNondeterministic()
    joined, gone = _with_runs(docs, length, key, text)
    own = hashing.free(joined, "own")
    joined = joined.withColumn(own, run(F.col(text), F.col(gone)))
    return joined.where(F.col(own).getField("stays")).withColumn(text, F.col(own).getField("text")).drop(own, gone)
