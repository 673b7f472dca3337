"""Language-model scoring with a log-frequency Bloom filter (operator 8).

Learning counts every n-gram (n = 1, 2, 3) of the training texts over the whole table. A count c is quantised to the level
q = 1 + floor(log2 c), and the filter holds the n-gram at levels 1..q; a reader probes level after level until a miss.
Trigrams enter from LEAST times on, as most others never come again. The PROBES bits of an entry lie in one 64-bit word, so
that a probe reads memory once.
Each part of the hash space builds its own segment of the filter, BITS bits an entry at every size. A filter of at most
MAX_BYTES is broadcast. The segments of a larger one stay in their parts: each batch of documents sends its distinct
n-grams there and gets their levels back, with the same scores.

The model's probability of w after u v mixes the quantised trigram estimate with that of w after v, and this one with the
smoothed quantised unigram; the weights grow with the context's count. Every estimate is at most 1, and so is the mix.
The base score needs exact counts. Words with at least one in HEAVY tokens are HEAVY words at most and are broadcast; a
rarer word sends a bounded share of the rows, so documents and counts of rarer words meet by hash without hot keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm import hashing
from galena.session import cut, release

#: Bits per filter entry, probes per level, bound of a broadcast filter, tokens per counted and per scored batch, bound of the broadcast words.
BITS, PROBES, MAX_BYTES, BATCH, SCORED, HEAVY = 8, 4, 256 * 2**20, 1_000_000, 250_000, 50_000
#: Of bigrams and of trigrams: the weight of the estimate for frequent contexts, and the context count at which it is halved.
WEIGHTS, HALVES = (0.5, 0.5), (4.0, 2.0)
#: Count from which trigrams enter the filter; bytes of text per part.
LEAST, EACH = 2, 8 << 20
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_LEVEL, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_COUNTS, _PAIRS, _TRIPLES, _FILTER, _DOCS, _WORDS, _ASKED, _LEVELS, _TEXTS = range(9)
_SCHEMA = "part int, kind int, a binary, b binary, c binary, d binary"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in "abcd"])
_ROW = np.dtype([("id", "<i8"), ("none", "?"), ("held", "?"), ("n", "<i8"), ("known", "<i8"), ("log", "<f8"), ("score", "<f8")])
_KEYED = np.dtype([("key", "<u8"), ("info", _ROW)])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _ARROW, strict=True)], schema=_ARROW)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _after(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """values moved on by one within each of the concatenated texts that start at `starts`."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def bigrams(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes below 2**48 of the last two and of the last three tokens up to each token of concatenated texts."""
    two = hashing.mix(_after(tokens, starts, _START) * _NEXT + tokens)
    three = hashing.mix(_after(two, starts, _START) * _NEXT + tokens)
    return two >> np.uint64(16), three >> np.uint64(16)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def estimate(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (3 * np.exp2(level - 1.0) - 1) / 2, 0.0)


def _spots(h: np.ndarray, level: int, words) -> tuple[np.ndarray, np.ndarray]:
    """The word of each n-gram at a level in a segment of so many words, and its bits there."""
    g = hashing.mix(h + np.array([level], np.uint64) * _LEVEL)
    mask = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63))
    return ((g >> np.uint64(32)) * words) >> np.uint64(32), mask


def segment(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of a filter segment that holds each n-gram at its levels."""
    q = levels(counts)
    out = np.zeros(max(1, -(-int(q.sum()) * BITS // 64)), np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        at, mask = _spots(h[q >= level], level, np.uint64(len(out)))
        np.bitwise_or.at(out, at, mask)
    return out


@dataclass
class Model:
    """bits: the words of all parts' segments; offsets: where each begins; tokens, kinds, texts: of the training texts;
    heavy, heavy_counts: frequent words and their exact counts."""

    bits: np.ndarray
    offsets: np.ndarray
    tokens: int
    kinds: int
    texts: int
    heavy: np.ndarray
    heavy_counts: np.ndarray

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes from level 1 on until a miss."""
        part = _part(h, len(self.offsets) - 1)
        start = self.offsets[part].astype(np.uint64)
        words = np.diff(self.offsets)[part].astype(np.uint64)
        out = np.zeros(len(h), np.int64)
        live, level = np.flatnonzero(words > 0), 0
        if len(live) < len(h):
            h, start, words = h[live], start[live], words[live]
        while len(live) and level < 64:
            level += 1
            at, mask = _spots(h, level, words)
            kept = np.flatnonzero((self.bits[start + at] & mask) == mask)
            live, h, start, words = live[kept], h[kept], start[kept], words[kept]
            out[live] = level
        return out

    def scores(self, tokens: np.ndarray, starts: np.ndarray, probe=None) -> np.ndarray:
        """log10 probability of each of the concatenated texts (none is without tokens: the end is one)."""
        probe = probe or self.probe
        two, three = bigrams(tokens, starts)
        one, both = estimate(probe(tokens)), estimate(probe(two))
        p = np.minimum(1.0, (one + 1) / (self.tokens + self.kinds + 1))
        context = _after(one, starts, float(self.texts))
        p = _mixed(p, both, context, 0)
        context = _after(both, starts, 0.0)
        live = np.flatnonzero((context > 0) & (both > 0))  # a trigram's bigrams are seen as often at least
        all_three = np.zeros(len(tokens))
        all_three[live] = estimate(probe(three[live]))
        return np.add.reduceat(np.log10(_mixed(p, all_three, context, 1)), starts)


def _mixed(p: np.ndarray, seen: np.ndarray, context: np.ndarray, order: int) -> np.ndarray:
    """p mixed with the estimate seen / context, by a weight that grows with the context's count."""
    share = WEIGHTS[order] * context / (context + HALVES[order])
    return share * np.minimum(1.0, seen / np.maximum(context, 1.0)) + (1 - share) * p


def _tokens(texts: list[str | None], memo: hashing.WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by the end token, and where each text starts."""
    parts = [np.r_[memo.of(hashing.words(t)), _END] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts), np.cumsum(sizes) - sizes


def _batches(batches: Iterator[pa.RecordBatch], column: int, tokens: int) -> Iterator[list[tuple]]:
    """Rows in groups of about so many tokens, judged by the length of the text in `column`."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[column] or "") + 8
            if size >= 6 * tokens:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hashing.WordHash(150_000)
        for rows in _batches(batches, 0, BATCH):
            tokens, starts = _tokens([r[0] for r in rows], memo)
            value, n = np.unique(tokens, return_counts=True)
            part = _part(value, parts)
            order = np.argsort(part, kind="stable")
            out = [(p, _COUNTS, value[order[a:b]].tobytes(), n[order[a:b]].astype(np.uint32).tobytes(), None, None) for p, a, b in hashing.pieces(part[order])]
            for kind, h in zip((_PAIRS, _TRIPLES), bigrams(tokens, starts), strict=True):
                value, n = np.unique(h, return_counts=True)
                for more in (False, True):  # most are there once: six bytes, without a count
                    own, times = value[(n > 1) == more], n[n > 1].astype(np.uint32)
                    part = _part(own, parts)
                    order = np.argsort(part, kind="stable")
                    out += [(p, kind, hashing.pack48(own[order[a:b]]), times[order[a:b]].tobytes() if more else None, None, None) for p, a, b in hashing.pieces(part[order])]
            yield from _table(out).to_batches()

    return run


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(n, cuts) if len(cuts) else n[:0]


def _build():
    """The counts of one part -> its exact word counts and its filter segment."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        t = table.filter(pc.equal(table["kind"], _COUNTS))
        h, n = _sum(hashing.joined(t["a"]), hashing.joined(t["b"], np.uint32).astype(np.int64))
        grams, times = [h], [n]
        for kind, least in ((_PAIRS, 1), (_TRIPLES, LEAST)):
            t = table.filter(pc.equal(table["kind"], kind))
            once, more = t.filter(pc.is_null(t["b"])), t.filter(pc.is_valid(t["b"]))
            single = hashing.unpack48(once["a"].to_pylist())
            own, c = _sum(np.r_[single, hashing.unpack48(more["a"].to_pylist())], np.r_[np.ones(len(single), np.int64), hashing.joined(more["b"], np.uint32)])
            grams.append(own[c >= least])
            times.append(c[c >= least])
        bits = segment(np.concatenate(grams), np.concatenate(times))
        return _table([(part, _COUNTS, h.tobytes(), n.tobytes(), None, None), (part, _FILTER, bits.tobytes(), None, None, None)])

    return run


def learn(training: DataFrame, text: str = "text", max_bytes: int = MAX_BYTES, parts: int | None = None) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model of all training texts, the table of exact word counts by part, and that of the filter's segments if they are over max_bytes."""
    spark = training.sparkSession
    parts = parts or hashing.parts(training, text, EACH)
    counted = training.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(_count(parts), _SCHEMA)
    built = cut(counted.groupBy("part").applyInArrow(_build(), _SCHEMA), "lm")
    counts, pieces = built.where(F.col("kind") == _COUNTS), built.where(F.col("kind") == _FILTER)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            h = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            texts = [int(c[v == _END].sum()) for c, v in zip(n, h, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64()), pa.array(texts, pa.int64())], ["n", "v", "d"])

    total = counts.select("b", "a").mapInArrow(sums, "n long, v long, d long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("d").alias("d")).first()
    tokens, kinds, texts = (int(total[c] or 0) for c in ("n", "v", "d"))
    floor = max(1, -(-tokens // HEAVY))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = hashing.joined(batch.column(0)), hashing.joined(batch.column(1), np.int64)
            own = n >= floor
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(n[own])], ["h", "n"])

    heavy = counts.select("a", "b").mapInArrow(often, "h long, n long").toPandas().sort_values("h")
    h = heavy["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    own = tokens, kinds, texts, h[order], heavy["n"].to_numpy(np.int64)[order]
    if (pieces.agg(F.sum(F.octet_length("a"))).first()[0] or 0) > max_bytes:
        return Model(np.zeros(0, np.uint64), np.zeros(parts + 1, np.int64), *own), counts, pieces
    found = {r.part: r.a for r in pieces.select("part", "a").toLocalIterator()}
    sizes = [len(found.get(p, b"")) // 8 for p in range(parts)]
    bits = np.frombuffer(b"".join(bytes(found.get(p, b"")) for p in range(parts)), np.uint64)
    return Model(bits, np.r_[0, np.cumsum(sizes)].astype(np.int64), *own), counts, None


def _info(rows: list[tuple], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of (key, id, held, text) rows, and what is known of them before they are scored."""
    info = np.zeros(len(rows), _ROW)
    info["id"] = [r[1] or 0 for r in rows]
    info["none"] = [r[1] is None for r in rows]
    info["held"] = [r[2] for r in rows]
    info["n"] = sizes
    return np.array([r[0] for r in rows], np.int64).view(np.uint64), info


def _rows(parts: int, model: Model, key: np.ndarray, info: np.ndarray, tokens: np.ndarray) -> list[tuple]:
    """Document rows dealt by key; the documents' rarer words dealt by hash."""
    doc = np.repeat(np.arange(len(info)), info["n"])
    at = np.minimum(np.searchsorted(model.heavy, tokens), max(0, len(model.heavy) - 1))
    hit = model.heavy[at] == tokens if len(model.heavy) else np.zeros(len(tokens), bool)
    if hit.any():
        info["known"] = np.bincount(doc[hit], minlength=len(info))
        info["log"] = np.bincount(doc[hit], np.log10(model.heavy_counts[at[hit]] + 1.0), len(info))
    bucket = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out = [(p, _DOCS, key[order[a:b]].tobytes(), info[order[a:b]].tobytes(), None, None) for p, a, b in hashing.pieces(bucket[order])]
    rare, by = tokens[~hit], doc[~hit]
    part = _part(rare, parts)
    order = np.argsort(part, kind="stable")
    for p, a, b in hashing.pieces(part[order]):
        own = order[a:b]
        owners, runs = hashing.runs(key[by[own]])
        out.append((p, _WORDS, rare[own].tobytes(), owners, runs, None))
    return out


def _score(parts: int, shared):
    """Documents -> document rows and rarer words, scored by the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        memo = hashing.WordHash(150_000)
        for rows in _batches(batches, 3, SCORED):
            tokens, starts = _tokens([r[3] for r in rows], memo)
            key, info = _info(rows, np.diff(np.r_[starts, len(tokens)]))
            info["score"] = model.scores(tokens, starts)
            yield from _table(_rows(parts, model, key, info, tokens)).to_batches()

    return run


def _grams(tokens: np.ndarray, starts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of concatenated texts, their order by part, and their parts in that order."""
    grams = np.unique(np.concatenate([tokens, *bigrams(tokens, starts)]))
    part = _part(grams, parts)
    order = np.argsort(part, kind="stable")
    return grams, order, part[order]


def _ask(parts: int):
    """Documents -> the distinct n-grams of each batch dealt by hash, and the batch's tokens under its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hashing.WordHash(150_000)
        for rows in _batches(batches, 3, BATCH):
            tokens, starts = _tokens([r[3] for r in rows], memo)
            key, info = _info(rows, np.diff(np.r_[starts, len(tokens)]))
            keyed = np.zeros(len(rows), _KEYED)
            keyed["key"], keyed["info"] = key, info
            words, at = np.unique(tokens, return_inverse=True)
            name = uuid.uuid4().bytes
            grams, order, part = _grams(tokens, starts, parts)
            out = [(0, _TEXTS, words.tobytes(), at.astype(np.uint32).tobytes(), keyed.tobytes(), name)]
            out += [(p, _ASKED, grams[order[a:b]].tobytes(), None, None, name) for p, a, b in hashing.pieces(part)]
            yield from _table(out).to_batches()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The filter's segment of one part and the n-grams asked of it -> their levels, in the order asked."""
    bits = hashing.joined(table.filter(pc.equal(table["kind"], _FILTER))["a"])
    none = np.zeros(0, np.uint64)
    model = Model(bits, np.array([0, len(bits)], np.int64), 0, 0, 0, none, none.view(np.int64))
    asked = table.filter(pc.equal(table["kind"], _ASKED)).select(["part", "a", "d"])
    out: list[tuple] = []
    held, size = [], 0
    for i, row in enumerate(zip(*(c.to_pylist() for c in asked.columns), strict=True)):
        held.append(row)
        size += len(row[1]) // 8
        if size >= BATCH or i == len(asked) - 1:  # some rows at once, as a row may have few
            level = model.probe(np.frombuffer(b"".join(r[1] for r in held), np.uint64)).astype(np.uint8)
            ends = np.cumsum([len(r[1]) // 8 for r in held])
            out += [(p, _LEVELS, x.tobytes(), None, None, name) for (p, _, name), x in zip(held, np.split(level, ends[:-1]), strict=True)]
            held, size = [], 0
    return _table(out)


def _answered(parts: int, shared):
    """A batch's tokens and the levels of its n-grams -> document rows and rarer words."""

    def run(table: pa.Table) -> pa.Table:
        model: Model = shared.value
        t = table.filter(pc.equal(table["kind"], _TEXTS))
        tokens = hashing.joined(t["a"])[hashing.joined(t["b"], np.uint32)]
        keyed = np.frombuffer(b"".join(t["c"].to_pylist()), _KEYED)
        key, info = keyed["key"].copy(), keyed["info"].copy()
        starts = np.cumsum(info["n"]) - info["n"]
        grams, order, _ = _grams(tokens, starts, parts)
        level = np.zeros(len(grams), np.int64)
        level[order] = hashing.joined(table.filter(pc.equal(table["kind"], _LEVELS)).sort_by("part")["a"], np.uint8)
        info["score"] = model.scores(tokens, starts, lambda h: level[np.searchsorted(grams, h)])
        return _table(_rows(parts, model, key, info, tokens))

    return run


def _meet(parts: int):
    """The counts and rarer words of one part -> sums per document; document rows go through."""

    def run(table: pa.Table) -> pa.Table:
        out = [tuple(r.values()) for r in table.filter(pc.equal(table["kind"], _DOCS)).to_pylist()]
        c, w = (table.filter(pc.equal(table["kind"], k)) for k in (_COUNTS, _WORDS))
        h, n = hashing.joined(c["a"]), hashing.joined(c["b"], np.int64)
        order = np.argsort(h)
        h, n = h[order], n[order]
        word = hashing.joined(w["a"])
        owner = np.repeat(hashing.joined(w["b"]), hashing.joined(w["c"], np.uint32))
        at = np.minimum(np.searchsorted(h, word), max(0, len(h) - 1))
        hit = h[at] == word if len(h) else np.zeros(len(word), bool)
        owner, log = owner[hit], np.log10(n[at[hit]] + 1.0)
        key, inverse = np.unique(owner, return_inverse=True)
        known, total = np.bincount(inverse, minlength=len(key)), np.bincount(inverse, log, len(key))
        bucket = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for p, a, b in hashing.pieces(bucket[order]):
            own = order[a:b]
            out.append((p, _WORDS, key[own].tobytes(), known[own].astype(np.int64).tobytes(), total[own].tobytes(), None))
        return _table(out)

    return run


def _finish(tokens: int, kinds: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        d, w = (table.filter(pc.equal(table["kind"], k)) for k in (_DOCS, _WORDS))
        key, info = hashing.joined(d["a"]), np.frombuffer(b"".join(d["b"].to_pylist()), _ROW)
        unique, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        at = np.searchsorted(unique, hashing.joined(w["a"]))
        known = np.bincount(at, hashing.joined(w["b"], np.int64), len(unique)) / times  # a repeated row sent its words again
        log = np.bincount(at, hashing.joined(w["c"], np.float64), len(unique)) / times
        base = info["log"] + log[inverse] - info["n"] * np.log10(tokens + kinds + 1.0)
        cols = [pa.array(info["id"], mask=info["none"]), pa.array(info["held"]), pa.array(info["n"]), pa.array(info["known"] + np.rint(known).astype(np.int64)[inverse]), pa.array(np.full(len(info), tokens)), pa.array(base), pa.array(info["score"])]
        return pa.Table.from_arrays(cols, schema=schema)

    return run


def held_out(key, folds: int = 7, fold: int = 2):
    """Whether crc32 of the key as text falls in the fold; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the documents that are not held out. A null text is empty and has the end token alone; without training
    texts every token is unknown. Words are compared by 64-bit hashes. Rows that repeat keep their own result rows.
    max_bytes decides whether the filter is broadcast; no result depends on it.
    """
    spark = docs.sparkSession
    parts = hashing.parts(docs, text, EACH)
    model, counts, segments = learn(docs.where(~held_out(F.col(key))), text, max_bytes, parts)
    release(spark)  # the n-grams' shuffle files, which are most of the disk, before those of the scores
    shared = spark.sparkContext.broadcast(model)  # at most max_bytes and HEAVY words; without the filter if it is larger
    rows = docs.select(F.xxhash64(key, text).alias("key"), F.col(key).cast("long").alias("id"), held_out(F.col(key)).alias("held"), F.col(text).alias("t"))
    if segments is None:
        scored = rows.mapInArrow(_score(parts, shared), _SCHEMA)
    else:
        asked = cut(rows.mapInArrow(_ask(parts), _SCHEMA), "lm-asked")  # batches are named at random, so they are made once
        answers = asked.where(F.col("kind") == _ASKED).union(segments).groupBy("part").applyInArrow(_answer, _SCHEMA)
        scored = answers.union(asked.where(F.col("kind") == _TEXTS)).groupBy("d").applyInArrow(_answered(parts, shared), _SCHEMA)
    met = scored.union(counts).groupBy("part").applyInArrow(_meet(parts), _SCHEMA)
    return met.groupBy("part").applyInArrow(_finish(model.tokens, model.kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
