"""Language identification by prediction by partial matching (operator 4).

Per language a byte context tree up to `order` contexts is learned from a bounded sample of labelled rows and frozen.
A byte's code length under a language follows the escape chain: seen after the context n times of N with d distinct
followers costs n/(N+d); an escape costs d/(N+d) and goes on with the next shorter context, at last 1/256 a byte.
With frozen trees a byte's cost depends on its context alone, so every tree state has a table of exact costs, and a
text's code length is a sum of table look-ups over its whole bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm import hashing

ORDER = 3
#: The bound of the training sample: rows per language, in the order of a hash of the key. Every label is learned.
ROWS_PER_LANGUAGE = 400
UNKNOWN = "und"


@dataclass
class Model:
    """codes: byte -> symbol (0: start of text and bytes never learned). deep: key of three context symbols -> state.
    cost: bits, [state * width + symbol, language]; the first width**2 states have two context symbols."""

    languages: list[str]
    codes: np.ndarray
    width: int
    deep: np.ndarray
    cost: np.ndarray

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each non-empty text under each language."""
        pad = bytes(ORDER)
        sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
        sym = self.codes[raw]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        sym[(starts[:, None] + np.arange(ORDER)).ravel()] = 0
        key = (sym[:-3] * self.width + sym[1:-2]) * self.width + sym[2:-1]
        at = self.deep[key] * self.width + sym[3:]
        out = np.empty((len(texts), len(self.languages)))
        step = 1 << 20
        for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            n -= ORDER
            out[i] = sum(self.cost[at[a : min(a + step, s + n)]].sum(axis=0, dtype=np.float64) for a in range(s, s + n, step))
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its posterior under equal priors."""
        bits = self.lengths(texts)
        best = bits.argmin(axis=1)
        gap = np.minimum((bits - bits.min(axis=1, keepdims=True)), 1000.0)
        return best, 1.0 / np.exp2(-gap).sum(axis=1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the windows of ORDER+1 bytes, the start of a text padded with zero bytes, as 32-bit keys."""
    parts = []
    for t in texts:
        raw = np.frombuffer(bytes(ORDER) + t, np.uint8).astype(np.uint32)
        parts.append((raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:])
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Freeze the trees of all languages from counts of byte windows."""
    languages = sorted(counts)
    seen = np.unique(np.concatenate([np.unique(k >> np.uint32(8 * j) & np.uint32(255)) for k, _ in counts.values() for j in range(4)] or [np.zeros(0, np.uint32)]))
    seen = seen[seen != 0]
    codes = np.zeros(256, np.int64)
    codes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    tables = {}
    for lang, (k, n) in counts.items():
        s = [codes[(k >> np.uint32(8 * j)) & np.uint32(255)] for j in (3, 2, 1, 0)]
        tables[lang] = (((s[0] * width + s[1]) * width + s[2]) * width + s[3], n.astype(np.float64))
    contexts = np.unique(np.concatenate([t // width for t, _ in tables.values()] or [np.zeros(0, np.int64)]))
    deep = np.arange(width**3, dtype=np.int32) % width**2
    deep[contexts] = width**2 + np.arange(len(contexts))
    cost = np.empty(((width**2 + len(contexts)) * width, len(languages)), np.float32)

    def level(below: np.ndarray, key: np.ndarray, n: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Probabilities of every symbol after the contexts ctx (sorted keys); below: those after the shorter contexts."""
        whole, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, n)
        owner = np.searchsorted(ctx, whole // width)
        size, kinds = np.bincount(owner, total, len(ctx)), np.bincount(owner, minlength=len(ctx))
        p = below * np.where(size > 0, kinds / np.maximum(size + kinds, 1), 1.0)[:, None]
        p[owner, whole % width] = total / (size + kinds)[owner]
        return p

    for j, lang in enumerate(languages):
        key, n = tables[lang]
        p0 = level(np.full((1, width), 1 / 256), key % width, n, np.zeros(1, np.int64))
        p1 = level(np.repeat(p0, width, 0), key % width**2, n, np.arange(width))
        p2 = level(np.tile(p1, (width, 1)), key % width**3, n, np.arange(width**2))
        p3 = level(p2[contexts % width**2], key, n, contexts)
        cost[:, j] = -np.log2(np.concatenate([p2, p3]).ravel())
    return Model(languages, codes, width, deep, cost)


def window_counts(sample: DataFrame) -> DataFrame:
    """(l, k, n): the windows of each label's texts (l, t) and how often they occur, a row per label and window.

    A label's bounded sample is counted in one stream, so that the rows don't grow with the parts that it came in.
    """
    schema = pa.schema([("l", pa.string()), ("k", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys, times = None, np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

        for batch in batches:
            labels, texts = (c.to_pylist() for c in batch.columns)
            for own, rows in groupby(range(len(labels)), labels.__getitem__):
                if own != name:
                    if len(keys):
                        yield out()
                    name, keys, times = own, np.zeros(0, np.uint32), np.zeros(0, np.int64)
                k, n = grams([texts[i].encode() for i in rows])
                keys, at = np.unique(np.r_[keys, k], return_inverse=True)
                times = np.bincount(at, np.r_[times, n], len(keys)).astype(np.int64)
        if len(keys):
            yield out()

    return sample.repartition("l").sortWithinPartitions("l").mapInArrow(run, "l string, k long, n long")


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on at most `rows` whole texts of each language; every label is one.

    Rows with a null text, lang or an empty text are left out. The sample is the smallest hashes of key and text, so reruns
    agree; rows equal in both count once. Only window counts (at most the distinct 4-byte windows of the sample) come to the
    driver.
    """
    known = labelled.where(F.col(text).isNotNull() & (F.length(text) > 0) & F.col(lang).isNotNull())
    known = known.select(F.xxhash64(key, text).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    labels = known.groupBy("l").agg(F.approx_count_distinct("k").alias("c"))
    # a language's smallest hashes lie far below this share of all hashes (of its distinct rows), so that few rows are ordered at any size
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 40))
    near = known.select("k", "l", place.alias("h")).join(F.broadcast(labels), "l").where(F.col("h") <= F.lit(float(1 << 40)) * (8 * rows) / F.col("c"))
    order = Window.partitionBy("l").orderBy("h", "k")
    ids = near.dropDuplicates(["k", "l"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows)
    sample = known.join(F.broadcast(ids.select("k", "l")), ["k", "l"], "left_semi").dropDuplicates(["k", "l"])  # `rows` a label

    counted = window_counts(sample.select("l", "t")).toPandas()
    if counted.empty:
        return build({})
    return build({name: (own["k"].to_numpy(np.uint32), own["n"].to_numpy(np.int64)) for name, own in counted.groupby("l")})


def predict(text: Column, model: Model, spark) -> Column:
    """struct<lang: string, score: double> of each whole text; `und` with score 0 for null, for no letter, or for a model without languages."""
    shared = spark.sparkContext.broadcast(model)  # a tree per label, each of a bounded sample

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for array in batches:
            langs = np.full(len(array), UNKNOWN, object)
            scores = np.zeros(len(array))
            raw = [t.encode() if t else b"" for t in array.to_pylist()]
            some = [i for i, t in enumerate(raw) if t] if own.languages else []
            for at in range(0, len(some), 512):
                pick = some[at : at + 512]
                best, score = own.predict([raw[i] for i in pick])
                langs[pick] = np.array(own.languages, object)[best]
                scores[pick] = score
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])
        hashing.trim()

    lettered = F.when(text.rlike(r"\p{L}"), text)
    return run.asNondeterministic()(lettered)  # evaluated once, also below a filter


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the key as text falls in the fold; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """docs with held_out, lang_pred and score; learned from the labelled rows that are not held out. Columns of these names are replaced."""
    model = train(docs.where(~held_out(F.col(key))), key, text, lang, rows)
    own = hashing.free(docs, "guess")
    guess = docs.withColumn(own, predict(F.col(text), model, docs.sparkSession))
    return guess.withColumns({"held_out": held_out(F.col(key)), "lang_pred": F.col(own).getField("lang"), "score": F.col(own).getField("score")}).drop(own)
