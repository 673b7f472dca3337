"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 7).

A unit vector o is rotated; its code keeps the signs, packed in bits, and the scalar <o, code>. For a rotated query q
the estimate of <o, q> is <code, q> / <o, code>, with an error bound from the same scalar. Per query the lower bounds
give a threshold, and every vector whose upper bound reaches it is reranked with its exact cosine in double precision.

Vectors lie in lists around centroids that are fitted on a bounded sample; every vector is in a list. A query reads the
lists nearest to it. How many is chosen on the sample: the fewest that hold RECALL of its nearest neighbours; with 1.0 all
lists are read. So each vector is shuffled once, and a query once per list that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from galena.session import cut

SEED = 20_240_601
#: Width of the error bound in standard deviations of the estimator.
EPSILON = 3.0
QUERY_BLOCK, DATA_BLOCK = 16_384, 65_536
_TILE_QUERIES, _TILE_DATA = 128, 16_384
#: Vectors per list, lists at most, components of the sample, queries of the sample, share of neighbours that the lists read must hold.
LIST, LISTS, SAMPLE, TRIED, RECALL = 4096, 4096, 4_000_000, 512, 0.99


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and the scalar <o, code> of each."""
    turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


@dataclass
class Lists:
    """Unit centroids by length of vector, and how many lists a query of that length reads. Other lengths have one list."""

    centroids: dict[int, np.ndarray] = field(default_factory=dict)
    reads: dict[int, int] = field(default_factory=dict)

    def of(self, units: np.ndarray, most: int = 1) -> np.ndarray:
        """The nearest lists of each unit vector, the nearest first."""
        c = self.centroids.get(units.shape[1])
        if c is None:
            return np.zeros((len(units), 1), np.int32)
        out = np.empty((len(units), most), np.int32)
        for a in range(0, len(units), 4096):
            near = units[a : a + 4096] @ c.T
            out[a : a + 4096] = near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by its largest component first, a vector's square neither overflows nor vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int, k: int, recall: float = RECALL, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Centroids of unit vectors by spherical k-means, and the lists to read for so much recall of the sample's k nearest."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.permutation(len(sample))[:lists]]
    own = Lists({sample.shape[1]: c})
    for _ in range(rounds):
        at = own.of(sample)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
        own.centroids[sample.shape[1]] = c
    if recall >= 1:
        return c, len(c)
    at = own.of(sample)[:, 0]
    pick = rng.permutation(len(sample))[:TRIED]
    place = np.empty((len(pick), len(c)), np.int64)  # of each list in the order that a query reads them
    np.put_along_axis(place, own.of(sample[pick], len(c)).astype(np.int64), np.arange(len(c))[None, :], axis=1)
    needed = []
    for j, i in enumerate(pick.tolist()):
        near = sample @ sample[i]
        near[i] = -np.inf
        needed.append(place[j, at[np.argpartition(-near, min(k, len(near) - 1))[:k]]])
    return c, int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


def valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id long, v array<float or double>): null ids, null or empty vectors and those with null components take no part."""
    kind = df.schema[embedding].dataType
    v = F.col(embedding) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(embedding).cast("array<double>")
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return d.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def lists_of(vectors: DataFrame, k: int, recall: float = RECALL, rows: int = LIST) -> tuple[Lists, int]:
    """Lists fitted on a sample of at most SAMPLE components, the smallest hashes of id and vector, and the number of vectors."""
    total = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    wanted = min(LISTS, total.n // rows)
    out = Lists()
    if wanted < 2:
        return out, total.n
    sample = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(max(64, SAMPLE // total.d)).select("v").toArrow().column("v").combine_chunks()
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v.values), []).append(v.values.to_numpy(zero_copy_only=False).astype(np.float64))
    for dims, own in by.items():
        m = min(wanted * len(own) // len(sample), len(own) // 8)
        if m > 1:
            out.centroids[dims], out.reads[dims] = fit(_unit(np.stack(own)), m, k, recall)
    return out, total.n


def encode(vectors: DataFrame, lists) -> DataFrame:
    """(vec_id, dims, same binary, cell, v, code, fit) of valid() vectors: same names the vector, cell its list."""
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    item = pa.float32() if kind == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                rows.setdefault(len(x), []).append((i, x + 0))  # -0 is 0
            for dims, own in rows.items():
                ids, raw = [i for i, _ in own], np.stack([x for _, x in own])
                units = _unit(raw.astype(np.float64))
                bits, fits = codes(units)
                same = [blake2b(x.tobytes(), digest_size=16).digest() for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([dims] * len(ids), pa.int32()), pa.array(same, pa.binary()), pa.array(lists.value.of(units)[:, 0], pa.int32()), pa.array(list(raw), pa.list_(item)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(fits)],
                    ["vec_id", "dims", "same", "cell", "v", "code", "fit"],
                )

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id long, dims int, same binary, cell int, v array<{kind}>, code binary, fit double")


def _matrix(table: pa.Table) -> np.ndarray:
    x = np.stack([np.asarray(v.values) for v in table.column("v").combine_chunks()]).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def search_block(queries: pa.Table, data: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, vec ids, cosines): the k nearest rows of one data block for each query of one query block."""
    did = np.asarray(data.column("vec_id"))
    q, d = _matrix(queries), _matrix(data)
    qn, dn = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
    dims = q.shape[1]
    turned = ((q / qn[:, None]) @ rotation(dims).T).astype(np.float32)
    packed = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(did), -1)
    fits = np.asarray(data.column("fit"))
    bound = (EPSILON * np.sqrt(np.maximum(0.0, 1 - fits**2) / max(1, dims - 1)) / fits).astype(np.float32) + np.float32(1e-5)
    scale = (1 / (fits * np.sqrt(dims))).astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), _TILE_QUERIES):
        own = slice(a, a + _TILE_QUERIES)
        best = np.full((len(q[own]), k), -np.inf, np.float32)
        kept: list = []
        for b in range(0, len(did), _TILE_DATA):
            part = slice(b, b + _TILE_DATA)
            signs = np.unpackbits(packed[part], axis=1, count=dims).astype(np.float32) * 2 - 1
            estimate = (turned[own] @ signs.T) * scale[part]
            low = np.concatenate([best, estimate - bound[part]], axis=1)
            best = -np.partition(-low, k - 1, axis=1)[:, :k]
            i, j = np.nonzero(estimate + bound[part] >= best.min(axis=1)[:, None])
            kept.append((i, j + b, (estimate + bound[part])[i, j]))
        i, j, high = (np.concatenate(x) for x in zip(*kept, strict=True))
        real = high >= best.min(axis=1)[i]
        i, j = i[real], j[real]
        score = np.empty(len(i))
        for c in range(0, len(i), 1 << 17):
            s = slice(c, c + (1 << 17))
            score[s] = np.einsum("nd,nd->n", q[own][i[s]], d[j[s]]) / (qn[own][i[s]] * dn[j[s]])
        order = np.lexsort((did[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[top] + a, did[j[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, rows: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query row, nearest first, ties to the smaller id.

    is_query: a predicate on the id column. recall=1 reads all lists. Null ids, vectors that are null, empty or zero and
    those with null or non-finite components take no part. Vectors of another length than the query's aren't its
    candidates; a row with the query's own id never is. Rows equal in id and vector count once; an id's other vectors are
    rows of their own, and a query id with several vectors takes the nearest to any of them. Equal vectors are searched
    for once, and only the k + 1 smallest ids of equal vectors (more, if a query id has more vectors) are candidates, as no
    others can be among k nearest. A large
    list is split into blocks: a task holds at most a few times QUERY_BLOCK + DATA_BLOCK vectors. An empty table gives an
    empty result; other columns are not read.
    """
    spark = df.sparkSession
    vectors = valid(df, vec_id, embedding)
    lists, _ = lists_of(vectors, k, recall, rows)
    shared = spark.sparkContext.broadcast(lists)  # at most LISTS centroids of a length
    coded = cut(encode(vectors, shared), "codes")

    asked = coded.where(is_query(F.col("vec_id"))).select("same", F.col("vec_id").alias("query_id"), "dims", "v").dropDuplicates(["same", "query_id"])
    most = k + (asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1)  # what is found besides a query's own vectors
    many = cut(coded.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"), "equal")
    again = coded.join(many, "same", "left_semi").select("same", "vec_id").groupBy("same", "vec_id").agg(F.lit(1).alias("one"))
    again = again.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("r") <= most).select("same", "vec_id")
    one = coded.join(many, "same", "left_semi").groupBy("same").agg(*[F.any_value(c).alias(c) for c in ("dims", "cell", "v", "code", "fit")])
    columns = ["dims", "cell", "vec_id", "v", "code", "fit"]
    data = coded.join(many, "same", "left_anti").select(*columns).unionByName(again.join(one, "same").select(*columns))

    kind = coded.schema["v"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for v in batch.column("v"):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)[None, :]
                near.append(shared.value.of(_unit(x), shared.value.reads.get(x.shape[1], 1))[0].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("same", "dims", "v")), pa.array(near, pa.list_(pa.int32()))], ["same", "dims", "v", "cells"])

    classes = asked.dropDuplicates(["same"]).select("same", "dims", "v").mapInArrow(read, f"same binary, dims int, v array<{kind}>, cells array<int>")
    classes = cut(classes.select("same", "dims", "v", F.explode("cells").alias("cell")), "asked")
    blocks = lambda side, size, name: side.groupBy("dims", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(cut(blocks(data, DATA_BLOCK, "dn").join(blocks(classes, QUERY_BLOCK, "qn"), ["dims", "cell"]), "blocks"))  # a row per list
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda salt, column, n: F.pmod(F.xxhash64(F.lit(salt), column), F.col(n)).cast("int")
    keys = ["dims", "cell", "qb", "db"]
    left = classes.join(sizes, ["dims", "cell"]).select("dims", "cell", pick("q", "same", "qn").alias("qb"), numbers("dn").alias("db"), "same", "v")
    right = data.join(sizes, ["dims", "cell"]).select("dims", "cell", numbers("qn").alias("qb"), pick("d", "vec_id", "dn").alias("db"), "vec_id", "v", "code", "fit")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = search_block(a, b, most) if len(a) and len(b) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"same": a.column("same").combine_chunks().take(pa.array(found[0])) if len(a) else pa.array([], pa.binary()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "same binary, vec_id long, score double")
    order = Window.partitionBy("same").orderBy(F.desc("score"), "vec_id")
    near = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    found = asked.select("same", "query_id").join(near, "same").where("query_id <> vec_id").select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
