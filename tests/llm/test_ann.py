from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import ann, queries


def brute(rows, is_query, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if is_query(q):
            near = sorted({(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in ok if i != q and len(y) == len(x)})
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_query_recall(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, got = brute(rows, lambda i: i % 50 == 0), as_dict(queries.op7_ann(spark, small))
    assert set(got) == set(want) and want
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.98
    for q, near in got.items():
        exact = dict(brute(rows, lambda i, q=q: i == q, len(rows))[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in near)


def test_blocks_ties_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "DATA_BLOCK", 97)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 11)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 32))
    rows = [(i, [float(x) for x in (centres[i % 6] + (0 if i % 4 == 0 else 0.2) * rng.normal(size=32)).astype(np.float32)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = as_dict(ann.search(df, lambda i: i % 50 == 0, 5)), brute(rows, lambda i: i % 50 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def recall(want, got):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) / sum(map(len, want.values()))


def test_lists_and_their_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    is_query = lambda i: i % 20 == 0
    want = brute(rows, is_query)
    lists, n = ann.lists_of(ann.valid(df, "vec_id", "embedding"), 5, rows=50)
    assert n == len(rows) and len(lists.centroids[64]) >= 20
    assert recall(want, as_dict(ann.search(df, is_query, rows=50))) >= 0.95
    every = as_dict(ann.search(df, is_query, recall=1, rows=50))
    assert recall(want, every) >= 0.98


def test_clusters_are_read_in_part(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 48))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.3 * rng.normal(size=48)]) for i in range(4000)] + [(5000 + i, [float(i)]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists, _ = ann.lists_of(ann.valid(df, "vec_id", "embedding"), 5, rows=100)
    assert lists.reads[48] < len(lists.centroids[48]) / 4
    is_query = lambda i: i % 50 == 0
    got = as_dict(ann.search(df, is_query, rows=100))
    assert recall(brute(rows, is_query), got) >= 0.95


def test_equal_vectors_and_ids_of_several_vectors(spark):
    rng = np.random.default_rng(6)
    hot = [float(x) for x in rng.normal(size=8)]
    rows = [(i, hot) for i in range(0, 300)] + [(300 + i, [float(x) for x in rng.normal(size=8)]) for i in range(100)] + [(50, [2 * x + 0.001 for x in hot]), (350, hot), (350, hot), (350, [-x for x in hot])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    is_query = lambda i: i % 50 == 0
    got, want = as_dict(ann.search(df, is_query)), brute(rows, is_query)
    for q in (0, 100, 150, 200, 250, 300):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert [i for i, _ in got[350]] == [0, 1, 2, 3, 4] and [i for i, _ in got[50]][:4] == [0, 1, 2, 3] and len(got[50]) == 5


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.0, 0.0, 0.0]), (1, None), (2, []), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [float("inf"), 1.0, 0.0]), (6, [2.0, 0.0, 0.0]), (7, [-1.0, 0.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (6, [2.0, 0.0, 0.0]), (100, [1.0, 1.0, 0.0]), (9, [3e38, 1e38, 0.0]), (10, [1e-38, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"code": F.lit(1), "score": F.lit(2)})
    got = as_dict(ann.search(df, lambda i: i % 50 == 0, 5))
    assert set(got) == {0, 100}
    assert [i for i, _ in got[0]] == [6, 10, 9, 100, 7] and got[0][0][1] == 1.0
    assert ann.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=64)
    bits, fit = ann.codes(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    v = q / np.linalg.norm(q)
    signs = np.unpackbits(bits, axis=1) * 2.0 - 1
    estimate = signs @ (ann.rotation(64) @ v) / np.sqrt(64) / fit
    bound = ann.EPSILON * np.sqrt((1 - fit**2) / 63) / fit
    assert np.mean(np.abs(estimate - u @ v) <= bound) > 0.99
