from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from galena.llm import mixing, queries
from tests.llm.helpers import AWKWARD, docs
from tests.oracle import compare


def test_query_equals_sql(spark, small):
    rows, unlike = compare(queries.op6_mixing(spark, small), queries.ORACLES["op6_mixing"], small)
    assert rows and not unlike


def slow_targets(sizes: dict, weights=(5, 2, 1)):
    """Fill by rounds: share what is left among the free sources until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_targets_and_takes(spark):
    sources = ["b", "a", "é", None, "z", "B", "tiny", "hot"]
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", "hot" if i % 3 == 0 else sources[i % 7]) for i in range(900)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    name = {r[0]: r[3] for r in rows}
    for r in got:
        by[name[r.key]].append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    want = slow_targets({s: sum(x.size for x in v) for s, v in by.items()})
    for s, v in by.items():
        assert v[0].target == pytest.approx(want[s])
        assert abs(sum(x.taken for x in v) - v[0].target) <= max(x.size for x in v)


def test_schedule_moves_sources_in_time(spark):
    rows = [(i, "w w w w", "en", "early" if i % 2 else "late") for i in range(2000)]
    got = mixing.mix(docs(spark, rows), weights=(1,), schedule=((3.0, 0.0), (0.0, 3.0)))  # early, late
    mean = lambda odd: got.where(F.col("key") % 2 == odd).select(F.explode("positions").alias("p")).agg(F.avg("p")).first()[0]
    assert mean(1) == pytest.approx(1 / 3, abs=0.03) and mean(0) == pytest.approx(2 / 3, abs=0.03)


def test_training_order(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}") for i in range(60)] + [(None, "no id", "en", None), (None, "no id", "en", None)]
    d = docs(spark, rows).withColumn("key", F.lit("mine"))
    out = mixing.training_order(d)
    assert out.columns == d.columns
    first, again = ([tuple(r) for r in mixing.training_order(d).collect()] for _ in range(2))
    assert first == again
    plan = mixing.mix(d).agg(F.sum("copies")).first()[0]
    assert len(first) == plan


def test_rows_of_one_key_keep_their_own_copies(spark):
    rows = [(1, "six words of the first source", "en", "a"), (1, "six words of the other source", "en", "b"), (1, "six words of the other source", "en", "b")]
    rows += [(i, "some more words here for both " * 3, "en", "ab"[i % 2]) for i in range(2, 40)]
    d = docs(spark, rows).withColumns({"row": F.lit(1), "positions": F.lit("p"), "h": F.lit("h"), "a.b": F.lit("dot")})
    out = mixing.training_order(d)
    assert out.columns == d.columns
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    of = {r.source: r.n for r in d.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert of["a"] != of["b"]  # a source is known by its size below
    planned = {r.source_size: r.n for r in mixing.mix(d).groupBy("source_size").agg(F.sum("copies").alias("n")).collect()}
    assert got == {s: planned[n] for s, n in of.items()}


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD).withColumns({"size": F.lit("x"), "target": F.lit(1)})
    got = mixing.mix(d).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(docs(spark, [])).count() == 0
    empty = mixing.mix(docs(spark, [(1, ""), (2, None)])).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in empty} == {(0, 0, 0.0, 0)}
