from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import ngram_join, queries
from tests.llm.helpers import AWKWARD, docs


def brute(rows, k, num, den):
    """{(doc_id, text): (set size, component)} by comparing all sets that share a shingle."""
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    keys = list(dict.fromkeys(rows))
    sets = [sh(t) for _, t in keys]
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in held[g]:
                shared[j] += 1
            held[g].append(i)
        for j, o in shared.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(keys):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {key: (len(sets[i]), least.get(find(i))) for i, key in enumerate(keys)}


def check(spark, rows, k=4, num=85, den=100):
    d = docs(spark, rows)
    got = ngram_join.components(d, k, num, den).collect()
    want = brute(rows, k, num, den)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((d_, *want[d_, t]) for d_, t in rows), key=str)
    return want


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_query_equals_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in table], 4, 85, 100)
    got = queries.op2_ngram_join(spark, small).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, *v) for (d, _), v in want.items())
    assert any(r.doc_id != r.component_id for r in got)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 60, 100), (2, 100, 100)])
def test_families_at_the_threshold(spark, k, num, den):
    rng = random.Random(k * num)
    rows = []
    for f in range(12):
        base = [f"w{rng.randrange(40 if f % 2 else 4000)}" for _ in range(rng.choice([1, 3, 5, 20, 60, 200]))]
        rows += [(1000 * f + i, family(rng, base, rng.randrange(0, 1 + len(base) // 12))) for i in range(12)]
    rng.shuffle(rows)
    check(spark, rows, k, num, den)


def test_chains_of_links_are_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(50 - i, " ".join(words[3 * i : 3 * i + 100])) for i in range(40)]
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) < 10


def test_hot_shingles_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 400)
    monkeypatch.setattr(ngram_join, "FLAG", 3)
    rng = random.Random(9)
    line = "one very common line of many documents"
    base = [f"b{i}" for i in range(60)]
    rows = [(i, f"{line} {family(rng, base, i % 5)}") for i in range(80)] + [(1000 + i, f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(8))) for i in range(60)]
    rows += [(5000 + i, line) for i in range(30)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    d = docs(spark, AWKWARD).withColumns({"key": F.lit(1), "tokens": F.lit("x"), "n": F.lit(0)})
    got = ngram_join.components(d, 4).collect()
    want = brute(rows, 4, 85, 100)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((i, *want[i, t]) for i, t in rows), key=str)
    assert ngram_join.components(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(3, base), (1, base + " more"), (2, "something else entirely that is long enough"), (9, ""), (9, ""), (7, None)]
    kept = ngram_join.keep_one(docs(spark, rows).withColumn("extra", F.lit(5)))
    assert sorted((r.doc_id, r.extra) for r in kept.collect()) == [(1, 5), (2, 5), (7, 5), (9, 5)]


def test_rows_without_ids_and_of_one_id(spark):
    base = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(None, base), (None, base + " x"), (3, base + " y"), (5, other), (5, base + " z"), (None, other + " q"), (8, "alone of all"), (8, "alone of all"), (None, "alone too it is"), (None, "alone too it is")]
    d = docs(spark, rows).withColumns({"_id": F.lit(1), "row_hash": F.lit(2), "key": F.lit(3), "label": F.lit(4)})
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", base + " y"), ("5", other), ("8", "alone of all"), ("None", "alone too it is")])


def test_tree_finds_what_all_pairs_find():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(2, 40)
        base = sorted(rng.sample(range(60), rng.randrange(1, 30)))
        sets = [np.array(sorted({x for x in base if rng.random() > 0.1} | {rng.randrange(60) for _ in range(rng.randrange(3))} or {0})) for _ in range(n)]
        sizes = [len(s) + rng.randrange(3) for s in sets]
        roots = ngram_join.linked(sets, sizes, 80, 100)
        parent = list(range(n))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(n):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 80 * (sizes[i] + sizes[j] - o):
                    parent[find(i)] = find(j)
        assert [[roots[i] == roots[j] for j in range(n)] for i in range(n)] == [[find(i) == find(j) for j in range(n)] for i in range(n)]


def test_six_byte_blobs():
    from galena.llm import hashing

    x = np.array([0, 1, 2**48 - 1, 12345678901234], np.uint64)
    assert hashing.unpack48([hashing.pack48(x[:1]), None, b"", hashing.pack48(x[1:])]).tolist() == x.tolist()
    assert len(hashing.pack48(x)) == 24 and not len(hashing.unpack48([]))


def test_more_shuffle_partitions_make_no_more_rows(spark, monkeypatch):
    """Every part sends a row to every other part: 2 x 211 parts of a small table sent 178,084 nearly empty rows."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, family(rng, base, i % 3)) for i in range(200)]
    deal, seen = ngram_join._deal, []
    monkeypatch.setattr(ngram_join, "_deal", lambda parts, k: seen.append(parts) or deal(parts, k))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen and seen[0] ** 2 <= sum(len(t) for _, t in rows) / 4096
