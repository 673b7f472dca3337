from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import suffix_dedup as D
from galena.llm import queries
from tests.llm.helpers import AWKWARD, docs


def brute(rows, length):
    """{doc_id: (bytes, removed, spans, kept)} of distinct ids, null last: strings seen before in order."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def check(spark, rows, length=100):
    got = D.dedup(docs(spark, rows), length).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    return want


def test_query_equals_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in table], 100)
    for r in queries.op3_suffix_dedup(spark, small).collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("common", [12, 2])
@pytest.mark.parametrize("length", [100, 64])
def test_planted_passages(spark, monkeypatch, length, common):
    monkeypatch.setattr(D, "COMMON", common)
    rng = random.Random(length)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [noise(n) for n in (length - 1, length, length + 1, 150, 400)]
    rows = []
    for i in range(60):
        text = noise(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 4)):
            text += rng.choice(passages) + noise(rng.randrange(0, 60))
        rows.append((i, text))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    rng.shuffle(rows)
    check(spark, rows, length)


def test_runs_within_one_text(spark):
    check(spark, [(1, "a" * 1000), (2, "ab" * 300), (3, "xyz " * 200), (4, "a" * 99), (5, "a" * 100), (6, "abcdefghij" * 15 + "q" + "abcdefghij" * 15), (7, "ba" * 130)])


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD).withColumns({"kept": F.lit("mine"), "gone": F.lit(1), "_other": F.lit(2), "_key": F.lit(3), "_gone": F.lit(4), "_r": F.lit(5), "place": F.lit(6), "Own": F.lit(7)})
    assert set(D.dedup(d).columns) == {*d.columns, "n_bytes", "n_removed", "n_spans"}
    assert {(r._key, r._gone, r._r, r.place, r.Own) for r in D.without_repeats(d).collect()} == {(3, 4, 5, 6, 7)}
    got = D.dedup(d).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text), []).append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert all(len(set(v)) == 1 for v in by.values())
    assert by[6, "x" * 20_000][0][1:3] == (19_999, 1) and by[1, ""][0] == (0, 0, 0, b"")
    assert D.dedup(docs(spark, [])).count() == 0


def test_null_ids_come_last(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(150))
    got = {r.doc_id: r.n_removed for r in D.dedup(docs(spark, [(None, text), (9, text + "!")])).collect()}
    assert got == {9: 0, None: 150}


def test_factor_arrays():
    rng = np.random.default_rng(3)
    for _ in range(20):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        at = np.arange(len(data) - 8 + 1)
        got = D.previous_factors(data, at, 8)
        seen, want = set(), []
        for a in at:
            w = bytes(data[a : a + 8])
            want.append(w in seen)
            seen.add(w)
        assert got.tolist() == want
    x = rng.permutation(500)
    assert D.nearest_smaller(x).tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(500)]


def test_repeated_rows_that_overlap_others_count_once(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [noise(180) for _ in range(4)]
    rows = [(i, noise(150) + rng.choice(shared) + noise(150) + rng.choice(shared) + noise(20)) for i in range(12)]
    rows.append((50, noise(60) + rows[0][1][40:260] + noise(60)))
    repeats = [rows[0], rows[3], rows[3], rows[7], rows[-1]]
    want = check(spark, rows)
    got = D.dedup(docs(spark, [*rows, *repeats]).repartition(3), 100).collect()
    assert len(got) == len(rows) + len(repeats)
    assert all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in got)
