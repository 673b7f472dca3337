from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import lm_score, queries
from galena.session import release
from tests.llm.helpers import AWKWARD, docs


def brute(rows):
    """{(doc_id, text): (tokens, known, base score)} and N by counting words in a dictionary."""
    words = {(i, t): [*(t or "").encode().lower().split(), None] for i, t in rows}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words[i, t])
    n, v = sum(c.values()), len(c)
    return {k: (held(k[0]), len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, w in words.items()}, n


def check(rows, got):
    want, n = brute(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(want[i, t])
    assert len(got) == len(rows)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known) == w[:3] and r.base_score == pytest.approx(w[3], rel=1e-9) for w in by[r.doc_id])
        assert r.train_tokens == n and r.score <= 0


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op8_lm_score(spark, small).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_and_heavy_words_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAVY", 5)
    rows = [(i, f"the word{i % 9} the rare{i} Rare{i} the") for i in range(120)]
    check(rows, lm_score.score(docs(spark, rows)).collect())


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD).withColumns({"score": F.lit("x"), "key": F.lit(0)})
    check([(r[0], r[1]) for r in AWKWARD], lm_score.score(d).collect())
    assert lm_score.score(docs(spark, [])).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.score(docs(spark, [(alone, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_filter_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rng.geometric(0.3, 20_000)
    bits = lm_score.segment(h, counts)
    model = lm_score.Model(bits, np.array([0, len(bits)]), 1, 1, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got, want = model.probe(h), lm_score.levels(counts)
    assert (got >= want).all() and (got == want).mean() > 0.9
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (model.probe(other) > 0).mean() < 0.06
    assert lm_score.estimate(np.array([0, 1, 2, 3])).tolist() == [0.0, 1.0, 2.5, 5.5]


@pytest.mark.parametrize("n", [0, 1, 5000, 300_000])
def test_a_filter_grows_with_its_entries(n):
    h = np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = lm_score.segment(h, np.ones(n, np.int64))
    model = lm_score.Model(bits, np.array([0, len(bits)]), 1, 1, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert 64 * len(bits) >= lm_score.BITS * n and (model.probe(h) >= 1).all()


def dictionary_scores(rows):
    """{(doc_id, text): log10 probability} from dictionaries of the training texts' exact counts, quantised, token by token."""
    words = {(i, t): [*(t or "").encode().lower().split(), None] for i, t in rows}
    train = [words[i, t] for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    grams = Counter(("^", *w)[max(0, j - n + 1) : j + 1] if n > 1 else (w[j - 1],) for w in train for n in (1, 2, 3) for j in range(1, len(w) + 1) if n < 3 or j > 1)
    quantised = lambda g: (3 * 2.0 ** math.floor(math.log2(grams[g])) - 1) / 2 if grams[g] >= (2 if len(g) == 3 else 1) else 0.0
    tokens = sum(map(len, train))
    kinds = len({w for x in train for w in x})
    out = {}
    for k, w in words.items():
        total, line = 0.0, ("^", *w)
        for j in range(1, len(line)):
            p = min(1.0, (quantised(line[j : j + 1]) + 1) / (tokens + kinds + 1))
            both = quantised(line[j - 1 : j + 1])
            context = float(len(train)) if j == 1 else quantised(line[j - 1 : j])
            for order, seen in enumerate((both, quantised(line[j - 2 : j + 1]) if j > 1 and both else 0.0)):
                if order:
                    context = quantised(line[j - 2 : j]) if j > 1 else 0.0
                share = lm_score.WEIGHTS[order] * context / (context + lm_score.HALVES[order])
                p = share * min(1.0, seen / max(context, 1.0)) + (1 - share) * p
            total += math.log10(p)
        out[k] = total
    return out


def test_scores_equal_those_of_a_dictionary_within_the_filters_error(spark, small, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: s for (i, _), s in dictionary_scores(rows).items()}
    got = queries.op8_lm_score(spark, small).collect()
    apart = [abs(r.score - want[r.doc_id]) / r.n_tokens for r in got]
    assert np.mean(apart) < 0.05 and np.quantile(apart, 0.95) < 0.15  # tokens that pass the filter by mistake
    assert np.mean([r.score >= want[r.doc_id] - 1e-6 for r in got]) > 0.7  # mistakes mostly raise counts
    monkeypatch.setattr(lm_score, "BITS", 256)  # hardly any mistakes
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    memo = lm_score.hashing.WordHash()
    tokens, starts = lm_score._tokens(train, memo)
    counted = [np.unique(x, return_counts=True) for x in (tokens, *lm_score.bigrams(tokens, starts))]
    kept = [(h[c >= least], c[c >= least]) for (h, c), least in zip(counted, (1, 1, 2), strict=True)]
    bits = lm_score.segment(*(np.concatenate(x) for x in zip(*kept, strict=True)))
    model = lm_score.Model(bits, np.array([0, len(bits)]), len(tokens), len(counted[0][0]), len(train), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert model.scores(*lm_score._tokens([t for _, t in rows], memo)) == pytest.approx([want[i] for i, _ in rows], rel=1e-4)


def test_probabilities_stay_below_one(spark):
    rows = [(i, "a") for i in range(60)] + [(100 + i, "") for i in range(3)]
    assert all(r.score <= 0 for r in lm_score.score(docs(spark, rows)).collect())


def test_a_filter_over_its_bound_gives_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 300)
    rows = [(i, " ".join(f"w{i * j % 997}" for j in range(i % 60))) for i in range(1, 200)] + [(r[0], r[1]) for r in AWKWARD]
    d = docs(spark, rows)
    get = lambda **k: sorted(map(tuple, lm_score.score(d, **k).collect()), key=repr)
    got = lm_score.score(d, max_bytes=64).collect()
    check(rows, got)
    assert sorted(map(tuple, got), key=repr) == get()


def test_shuffle_files_are_released_between_learning_and_scoring(spark, monkeypatch):
    """F1: the n-grams' shuffle files and those of the scores need not fit on the disks together. When the driver's garbage
    collector runs on its own is left to it, so the order is tested, not the files."""
    seen, learn = [], lm_score.learn
    monkeypatch.setattr(lm_score, "learn", lambda *a, **k: (learn(*a, **k), seen.append("learnt"))[0])
    monkeypatch.setattr(lm_score, "release", lambda own: (release(own), seen.append("released")))
    scored = lm_score.score(spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id long, text string"))
    assert seen == ["learnt", "released"] and scored.count() == 50
