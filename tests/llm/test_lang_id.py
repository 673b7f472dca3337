from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galena.llm import lang_id, queries
from tests.llm.helpers import AWKWARD, docs


def slow_bits(train: list[bytes], text: bytes, alphabet: set[int]) -> float:
    """Code length by the escape chain, context by context."""
    seen = [Counter() for _ in range(4)]
    after = [{} for _ in range(4)]
    for t in train:
        t = bytes(3) + t
        for i in range(3, len(t)):
            for k in range(4):
                c = t[i - k : i]
                seen[k][c, t[i]] += 1
                after[k].setdefault(c, set()).add(t[i])
    total = [Counter() for _ in range(4)]
    for k in range(4):
        for (c, _), n in seen[k].items():
            total[k][c] += n

    def p(k, c, s):
        if k < 0:
            return 1 / 256
        n, d = total[k][c], len(after[k].get(c, ()))
        if not n:
            return p(k - 1, c[1:], s)
        hit = seen[k][c, s]
        return hit / (n + d) if hit else d / (n + d) * p(k - 1, c[1:], s)

    code = lambda b: b if b in alphabet else 0
    t = bytes(3) + text
    return -sum(math.log2(p(3, bytes(code(x) for x in t[i - 3 : i]), code(t[i]))) for i in range(3, len(t)))


def test_costs_equal_the_escape_chain():
    train = {"a": [b"abracadabra abra", b"cad abra"], "b": [b"mississippi miss", b"is sip"]}
    model = lang_id.build({k: lang_id.grams(v) for k, v in train.items()})
    alphabet = set(b"".join(x for v in train.values() for x in v))
    for text in (b"abra", b"miss abra", b"zzz", b"a", b"sipcad\xff"):
        got = model.lengths([text])[0]
        for j, lang in enumerate(model.languages):
            assert got[j] == pytest.approx(slow_bits(train[lang], text, alphabet), rel=1e-5)


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = {r.doc_id: r for r in queries.op4_lang_id(spark, sf).collect()}
    assert len(got) == len(d)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in d)
    held = [r for r in d if got[r.doc_id].held_out and r.lang]
    assert held and sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_is_learned_from_held_out_rows(spark):
    text = {"x": "zq zq zq", "y": "ba ba ba"}
    rows = [(i, text["x" if zlib.crc32(str(i).encode()) % 5 else "y"], "x" if zlib.crc32(str(i).encode()) % 5 else "y") for i in range(40)]
    assert {r.lang_pred for r in lang_id.identify(docs(spark, rows)).collect()} == {"x"}


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD).withColumns({"score": F.lit("mine"), "_g": F.lit(1), "guess": F.lit(2)})
    rows = lang_id.identify(d).collect()
    assert {(r._g, r.guess) for r in rows} == {(1, 2)}
    assert len(rows) == len(AWKWARD)
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (lettered or r.score == 0)
    assert lang_id.identify(docs(spark, [])).count() == 0
    alone = lang_id.identify(docs(spark, [(i, "abc", None) for i in range(9)])).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def test_sample_bound(spark):
    rows = [(i, f"aa{i}", "x") for i in range(50)]
    model = lang_id.train(docs(spark, rows), rows=3)
    assert model.languages == ["x"]
    # rows that repeat an id, or all of it, don't widen the sample: equal rows count once
    assert lang_id.train(docs(spark, [(1, "aaaa", "x")] * 40 + [(1, "aaab", "x")]), rows=2).cost.shape == lang_id.train(docs(spark, [(1, "aaaa", "x"), (1, "aaab", "x")]), rows=2).cost.shape


def test_every_label_is_learned(spark):
    text = [f"{a}{b} " * 6 for a in "abcdefghij" for b in "klmnopq"]
    rows = [(100 * j + i, t, f"l{j:02}") for j, t in enumerate(text) for i in range(4 if j < 64 else 2)]
    d = docs(spark, rows)
    model = lang_id.train(d)
    assert model.languages == [f"l{j:02}" for j in range(70)]
    got = d.withColumn("g", lang_id.predict(F.col("text"), model, spark)).collect()
    assert all(r.g.lang == r.lang for r in got)


def test_a_window_of_a_label_is_one_row(spark):
    """The rows counted don't grow with the parts that the sample came in."""
    texts = [("a", "one two three"), ("b", "uno due tre"), ("a", "two three four")] * 30
    sample = spark.createDataFrame(texts, "l string, t string").repartition(30)
    got = [tuple(r) for r in lang_id.window_counts(sample).collect()]
    want = {}
    for name in "ab":
        k, n = lang_id.grams([t.encode() for own, t in texts if own == name])
        want |= {(name, x): c for x, c in zip(k.tolist(), n.tolist(), strict=True)}
    assert len(got) == len(want) and {(name, k): n for name, k, n in got} == want
