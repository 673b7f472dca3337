from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from galena.llm import fingerprint as P
from galena.llm import queries
from tests.llm.helpers import AWKWARD, docs


def slow_embed(text: str):
    """One text, step by step."""
    table, steps, _ = P._walk()
    if not text:
        return 0, b""
    s, at, t, bits = [*P.symbols(text).tolist(), P.END], 0, 0, []
    wanted = set(steps[steps < 40 * len(text) + 64].tolist())
    while True:
        for _ in range(P.STRIDE):
            v = int(table[t % P.PERIOD, s[at]])
            if t in wanted:
                bits.append(v >> 1)
            at += v & 1
            t += 1
        if s[at] == P.END:
            return t, np.packbits(np.array(bits, np.uint8)).tobytes()


def slow_rows(rows):
    """{(id, text): (edited, fingerprints, likeness)} in descending order of id, null last, ties by text."""
    chain = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, n) in zip(chain, [*chain[1:], chain[0]], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        a, b, c = slow_embed(t), slow_embed(e), slow_embed(n)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P.show(a), P.show(b), round(P.likeness(a, b), 9), round(P.likeness(a, c), 9)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, len(r.text), hashlib.sha256(r.edited.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_walks_in_step_equal_single_walks():
    rng = random.Random(0)
    texts = ["", "a", "ab" * 40, "é漢😀"] + ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    assert P.embed(texts) == [slow_embed(t) for t in texts]
    assert P.embed_all(texts) == P.embed(texts)


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in queries.op10_fingerprint(spark, small).collect()), key=str)
    assert got == slow_rows(rows)
    assert sum(g[5] > g[6] for g in got) / len(got) > 0.9


def test_parts_and_batches_join_up(spark):
    rng = random.Random(3)
    rows = [(i * i % 977, "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 80)))) for i in range(150)]
    assert result(P.compare_with_next(docs(spark, rows), rows=13)) == slow_rows(rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    d = docs(spark, AWKWARD).withColumns({"part": F.lit(1), "edited": F.lit("x")})
    assert result(P.compare_with_next(d, rows=3)) == slow_rows(rows)
    assert P.compare_with_next(docs(spark, [])).count() == 0
    assert result(P.compare_with_next(docs(spark, [(5, "alone")]))) == slow_rows([(5, "alone")])


def test_likeness_falls_with_edits():
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    near = []
    for edits in (0, 4, 40, 400):
        x = list(base)
        for _ in range(edits):
            at = rng.randrange(len(x))
            kind = rng.randrange(3)
            if kind == 0:
                x[at] = rng.choice("xyz")
            elif kind == 1:
                x.insert(at, rng.choice("xyz"))
            else:
                del x[at]
        near.append(P.likeness(P.embed([base])[0], P.embed(["".join(x)])[0]))
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3]


def brute_groups(prints: dict, at_least: float = 0.8):
    """{id: smallest id of its group} over all pairs of likeness at_least or more, and those pairs of unlike fingerprints."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, links = sorted(prints), []
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if prints[a] != "0:" != prints[b] and (prints[a] == prints[b] or P.likeness(P.parse(prints[a]), P.parse(prints[b])) >= at_least):
                parent[max(find(a), find(b))] = min(find(a), find(b))
                if prints[a] != prints[b]:
                    links.append((b, a))
    return {i: find(i) for i in ids}, links


def groups(spark, prints: dict):
    d = spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint string")
    found = P.near_duplicates(d)
    return {r.doc_id: r.near_id if r.near_id is not None else r.doc_id for r in d.withColumn("c", F.xxhash64("fingerprint")).join(found, "c", "left").collect()}


def typed(rng, text: str, edits: int) -> str:
    x = list(text)
    for _ in range(edits):
        at = rng.randrange(len(x))
        x[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
    return "".join(x)


def test_near_duplicates_recall(spark):
    rng = random.Random(6)
    header = "a header that many of these documents have in common " * 6
    base = [(header if g % 2 else "") + "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.choice([60, 300, 1500, 6000]))) for g in range(24)]
    texts = {100 * g + c: typed(rng, b, c // 2) if c else b for g, b in enumerate(base) for c in range(10)}
    prints = dict(zip(texts, map(P.show, P.embed_all(list(texts.values()))), strict=True))
    want, links = brute_groups(prints)
    got = groups(spark, prints)
    assert all(want[i] == want[g] for i, g in got.items())  # what is linked is alike
    assert len(links) > 300 and sum(got[a] == got[b] for a, b in links) / len(links) >= 0.9
    assert sum(got[i] == want[i] for i in got) / len(got) >= 0.9


def test_bucket_members_unlike_its_first_are_compared(spark):
    rng = np.random.default_rng(4)
    n = int(np.searchsorted(P._walk()[1], 64))
    bits = lambda: rng.integers(0, 2, n).astype(np.uint8)
    near = bits()
    rows = {}
    for i in range(1, 40):  # unlike in all but one band
        x = bits()
        x[P._pool(12)[0]] = near[P._pool(12)[0]]
        rows[i] = x
    other = near.copy()
    other[[i for i in range(n) if i not in P._pool(12)[0]][0]] ^= 1
    rows |= {50: near, 51: other}
    prints = {i: P.show((64, np.packbits(x).tobytes())) for i, x in rows.items()}
    want, _ = brute_groups(prints)
    assert want[51] == 50 and len(set(want.values())) > 20
    assert groups(spark, prints) == want


def roots(n: int, links) -> list[int]:
    """The smallest number that each of n is joined to."""
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_members_of_unlike_leaders_are_linked():
    """a bucket's links join what all pairs would join, also where only members of unlike leaders are alike."""
    rng = np.random.default_rng(5)
    _, steps, _ = P._walk()
    missed = 0
    for trial in range(12):
        chains = []
        for _ in range(4):
            now = rng.random(len(steps)) < 0.5
            for _ in range(8):  # each a little off the last one
                now = now ^ (rng.random(len(steps)) < rng.choice([0.02, 0.06, 0.09, 0.13]))
                walked = int(rng.choice([1600, 1728, 1792, 1920]))
                chains.append((walked, np.packbits(now[: int(np.searchsorted(steps, walked))]).tobytes()))
        prints = [chains[i] for i in rng.permutation(len(chains))]
        rows = pa.RecordBatch.from_arrays([pa.array([7] * len(prints)), pa.array(range(len(prints))), pa.array([P.show(p) for p in prints])], ["band", "c", "fp"])
        links = [(a, b) for batch in P._bucket_links(0.8)(iter([rows[:9], rows[9:]])) for a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
        every = [(a, b) for a in range(len(prints)) for b in range(a) if P.likeness(prints[a], prints[b]) >= 0.8]
        assert set(links) <= set(every) and roots(len(prints), links) == roots(len(prints), every)
        missed += len(links) < len(every)
    assert missed  # not all pairs are listed


def test_near_duplicates_of_awkward_rows(spark):
    rows = [*AWKWARD, (None, "no id but twice the same text", None, None), (None, "no id but twice the same text", None, None), (70, "hello world"), (71, "hello world"), (72, "x"), (73, "x"), (74, "")]
    d = docs(spark, rows).withColumns({"c": F.lit(1), "band": F.lit("b"), "label": F.lit(2)})
    got = P.with_near(P.compare_with_next(d), d).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.text): r.near_id for r in got}
    assert by[71, "hello world"] == by[70, "hello world"] <= 70 and by[73, "x"] == by[72, "x"] <= 72 and by[74, ""] == 74 and by[None, "no id but twice the same text"] is None
    none = docs(spark, [])
    assert P.with_near(P.compare_with_next(none), none).count() == 0


def test_query_groups_near_duplicates(spark, small):
    rows = {r.doc_id: r for r in queries.op10_fingerprint(spark, small).collect()}
    want, links = brute_groups({i: r.fingerprint for i, r in rows.items()})
    got = {i: r.near_id for i, r in rows.items()}
    assert all(want[i] == want[g] for i, g in got.items())
    assert all(got[a] == got[b] for a, b in links) or sum(got[a] == got[b] for a, b in links) / len(links) >= 0.9
    same = {}
    for i, r in sorted(rows.items()):
        if r.n_chars:
            assert got[same.setdefault(r.fingerprint, i)] == got[i]
