from __future__ import annotations

import corpus_pipeline
import pytest
from tests.llm.helpers import AWKWARD, docs


@pytest.fixture(scope="module")
def steps(spark, small):
    """The written result of every stage."""
    from galena.session import cut

    out = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], small), name))
    return out


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in steps[:-1])


def test_stages_against_brute_force(spark, steps):
    from tests.llm.test_ngram_join import brute as join
    from tests.llm.test_suffix_dedup import brute as repeats

    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:4]]
    assert set(rows[1]) == {i for i, r in rows[0].items() if any(c.isalpha() for c in r.text or "")}
    want = join([(i, r.text) for i, r in rows[1].items()], 5, 80, 100)
    assert set(rows[2]) == {i for (i, _), (n, c) in want.items() if not n or i == c} < set(rows[1])
    kept = repeats([(i, r.text) for i, r in rows[2].items()], 100)
    assert {i: r.text for i, r in rows[3].items()} == {i: k[3].decode("utf-8", "ignore") for i, k in kept.items() if k[3] or not k[1]}
    assert all(r.n_chars == len(r.text) for r in rows[3].values())


def test_mix_and_ids(spark, steps):
    from galena.llm import bpe, mixing
    from galena.llm.queries import word_vocabulary

    plan = {r.key: r.copies for r in mixing.mix(steps[3]).collect()}
    taken = {}
    for r in steps[4].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {k: c for k, c in plan.items() if c}
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    own = bpe.codec(word_vocabulary())
    for r in steps[5].collect():
        assert list(r.ids) == own.encode_batch([texts[r.doc_id]])[0].tolist() and r.n_tokens == len(r.ids)


def test_run(spark, small, steps):
    assert corpus_pipeline.run(spark, small).count() == steps[-1].count()


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_awkward_rows(spark, rows):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs(spark, rows), "").count()
