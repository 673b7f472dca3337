from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galena.llm import bpe, queries
from tests.llm.helpers import AWKWARD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    own = bpe.codec(PATH)
    ids, offsets = own.encode_batch(texts)
    back = own.decode_batch(ids, offsets)
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids, texts[i]
        assert back[i] == library.decode(e.ids, skip_special_tokens=False)


def test_corner_cases(library):
    same(library, [None, "", " ", "ΣΑΣ İ ſ ǅ", "a\x1cb\x1db\x85c", "x<|endoftext|>y <|startoftext|>", "<|EndOfText|>", "aaaaaaaaaaaaaaa", "I'll don't 'S", "é ́a", "한국어", "12½³٣", "😀👍🏽", "a" * 3000])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_any_latin_text(library, texts):
    same(library, texts)


def test_memo_reset_changes_nothing(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeth 's.1é") for _ in range(200)) for _ in range(40)]
    own = bpe.Codec(PATH, memo=10)
    for t in texts:
        ids, _ = own.encode_batch([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_query(spark, small, library):
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, small).collect()}
    table = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(table)
    for d in table:
        e = library.encode(d.text or "", add_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))


def test_awkward_rows_and_clashing_names(spark, library):
    d = docs(spark, AWKWARD).withColumns({"ids": F.lit("mine"), "other": F.lit(1), "_both": F.lit(2), "both": F.lit(3)})
    out = bpe.encode_documents(d, PATH)
    assert set(out.columns) == {*d.columns, "decoded"}
    rows = out.collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode_documents(docs(spark, []), PATH).count() == 0
    assert [r[0] for r in spark.createDataFrame([([1, 2],), (None,)], "x array<int>").select(bpe.decode(F.col("x"), PATH)).collect()] == [" ".join(bpe.codec(PATH).tokens[1:3]), ""]
    assert [list(r[0]) for r in d.select(bpe.encode(F.col("text"), PATH)).collect()] == [r.ids for r in rows]


def test_slices_cover_everything():
    import pyarrow as pa

    a = pa.array(["x" * 10, None, "y" * 30, "", "z"] * 7)
    parts = list(bpe._slices(a, 25))
    assert sum(map(len, parts)) == len(a) and pa.concat_arrays(parts).equals(a)
    assert np.all([len(p) for p in parts])
