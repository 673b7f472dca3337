"""BPE encoding and decoding with a public word-level vocabulary (operator 1).

Encoding merges in batched numpy rounds: the symbols of many distinct words lie in one flat array, every adjacent pair
is looked up by binary search over the sorted pair keys, each word's lowest-rank pair is merged, and words without a
mergeable pair leave the array. Results equal the tokenizers library's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm import hashing

_END = "</w>"
_NO_RANK = np.iinfo(np.int64).max
#: Fixed values of the vocabulary's format: contractions, letter runs, single digits, runs of the rest.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """One vocabulary file; `words` remembers at most `memo` white-space tokens."""

    def __init__(self, path: str, memo: int = 150_000):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[x] for x, _ in pairs], dtype=np.int64)
        right = np.array([vocab[y] for _, y in pairs], dtype=np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        order = order[first]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + _END] for c in chars], dtype=np.int64)
        self.special = special
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.mark = next(iter(special), "\0")[:2]
        self.pieces = regex.compile(_PIECES)
        self.memo = memo
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    # -- merging -----------------------------------------------------------
    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of non-empty words and the offsets of each word."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(n), sizes)
        done_sym, done_word = [], []
        while len(sym):
            joint = word[1:] == word[:-1]
            rank = np.full(len(sym), _NO_RANK, np.int64)
            made = np.zeros(len(sym), np.int64)
            at = np.flatnonzero(joint)
            key = sym[at] * self.size + sym[at + 1]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[slot] == key
            rank[at[hit]] = self.ranks[slot[hit]]
            made[at[hit]] = self.made[slot[hit]]
            starts = np.flatnonzero(np.r_[True, ~joint])
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(sym)])
            alive = np.repeat(lowest < _NO_RANK, spans)
            if not alive.all():
                done_sym.append(sym[~alive])
                done_word.append(word[~alive])
            chosen = alive & (rank == np.repeat(lowest, spans))
            # of overlapping occurrences (a a a) every second one merges, from the left
            run_at = np.flatnonzero(chosen & ~np.r_[False, chosen[:-1]])
            picked = np.flatnonzero(chosen)
            if len(run_at) != len(picked):
                begin = run_at[np.searchsorted(run_at, picked, side="right") - 1]
                picked = picked[(picked - begin) % 2 == 0]
            sym[picked] = made[picked]
            alive[picked + 1] = False
            sym, word = sym[alive], word[alive]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=n))]

    # -- texts -------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """White-space tokens; the strings of special tokens stand alone."""
        if self.special_re is not None and self.mark in text:
            out: list[str] = []
            for part in self.special_re.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return [x for x in _SPACE.split(text) if x] if _SEPARATORS.search(text) else text.split()

    def _pieces_of(self, token: str) -> list[str]:
        if not token.isascii():
            token = unicodedata.normalize("NFC", token).replace("Σ", "σ")  # no final-sigma rule
        return self.pieces.findall(token.lower())

    def _learn(self, tokens: list[str]) -> None:
        """Encode new white-space tokens and append them to the memo."""
        pieces: dict[str, int] = {}
        plan = []
        for t in tokens:
            plan.append(self.special[t] if t in self.special else [pieces.setdefault(p, len(pieces)) for p in self._pieces_of(t)])
        flat, offsets = self.merge([p.encode("utf-8") for p in pieces])
        parts = [np.array([x], np.int32) if isinstance(x, int) else np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in x]) if x else np.zeros(0, np.int32) for x in plan]
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum([len(p) for p in parts])]
        self.flat = np.concatenate([self.flat, *parts])
        for t in tokens:
            self.index[t] = len(self.index)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text; a null text is empty."""
        if len(self.index) > self.memo:
            self._reset()
        split = [self.split(t) if t else [] for t in texts]
        fresh = {t for words in split for t in words if t not in self.index}
        if fresh:
            self._learn(sorted(fresh))
        index = self.index
        words = np.fromiter((index[t] for ws in split for t in ws), np.int64, sum(map(len, split)))
        sizes = self.starts[words + 1] - self.starts[words]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.starts[words] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.r_[0, np.cumsum([len(ws) for ws in split], dtype=np.int64)]]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The vocabulary has no decoder: token strings joined by one space."""
        shown = [self.tokens[i] for i in ids.tolist()]
        return [" ".join(shown[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _slices(array: pa.Array, most: int = 2_000_000) -> Iterator[pa.Array]:
    """Slices of about `most` bytes of text, so that ids and decoded texts of a batch stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0)) if len(array) else np.zeros(0, np.int64)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(array)] if len(array) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield array.slice(int(a), int(b - a))


def encode(text: Column, path: str) -> Column:
    """array<int> of token ids of each whole text; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for array in batches:
            for piece in _slices(array):
                ids, offsets = own.encode_batch(piece.to_pylist())
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of token ids; null gives the empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for array in batches:
            array = pc.fill_null(array, pa.scalar([], array.type)) if array.null_count else array
            values = np.asarray(array.flatten())
            offsets = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(array)), dtype=np.int64)]
            yield pa.array(own.decode_batch(values, offsets), pa.string())

    return run(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct<ids: array<int>, decoded: string>: encode() and decode() of the same texts in one pass, with one codec a worker."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for array in batches:
            for piece in _slices(array):
                ids, offsets = own.encode_batch(piece.to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.StructArray.from_arrays([lists, pa.array(own.decode_batch(ids, offsets), pa.string())], ["ids", "decoded"])

    return run.asNondeterministic()(text)  # evaluated once for both columns


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the token ids of its texts and the text that they decode to. Columns of these names are replaced."""
    own = hashing.free(df, "both")
    both = df.withColumn(own, round_trip(F.col(text), path))
    return both.withColumns({ids: F.col(own).getField("ids"), decoded: F.col(own).getField("decoded")}).drop(own)
