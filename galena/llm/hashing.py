"""Vectorised 64-bit hashes of words and word windows, and run-length blobs, shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.session import partitions

_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xC2B2AE3D27D4EB4F


def free(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_bytes(df: DataFrame, text: str) -> int:
    """About how many bytes the texts have: from the files' sizes where df only reads, selects and filters, else summed."""
    plan = df.select(text)._jdf.queryExecution().optimizedPlan()
    stats = plan.stats().sizeInBytes()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation":
        return int(str(stats))
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(df: DataFrame, text: str, each: int = 32 << 20) -> int:
    """Into how many parts texts are dealt: one per `each` bytes, and no fewer than the shuffle's partitions. It steers memory, not results."""
    return max(partitions(df.sparkSession), text_bytes(df, text) // each)


def trim() -> None:
    """Give freed memory back to the system: a Python worker that waits for the next stage would keep it, next to the JVM's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run: Callable) -> Callable:
    """A function of batches that trims when its task ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def trimmed_group(run: Callable) -> Callable:
    """A function of a group's table that trims after each group."""

    def inner(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return inner


class WordHash(dict):
    """word -> 64-bit hash, remembered for at most `memo` words."""

    def __init__(self, memo: int = 400_000):
        super().__init__()
        self.memo = memo

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.memo:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MUL
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; fewer words than k give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_STEP) + hashes[j : j + n]
    return mix(out)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of k-word shingles; of fewer words the whole sequence is one shingle."""
    if 0 < len(hashes) < k:
        out = np.uint64(len(hashes))
        with np.errstate(over="ignore"):
            for h in hashes:
                out = out * np.uint64(_STEP) + h
        return mix(np.array([out ^ np.uint64(0x5851F42D4C957F2D)]))
    return np.unique(windows(hashes, k))


def pieces(order_key: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values in a sorted array."""
    if not len(order_key):
        return []
    cuts = np.r_[0, np.flatnonzero(np.diff(order_key)) + 1, len(order_key)]
    return [(int(order_key[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def runs(values: np.ndarray) -> tuple[bytes, bytes]:
    """Run-length code of an array: the values and the length of each run."""
    cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, np.int64)
    return values[cuts[:-1]].tobytes(), np.diff(cuts).astype(np.uint32).tobytes()


def unrun(values: bytes, lengths: bytes, dtype=np.uint64) -> np.ndarray:
    return np.repeat(np.frombuffer(values, dtype), np.frombuffer(lengths, np.uint32))


def joined(column, dtype=np.uint64) -> np.ndarray:
    """All blobs of a binary column as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def pack48(values: np.ndarray) -> bytes:
    """Six bytes each of numbers below 2**48."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blobs: list[bytes]) -> np.ndarray:
    """The numbers of any blobs of pack48(), in order; None counts as empty."""
    raw = np.frombuffer(b"".join(b for b in blobs if b), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(np.uint64, copy=False)
