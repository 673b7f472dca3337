"""Numpy kernels: content-defined cuts, Galois-field coding, Bloom filter, digests."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

# -- content-defined chunking ------------------------------------------------
POLY, WINDOW = 0x3DA3358B4DC173, 64
_DEGREE = POLY.bit_length() - 1


def _reduce(x: int) -> int:
    while x.bit_length() > _DEGREE:
        x ^= POLY << (x.bit_length() - 1 - _DEGREE)
    return x


@lru_cache(maxsize=1)
def _window_tables() -> np.ndarray:
    """table[j, b]: what byte b adds to a fingerprint j places before the window's end. The fingerprint is linear."""
    out = np.zeros((WINDOW, 256), np.uint64)
    for j in range(WINDOW):
        bits = [_reduce(1 << (8 * j + b)) for b in range(8)]
        for v in range(256):
            x = 0
            for b in range(8):
                if v >> b & 1:
                    x ^= bits[b]
            out[j, v] = x
    return out


def fingerprints(data: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Rabin fingerprint of the WINDOW bytes that end at each place from WINDOW - 1 on, in cache-sized blocks."""
    table, n = _window_tables(), len(data) - WINDOW + 1
    out = np.zeros(max(0, n), np.uint64)
    for a in range(0, n, block):
        b = min(n, a + block)
        own = out[a:b]
        for j in range(WINDOW):
            own ^= table[j][data[a + WINDOW - 1 - j : b + WINDOW - 1 - j]]
    return out


def cuts(data: bytes, low: int, bits: int, high: int) -> list[int]:
    """End offsets of the chunks: the first place at `low` or more bytes whose fingerprint has `bits` zero bits, or `high`.

    low >= WINDOW, so that a fingerprint depends on the last WINDOW bytes alone. Data of `low` bytes or less are one chunk.
    """
    n = len(data)
    if n <= low:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    hit = np.flatnonzero((fingerprints(raw) & np.uint64((1 << bits) - 1)) == 0) + WINDOW  # chunk ends
    out, start = [], 0
    while n - start > low:
        at = np.searchsorted(hit, start + low)
        end = int(hit[at]) if at < len(hit) else n
        end = min(end, start + high, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


# -- Galois field ------------------------------------------------------------
FIELD = 0x11D


@lru_cache(maxsize=1)
def field() -> tuple[np.ndarray, np.ndarray]:
    """(product table 256x256, inverses) of GF(2^8)."""
    exp, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (FIELD if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    a = np.arange(256)
    mul = np.where((a[:, None] == 0) | (a[None, :] == 0), 0, exp[log[:, None] + log[None, :]]).astype(np.uint8)
    inverse = np.zeros(256, np.uint8)
    inverse[1:] = exp[(255 - log[1:]) % 255]
    return mul, inverse


def parity_matrix(k: int, m: int) -> np.ndarray:
    """Cauchy rows: the inverse of (k + i) XOR j; copies for k = 1."""
    if k == 1:
        return np.ones((m, 1), np.uint8)
    return field()[1][(k + np.arange(m))[:, None] ^ np.arange(k)[None, :]]


def multiply(matrix: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Matrix (r, k) times shards (k, bytes): table rows gathered and added."""
    mul = field()[0]
    out = np.zeros((len(matrix), shards.shape[1]), np.uint8)
    for i, row in enumerate(matrix):
        for j, c in enumerate(row):
            if c == 1:
                out[i] ^= shards[j]
            elif c:
                out[i] ^= mul[c][shards[j]]
    return out


@lru_cache(maxsize=512)
def decoder(k: int, m: int, have: tuple[int, ...]) -> np.ndarray:
    """The matrix that turns the k shards `have` into the data shards: Gauss-Jordan over the field."""
    mul, inverse = field()
    rows = np.concatenate([np.eye(k, dtype=np.uint8), parity_matrix(k, m)])[list(have)]
    work = np.concatenate([rows, np.eye(k, dtype=np.uint8)], axis=1)
    for c in range(k):
        p = c + int(np.flatnonzero(work[c:, c])[0])
        work[[c, p]] = work[[p, c]]
        work[c] = mul[inverse[work[c, c]]][work[c]]
        for r in range(k):
            if r != c and work[r, c]:
                work[r] ^= mul[work[r, c]][work[c]]
    return work[:, k:]


def encode_stripe(data: bytes, k: int, m: int, size: int) -> list[bytes]:
    """k data shards of `size` bytes, zero padded, and m parity shards."""
    raw = np.zeros(k * size, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    shards = raw.reshape(k, size)
    return [s.tobytes() for s in shards] + [s.tobytes() for s in multiply(parity_matrix(k, m), shards)]


def decode_stripe(shards: dict[int, bytes], k: int, m: int, length: int) -> bytes | None:
    """The stripe's data from any k shards (data shards first), or None if there are fewer."""
    have = tuple(sorted(shards)[:k])
    if len(have) < k:
        return None
    stack = np.stack([np.frombuffer(shards[i], np.uint8) for i in have])
    return (stack if have == tuple(range(k)) else multiply(decoder(k, m, have), stack)).tobytes()[:length]


def xor_parity(shards: list[bytes]) -> bytes:
    return np.bitwise_xor.reduce(np.stack([np.frombuffer(s, np.uint8) for s in shards])).tobytes()


# -- Bloom filter ------------------------------------------------------------
def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, probes) for n items at false-positive rate p."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(1, n) * math.log(2)))


def bloom_places(digests: list[bytes], m: int, k: int) -> np.ndarray:
    """Bit places (items, k): h1 + i h2 modulo m of the digest's first two little-endian words, h2 odd; no overflow."""
    if not digests:
        return np.zeros((0, k), np.int64)
    w = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
    h1, h2 = (w[:, 0] % np.uint64(m)).astype(np.int64), ((w[:, 1] | np.uint64(1)) % np.uint64(m)).astype(np.int64)
    return (h1[:, None] + np.arange(k) * h2[:, None]) % m


def blake(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=32).digest()
