from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from galena.functions import kernels as K


def slow_cuts(data: bytes, low: int, bits: int, high: int) -> list[int]:
    """Byte by byte: the window's polynomial is reduced anew for every place."""
    def value(window: bytes) -> int:
        x = int.from_bytes(window, "big")
        while x.bit_length() > K._DEGREE:
            x ^= K.POLY << (x.bit_length() - 1 - K._DEGREE)
        return x

    out, start, n = [], 0, len(data)
    while n - start > low:
        end = start + low
        while end < n and end - start < high and value(data[end - K.WINDOW : end]) & ((1 << bits) - 1):
            end += 1
        out.append(end)
        start = end
    return out + ([n] if start < n else [])


@pytest.mark.parametrize(("low", "bits", "high"), [(64, 5, 400), (256, 8, 1024)])
def test_cuts_equal_the_byte_loop(low, bits, high):
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 700, 6000):
        data = rng.randbytes(n)
        got = K.cuts(data, low, bits, high)
        assert got == slow_cuts(data, low, bits, high)
        assert (got[-1] if got else 0) == n
        assert all(b - a <= high for a, b in zip([0, *got], got, strict=False))
    assert K.cuts(bytes(5000), 64, 5, 400) == slow_cuts(bytes(5000), 64, 5, 400)


def test_one_inserted_byte_changes_few_chunks():
    data = random.Random(5).randbytes(400_000)
    edited = data[:200_000] + b"!" + data[200_000:]

    def chunks(d):
        ends = K.cuts(d, 2048, 11, 16384)
        return {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)}

    assert len(chunks(edited) - chunks(data)) <= 2


def test_field():
    mul, inverse = K.field()
    a = np.arange(256)
    assert (mul == mul.T).all() and (mul[1] == a).all() and (mul[a[1:], inverse[1:]] == 1).all()
    rng = random.Random(1)
    for _ in range(200):
        x, y, z = (rng.randrange(256) for _ in range(3))
        assert mul[mul[x, y], z] == mul[x, mul[y, z]] and mul[x, y ^ z] == mul[x, y] ^ mul[x, z]


@pytest.mark.parametrize(("k", "m"), [(1, 2), (2, 1), (4, 2), (6, 2), (8, 3), (10, 4)])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 7001])
def test_every_small_loss_is_repaired(k, m, n):
    data = random.Random(n).randbytes(n)
    size = max(64, -(-(-(-n // k)) // 64) * 64)
    shards = dict(enumerate(K.encode_stripe(data, k, m, size)))
    for lost in range(min(2, m) + 1):
        for gone in combinations(range(k + m), lost):
            left = {i: s for i, s in shards.items() if i not in gone}
            assert K.decode_stripe(left, k, m, n) == data
    assert K.decode_stripe({i: shards[i] for i in range(k - 1)}, k, m, n) is None


def test_xor_parity_rebuilds_one_shard():
    shards = [random.Random(i).randbytes(64) for i in range(4)]
    assert K.xor_parity([*shards[1:], K.xor_parity(shards)]) == shards[0]


def test_bloom_places_do_not_overflow():
    d = bytes(range(200, 232))
    h1, h2 = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:16], "little") | 1
    assert K.bloom_places([d], 9_585_059, 7)[0].tolist() == [(h1 + i * h2) % 9_585_059 for i in range(7)]
    assert K.bloom_size(1_000_000, 0.01)[1] == 7


def test_digest():
    assert K.blake(b"abc").hex().upper().startswith("BDDD813C")
