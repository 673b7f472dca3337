"""Near-duplicate images: 64-bit codes, Hamming range search and join, groups and their report."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions import scalars as S
from galena.operators.graph import connected_components
from galena.session import cut, partitions

#: Rows on the plain side up to which all codes are compared with it directly; a measured size, checked before use.
NESTED_ROWS = 30_000
#: Neighbours that a code's bands ask for at most, and pairs of codes compared at once.
ASKED, BLOCK = 150, 1_000_000


# -- codes -------------------------------------------------------------------
def simhash(text: Column) -> Column:
    """64-bit SimHash of the distinct space-separated tokens: bit i is set where more than half of the tokens' SHA-256 prefixes have it."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        memo: dict[str, int] = {}
        for array in batches:
            out = np.zeros(len(array), np.uint64)
            for i, t in enumerate(array.to_pylist()):
                words = set((t or "").split(" "))
                if len(memo) > 300_000:
                    memo.clear()
                for w in words:
                    if w not in memo:
                        memo[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
                bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
                out[i] = np.packbits(2 * bits > len(words)).view(">u8")[0]
            yield pa.array(out.view(np.int64))

    return run(text)


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    c = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    c[0] /= np.sqrt(2)
    return c


def _signed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.astype(np.uint8)).view(">u8")[0].astype(np.uint64).view(np.int64))


def phash_bits(gray: np.ndarray) -> int:
    """DCT code of a 32x32 grey image: top-left 8x8 coefficients above the median of the 63 without the first, whose bit is 0."""
    c = _cosines(32)[:8]
    block = (c @ gray @ c.T).ravel()
    bits = block > np.median(block[1:])
    bits[0] = False
    return _signed(bits)


def dhash_bits(gray: np.ndarray) -> int:
    """Gradient code of a 8x9 grey image: right neighbour brighter, row by row."""
    return _signed((gray[:, 1:] > gray[:, :-1]).ravel())


def laplace_variance(gray: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian of the interior; 0 for sides under 3 pixels."""
    if min(gray.shape) < 3:
        return 0.0
    inner = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    return float(inner.var())


def image_codes(pixels: Column, width: Column, kind: str) -> Column:
    """phash or dhash (long) or sharpness (double) of decoded grey images: pixels row by row and the row's width; null where the shape doesn't fit."""
    own = {"phash": (phash_bits, (32, 32)), "dhash": (dhash_bits, (8, 9)), "sharpness": (laplace_variance, None)}[kind]

    @F.arrow_udf("double" if kind == "sharpness" else "long")
    def run(p: pa.Array, w: pa.Array) -> pa.Array:
        out = []
        for x, n in zip(p.to_pylist(), w.to_pylist(), strict=True):
            a = None if x is None or not n or len(x) % n else np.array(x, float).reshape(-1, n)
            out.append(None if a is None or own[1] and a.shape != own[1] else own[0](a))
        return pa.array(out, pa.float64() if kind == "sharpness" else pa.int64())

    return run(pixels, width)


# -- joins -------------------------------------------------------------------
def masks(radius: int, width: int = 16) -> list[int]:
    """All values of `width` bits with at most `radius` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


@lru_cache(maxsize=16)
def band_plan(radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, r) of bands such that two codes within radius differ in r bits at most in some band of theirs.

    The r of b bands add up to radius + 1 - b: were every band over its r, the codes would differ in radius + 1 bits. Fewer
    bands meet fewer others but ask for more neighbours; the fewest bands with at most ASKED neighbours of a code are taken.
    """
    for n in range(1, 65):
        widths = [64 // n + (i < 64 % n) for i in range(n)]
        r = [max(0, radius + 1 - n) // n + (i < max(0, radius + 1 - n) % n) for i in range(n)]
        if sum(comb(w, k) for w, m in zip(widths, r, strict=True) for k in range(min(w, m) + 1)) <= ASKED:
            break
    return [(sum(widths[:i]), w, min(w, m)) for i, (w, m) in enumerate(zip(widths, r, strict=True))]


def hamming_pairs(codes: DataFrame, radius: int = 10, strategy: str | None = None) -> DataFrame:
    """(a, b, distance) with a < b and distance <= radius, exact.

    Codes with equal bits are joined once per distinct code and expanded at the end. 'bands': some band of two codes within
    radius differs in few bits (`band_plan`), so one side takes every such neighbour of its bands and meets the other
    side's bands; 'nested': every code against a broadcast of all, taken only below a counted size.
    """
    c = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code")
    distinct = c.select("code").distinct()
    if strategy is None:
        strategy = "nested" if distinct.limit(NESTED_ROWS + 1).count() <= NESTED_ROWS else "bands"
    near = cut(_near(distinct, distinct.withColumnRenamed("code", "other"), radius, strategy).where("code < other"), "near")
    d = S.hamming(F.col("code"), F.col("other"))
    left, right = c.withColumnRenamed("id", "x"), c.select(F.col("id").alias("y"), F.col("code").alias("other"))
    # merged: a written table of many pairs of few codes is small enough to be broadcast through the driver, its rows are not
    unlike = near.hint("merge").join(left, "code").hint("merge").join(right, "other").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), d.alias("distance"))
    same = left.hint("merge").join(right, F.col("code") == F.col("other")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance"))
    return unlike.union(same)


def _near(left: DataFrame, right: DataFrame, radius: int, strategy: str, forest: bool = False) -> DataFrame:
    """(code, other) of distinct codes within radius. forest, for bands of equal sides: with code < other, enough of them to connect what all connect."""
    ok = F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) <= radius
    if strategy == "nested":
        return left.join(F.broadcast(right), ok)  # counted: NESTED_ROWS at most
    plan = band_plan(radius)

    def places(code: Column, i: int, neighbours: bool) -> Column:
        shift, width, r = plan[i]
        v = F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else code
        spread = F.array(*[F.lit(m).cast("long") for m in (masks(r, width) if neighbours else [0])])
        return F.transform(spread, lambda m: F.struct(F.lit(i).alias("i"), v.bitwiseXOR(m).alias("v")))

    def at(code: Column, neighbours: bool) -> Column:
        """A row for each place (band, value) of a code, or for all that its bands may meet."""
        return F.explode(F.concat(*[places(code, i, neighbours) for i in range(len(plan))]))

    own = left.select(F.lit(False).alias("asked"), "code", at(F.col("code"), False).alias("k"))
    asked = right.select(F.lit(True).alias("asked"), F.col("other").alias("code"), at(F.col("other"), True).alias("k"))
    # dealt and sorted, not joined: the planner takes the many neighbours for as few bytes as the codes and would broadcast them
    met = own.union(asked).select("k.i", "k.v", "asked", "code").repartition(partitions(left.sparkSession), "i", "v").sortWithinPartitions("i", "v")
    return met.mapInArrow(_meet(radius, plan, forest), "code long, other long")


def _connecting(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the links (x, y), x ascending, connect what all of them do. label: the component of each y so far, brought up to date."""
    keep = np.ones(len(x), bool)
    cuts = np.r_[0, np.flatnonzero(np.diff(x)) + 1, len(x)]
    for a in np.flatnonzero(np.diff(cuts) > 1).tolist():  # a single link joins no components of y
        here = slice(cuts[a], cuts[a + 1])
        parts, first = np.unique(label[y[here]], return_index=True)
        keep[here] = False
        keep[cuts[a] + first] = True
        if len(parts) > 1:
            label[np.isin(label, parts)] = parts[0]
    return keep


def _meet(radius: int, plan: list[tuple[int, int, int]], forest: bool = False):
    """Sorted rows (i, v, asked, code) -> (code, other) within radius, each pair in the first of its bands that meet.

    The codes of one place are held as numbers of 8 bytes and compared in blocks. forest: of a place's pairs with
    code < other no more than it has codes, which connect what all of them do.
    """
    schema = pa.schema([("code", pa.int64()), ("other", pa.int64())])

    def pairs(i: int, own: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        step, label = max(1, BLOCK // max(1, len(own))), np.arange(len(own))
        for a in range(0, len(asked), step):
            unlike = asked[a : a + step, None] ^ own[None, :]
            x, y = np.nonzero(np.bitwise_count(unlike) <= radius)
            d = unlike[x, y]
            first = np.ones(len(x), bool)
            for shift, width, r in plan[:i]:
                first &= np.bitwise_count((d >> np.uint64(shift)) & np.uint64((1 << width) - 1)) > r
            if forest:
                first &= own.view(np.int64)[y] < asked[a : a + step].view(np.int64)[x]
                first[first] = _connecting(x[first], y[first], label)
            if first.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[y[first]].view(np.int64)), pa.array(asked[a : a + step][x[first]].view(np.int64))], schema=schema)

    def place(i: int, rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        is_asked, code = (np.concatenate(c) for c in zip(*rows, strict=True))
        own, asked = code[~is_asked], code[is_asked]
        if len(own) and len(asked):
            for k in range(0, len(own), BLOCK):
                yield from pairs(i, own[k : k + BLOCK], asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            i, v, code = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            is_asked, code = batch.column(2).to_numpy(zero_copy_only=False), code.view(np.uint64)
            cuts = np.r_[0, np.flatnonzero((i[1:] != i[:-1]) | (v[1:] != v[:-1])) + 1, len(i)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (i[a], v[a]) != now:
                    if held:
                        yield from place(int(now[0]), held)
                    now, held = (i[a], v[a]), []
                held.append((is_asked[a:b], code[a:b]))
        if held:
            yield from place(int(now[0]), held)

    return run


def hamming_search(codes: DataFrame, queries: DataFrame, radius: int, strategy: str = "bands") -> DataFrame:
    """(query, id, distance) of all codes within radius of each query."""
    q = queries.select(F.col("id").alias("query"), F.col("code").alias("other")).dropna()
    c = codes.select("id", "code").dropna()
    near = _near(c.select("code").distinct(), q.select("other").distinct(), radius, strategy)
    return c.join(near, "code").join(q, "other").select("query", "id", S.hamming(F.col("code"), F.col("other")).alias("distance"))


def hamming_links(codes: DataFrame, radius: int = 10) -> DataFrame:
    """(a, b): enough links to connect what pairs within radius connect: equal codes as a star, unlike ones by representatives.

    Codes that are all near to each other make a forest for each place (band, value) where they meet, not all pairs.
    """
    c = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    rep = cut(c.groupBy("code").agg(F.min("id").alias("rep")), "codes")
    stars = c.hint("merge").join(rep, "code").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    one = rep.select("code")
    near = cut(_near(one, one.withColumnRenamed("code", "other"), radius, "bands", forest=True), "near")
    unlike = near.hint("merge").join(rep, "code").hint("merge").join(rep.select(F.col("rep").alias("y"), F.col("code").alias("other")), "other")
    return stars.union(unlike.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")))


def groups(codes: DataFrame, radius: int = 10) -> DataFrame:
    """(id, dup_group): components of live codes within radius, named by their smallest id. Ids without a partner are absent."""
    return connected_components(hamming_links(codes, radius)).withColumnRenamed("label", "dup_group")


def report(files: DataFrame, grouped: DataFrame) -> DataFrame:
    """(dup_group, keeper, members, reclaimable): live unreviewed members, groups of two at least.

    The keeper has the most pixels, then the highest sharpness, then the earliest capture time (nulls count 0), then the
    smallest id; the rest of the group's bytes are reclaimable.
    """
    f = files.where(F.col("trashed_at").isNull() & ~F.col("dup_reviewed")).join(grouped, "id")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    best = F.struct(zero("width") * zero("height"), zero("sharpness"), -zero("capture_ts"), -F.col("id"))
    g = f.groupBy("dup_group").agg(F.count("*").alias("members"), F.max_by(F.struct("id", "size"), best).alias("k"), F.sum("size").alias("bytes"))
    g = g.where("members > 1").select("dup_group", F.col("k.id").alias("keeper"), "members", (F.col("bytes") - F.col("k.size")).alias("reclaimable"))
    return g.orderBy(F.desc("reclaimable"), "dup_group")


def resolve(grouped: DataFrame, keep: DataFrame) -> DataFrame:
    """(dup_group, id, action): members outside `keep` are trashed; a group that keeps nothing is refused."""
    k = keep.select(F.col("id"), F.lit(True).alias("kept"))
    j = grouped.join(k, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    some = F.max("kept").over(Window.partitionBy("dup_group"))
    return j.select("dup_group", "id", F.when(~some, "refused").when(F.col("kept"), "keep").otherwise("trash").alias("action"))


def pr_curve(codes: DataFrame, radii: list[int], strategy: str | None = None) -> DataFrame:
    """(radius, tp, predicted, precision, recall, f1) of codes (id, code, label): a pair is predicted within the radius and true if its labels agree.

    Pairs are counted, not listed: n (n - 1) / 2 within a code or a label, n m between near codes. Precision is 1 where
    nothing is predicted, recall is 1 where nothing is true.
    """
    per = cut(codes.where(F.col("code").isNotNull()).groupBy("code", "label").agg(F.count("*").alias("n")), "labelled")
    whole = per.groupBy("code").agg(F.sum("n").alias("n"))
    distinct = whole.select("code")
    if strategy is None:
        strategy = "nested" if distinct.limit(NESTED_ROWS + 1).count() <= NESTED_ROWS else "bands"
    near = cut(_near(distinct, distinct.withColumnRenamed("code", "other"), max(radii), strategy).where("code < other"), "near")
    d = S.hamming(F.col("code"), F.col("other")).alias("distance")
    second = lambda df: df.withColumnsRenamed({"code": "other", "n": "m"})
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")
    every = near.join(whole, "code").join(second(whole), "other").select(d, (F.col("n") * F.col("m")).alias("pairs"))
    true = near.join(per, "code").join(second(per), ["other", "label"]).select(d, (F.col("n") * F.col("m")).alias("pairs"))
    every = every.union(whole.select(F.lit(0).alias("distance"), pairs))
    true = true.union(per.select(F.lit(0).alias("distance"), pairs))
    at = lambda df, name: df.agg(F.array(*[F.coalesce(F.sum(F.when(F.col("distance") <= r, F.col("pairs"))), F.lit(0)) for r in radii]).alias(name))
    positive = per.where("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("n")).select(pairs).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("positive"))
    one = at(every, "p").crossJoin(at(true, "t")).crossJoin(positive)  # one row each
    zipped = F.arrays_zip(F.array(*map(F.lit, radii)).alias("radius"), F.col("t").alias("tp"), F.col("p").alias("predicted"))
    rows = one.select("positive", F.explode(zipped).alias("c")).select("positive", F.col("c.radius").alias("radius"), F.col("c.tp").alias("tp"), F.col("c.predicted").alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(1.0))
    r = F.when(F.col("positive") > 0, F.col("tp") / F.col("positive")).otherwise(F.lit(1.0))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return rows.select("radius", "tp", "predicted", p.alias("precision"), r.alias("recall")).withColumn("f1", f1)
