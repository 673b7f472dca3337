"""Document fingerprints by randomised edit embedding (operator 10).

All texts share one random walk: at step t a text shows its current character and, by a random bit of (t, character),
stays or goes on by one. Texts a few edits apart fall into step again soon after each edit, so the edit distance of two
texts becomes the Hamming distance of what they show. Each shown character gives a random bit; bits are sampled at
steps that all texts share, SAMPLES from each octave of steps, so that whole texts of any length are covered. The
likeness of two fingerprints weighs every sample by the steps that it stands for.

Near duplicates meet by bit-sampled bands: each band is a fixed draw of samples from all steps below a power of the
square root of 2, by the steps that they stand for, so that a shared opening doesn't fill a band. What meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm import hashing
from galena.operators.graph import connected_components
from galena.session import cut, partitions, release

SEED, SAMPLES, PERIOD, STRIDE, END = 1_019, 128, 4096, 64, 255
#: Bits per band, and bands per pool of steps; a fingerprint has the bands of two pools. Unlike documents meet in
#: n / 2**BAND others a band, so tables of over some 10**8 documents want more bits (32 at most) and more bands.
BAND, BANDS = 24, 16
#: Characters that walk together; characters of finished stretches that a task holds.
_GROUP, _HELD = 24_000_000, 12_000_000


@lru_cache(maxsize=1)
def _walk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """table[t % PERIOD, character]: bit 0 go on, bit 1 show; the sampled steps; the steps that each stands for."""
    rng = np.random.default_rng(SEED)
    table = rng.integers(0, 4, (PERIOD, 256), dtype=np.uint8)
    table[:, END] &= 2  # the end never goes on
    steps, weight = [], []
    for octave in range(40):
        size = 1 << octave
        own = np.arange(size, 2 * size) if size <= SAMPLES else size + (np.arange(SAMPLES) + rng.random(SAMPLES)) * (size / SAMPLES)
        steps.append(np.unique(own.astype(np.int64)))
        weight.append(np.full(len(steps[-1]), size / len(steps[-1])))
    return table, np.concatenate(steps), np.concatenate(weight)


def symbols(text: str) -> np.ndarray:
    """Code points hashed to 0..254."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (((cp * np.uint32(2_654_435_761)) >> np.uint32(8)) % np.uint32(END)).astype(np.uint8)


def embed(texts: list[str]) -> list[tuple[int, bytes]]:
    """(steps walked, packed sampled bits) of each text; an empty text has no step. All texts walk in step."""
    table, steps, _ = _walk()
    out: list[tuple[int, bytes]] = [(0, b"")] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    parts = [symbols(texts[i]) for i in some]
    sizes = np.array([len(p) + 1 for p in parts])
    buf = np.concatenate([x for p in parts for x in (p, np.array([END], np.uint8))])
    at = np.cumsum(sizes) - sizes
    who = np.arange(len(some))
    walked = np.zeros(len(some), np.int64)
    bits = np.zeros((len(some), int(np.searchsorted(steps, 1 << 12))), np.uint8)
    wanted = {int(s): k for k, s in enumerate(steps)}
    t = 0
    while len(who):
        for _ in range(STRIDE):
            row = table[t % PERIOD].take(buf.take(at))
            k = wanted.get(t)
            if k is not None:
                if k >= bits.shape[1]:
                    bits = np.concatenate([bits, np.zeros_like(bits[:, : max(SAMPLES, bits.shape[1] // 4)])], axis=1)
                bits[who, k] = row >> 1
            row &= 1
            at += row
            t += 1
        live = buf[at] != END
        if not live.all():
            walked[who[~live]] = t
            who, at = who[live], at[live]
    ends = np.searchsorted(steps, walked)
    for j, i in enumerate(some):
        out[i] = (int(walked[j]), np.packbits(bits[j, : ends[j]]).tobytes())
    return out


def show(print_: tuple[int, bytes]) -> str:
    return f"{print_[0]:x}:{print_[1].hex()}"


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """1 for equal fingerprints, about 0 for unrelated ones: 1 - 2 x weighted share of unlike samples; past the shorter walk's end half count as unlike."""
    if a == b:
        return 1.0
    _, steps, weight = _walk()
    low, high = (int(np.searchsorted(steps, f(a[0], b[0]))) for f in (min, max))
    if not low:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(p[1], np.uint8), count=int(np.searchsorted(steps, p[0])))[:low] for p in (a, b))
    unlike = weight[:low][x != y].sum() + weight[low:high].sum() / 2
    return float(min(1.0, max(0.0, 1.0 - 2.0 * unlike / weight[:high].sum())))


def parse(shown: str) -> tuple[int, bytes]:
    walked, _, bits = shown.partition(":")
    return int(walked, 16), bytes.fromhex(bits)


def embed_all(texts: list[str]) -> list[tuple[int, bytes]]:
    """embed() in groups of texts of like length and bounded size."""
    out: list = [None] * len(texts)
    order, group, size = sorted(range(len(texts)), key=lambda i: len(texts[i])), [], 0
    for i in order:
        group.append(i)
        size += len(texts[i]) + 1600
        if size > _GROUP:
            for j, p in zip(group, embed([texts[j] for j in group]), strict=True):
                out[j] = p
            group, size = [], 0
    for j, p in zip(group, embed([texts[j] for j in group]), strict=True):
        out[j] = p
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint of each whole text as a string; null counts as the empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([show(p) for p in embed_all([t or "" for t in array.to_pylist()])], pa.string())

    return run.asNondeterministic()(text)  # evaluated once


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first code points of the following text, or all of them."""
    tail = len(text) // 3
    return text[: len(text) - tail] + following[:tail]


def _chain(docs: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """(part, extra, id, text): documents dealt by ranges of descending id; `extra` is a copy of the next part's first row.

    The bounds are quantiles of the ids, one per `rows` documents and 10,000 at most; null ids come last. A part is read
    as a sorted stream, so its size costs time only. Rows of one id are in one part.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = d.count()
    parts = max(1, min(10_000, -(-n // rows)))
    bounds = sorted(set(d.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []))
    limits = np.array(bounds)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        got = len(limits) - np.searchsorted(limits, np.asarray(pc.fill_null(ids, 0)), side="left")
        return pa.array(np.where(np.asarray(ids.is_null()), len(limits), got).astype(np.int32))

    d = d.select(part("id").alias("part"), "id", "text")
    firsts = [(r.part, r.id) for r in d.groupBy("part").agg(F.max("id").alias("id")).orderBy("part").collect()]  # a row per part
    heads = spark.createDataFrame([(i, firsts[j - 1][0]) for j, (_, i) in enumerate(firsts)], "head long, target int")
    met = d.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")), "left")  # at most 10,000 rows
    own, extra = F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(F.col("target").alias("part"), F.lit(True).alias("extra"))
    spread = met.select(F.explode(F.when(F.col("target").isNotNull(), F.array(own, extra)).otherwise(F.array(own))).alias("c"), "id", "text")
    spread = spread.select("c.part", "c.extra", "id", "text")
    return spread.repartition(max(1, min(len(firsts), max(partitions(spark), len(firsts) // 8))), "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("id"), "text")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 1024) -> DataFrame:
    """Per document: id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id (ties: by text), after the last the first; a document alone is
    its own next. A null text is empty; an empty text has an empty fingerprint, is like another empty one (1) and unlike
    all others (0). Rows that repeat an id or all of it are documents of their own, which follow each other. Null ids come
    last. Very long texts walk to their end. An empty table gives an empty result; other columns are not read. Texts are
    shuffled once.
    """
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def flush(stretches: list[tuple[list, list[str]]]) -> Iterator[pa.RecordBatch]:
        """Stretches of (ids, texts), the last text of each being the next of the one before it."""
        prints = embed_all([t for _, texts in stretches for t in texts])
        made = [edited(a, b) for _, texts in stretches for a, b in zip(texts, texts[1:], strict=False)]
        others = embed_all(made)
        at = done = 0
        for ids, texts in stretches:
            own, new, mine = prints[at : at + len(texts)], others[done : done + len(ids)], made[done : done + len(ids)]
            at, done = at + len(texts), done + len(ids)
            near = [likeness(a, b) for a, b in zip(own, new, strict=False)]
            nxt = [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]
            for a in range(0, len(ids), 512):
                s = slice(a, min(a + 512, len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[s], texts[s], mine[s], list(map(show, own[s])), list(map(show, new[s])), near[s], nxt[s]), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, ready, size = None, [], [], [], 0
        done = False  # this part's first extra row has been used
        for batch in batches:
            for part, extra, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, ids, texts, done = part, [], [], False
                if extra and done:
                    continue
                texts.append(t)
                if extra or size > _HELD:
                    ready.append((ids, texts))
                    ids, texts, done = [], [t], extra
                    if size > _HELD:
                        yield from flush(ready)
                        ready, size = [], 0
                if not extra:
                    ids.append(i)
                    size += len(t)
        if ready:
            yield from flush(ready)

    return _chain(docs, key, text, rows).mapInArrow(run, "id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@lru_cache(maxsize=128)
def _pool(k: int) -> np.ndarray:
    """The samples of each band of the steps below 2 ** (k / 2): a fixed draw by the steps that they stand for; all, if they are few."""
    _, steps, weight = _walk()
    n = int(np.searchsorted(steps, 2 ** (k / 2)))
    if n <= BAND:
        return np.arange(n)[None, :]
    rng = np.random.default_rng([SEED, k])
    return np.stack([np.sort(rng.choice(n, BAND, replace=False, p=weight[:n] / weight[:n].sum())) for _ in range(BANDS)])


def bands(print_: tuple[int, bytes]) -> np.ndarray:
    """64-bit names of the bands of a fingerprint; none for that of the empty text."""
    walked, packed = print_
    if walked < 2:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    top = int(np.floor(2 * np.log2(walked)))
    out = []
    for k in (top - 1, top):
        if not (pick := _pool(k)).size:
            continue
        shown = np.zeros((len(pick), 4), np.uint8)
        packed = np.packbits(bits[pick], axis=1)
        shown[:, : packed.shape[1]] = packed
        out.append(hashing.mix((np.uint64(k) << np.uint64(48)) + (np.arange(len(pick), dtype=np.uint64) << np.uint64(40)) + shown.view("<u4").ravel().astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _padded(packed: list[bytes], sizes: np.ndarray, own: np.ndarray, weight: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Likenesses of a fingerprint's samples to others of `sizes` samples."""
    m, top = len(own), int(sizes.max())
    width = -(-top // 8)
    bits = np.unpackbits(np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in packed), np.uint8).reshape(len(packed), width), axis=1)
    both = min(m, top)
    unlike = (bits[:, :both] != own[:both]) & (np.arange(both) < sizes[:, None])
    low, high = np.minimum(sizes, m), np.maximum(sizes, m)
    return 1 - 2 * (unlike @ weight[:both] + (upto[high] - upto[low]) / 2) / upto[high]


class _Members:
    """The classes linked to one leader: names, samples, and the unlike steps between each and the leader."""

    def __init__(self):
        self.n, self.names, self.packed = 0, [], []
        self.sizes, self.far = np.zeros(4, np.int64), np.zeros(4)

    def add(self, name: int, packed: bytes, size: int, far: float) -> None:
        if self.n == len(self.sizes):
            self.sizes, self.far = np.r_[self.sizes, np.zeros(self.n, np.int64)], np.r_[self.far, np.zeros(self.n)]
        self.sizes[self.n], self.far[self.n] = size, far
        self.names.append(name)
        self.packed.append(packed)
        self.n += 1


def _bucket_links(at_least: float):
    """Sorted rows (band, c, fingerprint) -> links (a, b), a > b, that join all classes of a bucket which its links join.

    A bucket is read as a stream: a class is compared with the bucket's leaders, the classes before it that were linked to
    none of the leaders then. Unlike steps are a distance (a step past an end counts half), so a member of a leader can be linked to the class
    only if both are about as far from that leader; such members are compared too, unless their leader is joined to the
    class already. Members are held packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, steps, weight = _walk()
        upto = np.r_[0.0, np.cumsum(weight)]
        place = np.arange(len(steps))
        now, leaders, sizes, bits = None, [], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8)
        members: list[_Members] = []
        most_far, longest = np.zeros(0), np.zeros(0, np.int64)  # of each leader's members
        root: list[int] = []  # of each leader: another that it is joined to, or itself

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for batch in batches:
            links: tuple[list, list] = ([], [])
            for band, c, shown in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                walked, packed = parse(shown)
                m = int(np.searchsorted(steps, walked))
                own = np.unpackbits(np.frombuffer(packed, np.uint8), count=m)
                if band != now:
                    now, leaders, sizes, bits = band, [], np.zeros(8, np.int64), np.zeros((8, m), np.uint8)
                    members, root, most_far, longest = [], [], np.full(8, -np.inf), np.zeros(8, np.int64)
                k = len(leaders)
                joined: list[int] = []
                far = np.zeros(0)
                if k:
                    both = min(m, bits.shape[1])
                    unlike = (bits[:k, :both] != own[:both]) & (place[:both] < sizes[:k, None])
                    low, high = np.minimum(sizes[:k], m), np.maximum(sizes[:k], m)
                    far = unlike @ weight[:both] + (upto[high] - upto[low]) / 2
                    near = 1 - 2 * far / upto[high]
                    joined = np.flatnonzero(near >= at_least).tolist()
                    links[0].extend([c] * len(joined))
                    links[1].extend(leaders[i] for i in joined)
                home = joined[0] if joined else k
                for i in joined[1:]:
                    root[top(i)] = top(home)
                if home == k:  # a leader from now on
                    if k == len(sizes):
                        sizes, bits = np.r_[sizes, np.zeros(k, np.int64)], np.concatenate([bits, np.zeros_like(bits)])
                        most_far, longest = np.r_[most_far, np.full(k, -np.inf)], np.r_[longest, np.zeros(k, np.int64)]
                    if m > bits.shape[1]:
                        bits = np.concatenate([bits, np.zeros((len(bits), m - bits.shape[1]), np.uint8)], axis=1)
                    sizes[k] = m
                    bits[k, :m] = own
                    leaders.append(c)
                    members.append(_Members())
                    root.append(k)
                for i in np.flatnonzero(far - most_far[:k] <= (1 - at_least) / 2 * upto[np.maximum(longest[:k], m)] + 1e-6 * upto[m]).tolist():
                    if top(i) == top(home):
                        continue
                    of = members[i]
                    most = (1 - at_least) / 2 * upto[np.maximum(of.sizes[: of.n], m)]
                    could = np.flatnonzero(np.abs(far[i] - of.far[: of.n]) <= most + 1e-6 * upto[m])
                    for at in range(0, len(could), 1024):
                        some = could[at : at + 1024]
                        hit = np.flatnonzero(_padded([of.packed[j] for j in some], of.sizes[some], own, weight, upto) >= at_least)
                        if len(hit):
                            other = of.names[int(some[hit[0]])]
                            links[0].append(max(c, other))
                            links[1].append(min(c, other))
                            root[top(i)] = top(home)
                            break
                if home < k:
                    members[home].add(c, packed, m, float(far[home]))
                    most_far[home], longest[home] = max(most_far[home], far[home]), max(longest[home], m)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    return run


def _components(links: DataFrame) -> DataFrame:
    """(id, label) of links a > b: first by one link of each a, then by those that join what these left apart. A large group
    of copies has some ten links a member; only one of them goes through the rounds."""
    comp = connected_components(links.groupBy("a").agg(F.min("b").alias("b")))
    label = lambda own, to: comp.select(F.col("id").alias(own), F.col("label").alias(to))
    apart = links.join(label("a", "la"), "a").join(label("b", "lb"), "b").where("la <> lb")
    across = connected_components(apart.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    joined = comp.join(across.select(F.col("id").alias("label"), F.col("label").alias("whole")), "label", "left")
    return joined.select("id", F.coalesce("whole", "label").alias("label"))


def near_duplicates(prints: DataFrame, key: str = "doc_id", shown: str = "fingerprint", at_least: float = 0.8) -> DataFrame:
    """(c, near_id): c is xxhash64 of a fingerprint, near_id the smallest id of the documents linked to it by likeness >= at_least.

    Equal fingerprints are one class; its first member's bands are buckets. The classes of a bucket are joined as comparing all
    of them would join them; what is linked is verified. Two classes without a band in common and without others between
    them aren't found.
    Classes of one document without links are absent, and so are null fingerprints and those of empty texts, which link
    with nothing. Null ids never name a group unless all its ids are null.
    """
    p = prints.select(F.col(key).alias("id"), F.col(shown).alias("fp")).where(F.col("fp").isNotNull() & (F.col("fp") != "0:")).withColumn("c", F.xxhash64("fp"))
    copies = cut(p.groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("c", "least"), "copies")
    first = p.join(copies, "c", "left").where("least IS NULL OR id = least").select("c", "fp")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bands(parse(s)) for s in batch.column(1).to_pylist()]
            c = np.repeat(np.asarray(batch.column(0)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(c, pa.int64())], ["band", "c"])

    bucket = Window.partitionBy("band")
    met = first.mapInArrow(deal, "band long, c long").withColumns({"head": F.min("c").over(bucket), "last": F.max("c").over(bucket)})
    met = cut(met.where("head <> last").select("band", "c"), "met")
    shown_too = met.join(first.dropDuplicates(["c"]), "c").select("band", "c", "fp").repartition("band").sortWithinPartitions("band", "c")
    comp = cut(_components(cut(shown_too.mapInArrow(_bucket_links(at_least), "a long, b long").distinct(), "links")), "near")
    # the smallest id of each component: over its classes of several documents, and over its others
    of_one = p.join(comp.select(F.col("id").alias("c"), "label"), "c").select("label", "id")
    of_copies = copies.join(comp.select(F.col("id").alias("c"), "label"), "c", "left").select("c", F.coalesce("label", "c").alias("label"), F.col("least").alias("id"))
    named = of_one.union(of_copies.select("label", "id")).groupBy("label").agg(F.min("id").alias("near_id"))
    members = comp.select(F.col("id").alias("c"), "label").union(of_copies.select("c", "label")).distinct()
    return members.join(named, "label").select("c", "near_id")


def with_near(compared: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = 0.8) -> DataFrame:
    """compared with near_id: the smallest id of the documents linked by likeness >= at_least, else the own id.

    `compared` is compare_with_next(docs), or those of its columns that are wanted, id and fingerprint among them; what it has
    is shuffled by fingerprint, so digests of the texts are better than the texts. The groups are found and written first.
    """
    prints = cut(docs.select(F.col(key).cast("long").alias("doc_id"), fingerprint(F.col(text)).alias("fingerprint")), "prints")
    groups = cut(near_duplicates(prints, at_least=at_least), "groups")
    release(docs.sparkSession)
    joined = compared.withColumn("c", F.xxhash64("fingerprint")).join(groups, "c", "left")
    return joined.withColumn("near_id", F.coalesce("near_id", "id")).drop("c")
