"""N-gram Jaccard join over whole documents (operator 2): classes of documents linked by Jaccard similarity.

1. Every document's set of word shingles is hashed and dealt by hash: sizes and equality of sets take 64-bit hashes, what
   two sets share takes their upper 48 bits (two sets of 1,000 shingles share one by mistake once in 10^8 pairs). A shingle seen in one document only can't
   be in an intersection, so a document goes on only if enough of its shingles are seen elsewhere: with similarity t it
   must share t times its size. Shingles that fill many documents of one batch are flagged there instead of being sent
   once per document, so the most frequent shingle sends a bounded share of the rows to one task.
2. Equal sets form one class; one representative goes on.
3. Shingles are globally ordered by (documents that hold them, hash). Linked sets share a shingle of their prefixes.
   Sharing one gives coarse groups, found as connected components of star edges.
4. Within a coarse group the ordered sets are stored in a trie; each set walks it, shares the overlap of common paths,
   and drops subtrees whose remaining lengths can't reach the needed overlap. Subtrees already in the walker's component
   are passed over, since only components are wanted. Groups over BLOCK shingles are split into blocks and every pair of
   blocks is a task of its own, so no task holds an unbounded group; each task returns a spanning forest of its links.
5. Components of all links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm import hashing
from galena.operators.graph import connected_components
from galena.session import cut, partitions

#: Shingles per batch of documents; local document count from which a shingle is flagged; shingles per trie.
BATCH, FLAG, BLOCK = 1_000_000, 64, 1_500_000
#: Bytes of text per part at most; bytes of text for each row that goes from a part to another.
EACH, PIECE = 16 << 20, 4 << 10
_EVERYWHERE = np.iinfo(np.int32).max
_NAMES = ("part", "kind", "a", "b", "c", "d", "e", "f")
_SCHEMA = "part int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in _NAMES[2:]])
_DOCS, _TOKENS = 1, 0


def _parts(docs: DataFrame, text: str) -> int:
    """Into how many parts shingles and documents are dealt; it steers memory, not results.

    Every part sends a row to every other one, so the shuffle's partitions count only as far as the texts fill those rows.
    """
    size = hashing.text_bytes(docs, text)
    return max(1, size // EACH, min(2 * partitions(docs.sparkSession), isqrt(size // PIECE)))


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _ARROW, strict=True)], schema=_ARROW)


def _deal(parts: int, k: int):
    """Documents -> shingles dealt by hash, and document rows dealt by key."""

    def flush(keys: list[int], ids: list, sets: list[np.ndarray]) -> pa.Table:
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) >> np.uint64(16)  # order and content hash are those of 64 bits
        key = np.array(keys, np.int64).view(np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(every[order])) + 1, len(every)] if len(every) else np.zeros(1, np.int64)
        flagged = np.zeros(len(every), bool)
        flagged[order] = np.repeat(np.diff(cuts) > FLAG, np.diff(cuts))
        rows = []
        hot = np.unique(every[flagged])
        sent, by = every[~flagged], owner[~flagged]
        part = ((sent >> np.uint64(20)) % np.uint64(parts)).astype(np.uint32)
        hot_part = ((hot >> np.uint64(20)) % np.uint64(parts)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        sent, by = sent[order], by[order]
        for p, a, b in hashing.pieces(part[order]):
            owners, counts = hashing.runs(key[by[a:b]])
            rows.append((p, _TOKENS, hashing.pack48(sent[a:b]), owners, counts, hot[hot_part == p].tobytes(), None, None))
        done = {r[0] for r in rows}
        rows += [(int(p), _TOKENS, None, None, None, hot[hot_part == p].tobytes(), None, None) for p in np.unique(hot_part) if int(p) not in done]
        bucket = (key % np.uint64(parts)).astype(np.uint32)
        own = np.bincount(owner[flagged], minlength=len(sets)).astype(np.uint32)
        starts = np.r_[0, np.cumsum(own, dtype=np.int64)]
        local = every[flagged]
        order = np.argsort(bucket, kind="stable")
        for p, a, b in hashing.pieces(bucket[order]):
            pick = order[a:b]
            known = np.array([ids[i] is not None for i in pick])
            rows.append((
                p, _DOCS, key[pick].tobytes(), np.array([ids[i] if ids[i] is not None else 0 for i in pick], np.int64).tobytes() + known.tobytes(),
                sizes[pick].tobytes(), b"".join(hashing.mix(sets[i] + np.uint64(j)).sum(dtype=np.uint64).tobytes() for i in pick for j in (1, 2)),
                np.concatenate([local[starts[i] : starts[i + 1]] for i in pick]).tobytes(), own[pick].tobytes(),
            ))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hashing.WordHash()
        keys, ids, sets, size = [], [], [], 0
        for batch in batches:
            for key, i, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                keys.append(key)
                ids.append(i)
                sets.append(hashing.shingles(memo.of(hashing.words(text)), k))
                size += len(sets[-1]) + 1
                if size >= BATCH:
                    yield from flush(keys, ids, sets).to_batches()
                    keys, ids, sets, size = [], [], [], 0
        if keys:
            yield from flush(keys, ids, sets).to_batches()

    return run


def _shared(parts: int):
    """The rows of one part -> for each document's key its shingles that other documents hold too, with their counts."""

    def run(table: pa.Table) -> pa.Table:
        out = [tuple(r[c] for c in _NAMES) for r in table.filter(pc.equal(table["kind"], _DOCS)).to_pylist()]
        t = table.filter(pc.equal(table["kind"], _TOKENS))
        token = hashing.unpack48(t["a"].to_pylist())
        owner = np.repeat(hashing.joined(t["b"]), hashing.joined(t["c"], np.uint32))
        hot = np.unique(hashing.joined(t["d"]))
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(token)) + 1, len(token)] if len(token) else np.zeros(1, np.int64)
        count = np.diff(cuts)
        often = np.isin(token[cuts[:-1]], hot) if len(hot) and len(token) else np.zeros(len(count), bool)
        spread = np.where(often, _EVERYWHERE, count).astype(np.int32)
        keep = np.repeat((count > 1) | often, count)
        token, owner, spread = token[keep], owner[keep], np.repeat(spread, count)[keep]
        bucket = (owner % np.uint64(parts)).astype(np.uint32)
        order = np.lexsort((owner, bucket))
        token, owner, spread = token[order], owner[order], spread[order]
        for p, a, b in hashing.pieces(bucket[order]):
            owners, counts = hashing.runs(owner[a:b])
            out.append((p, _TOKENS, hashing.pack48(token[a:b]), owners, counts, spread[a:b].tobytes(), None, None))
        return _rows(out)

    return run


def _gather(numerator: int, denominator: int):
    """The rows of one bucket of documents -> a row per document; ordered shingles for those that can have links."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        d = table.filter(pc.equal(table["kind"], _DOCS))
        t = table.filter(pc.equal(table["kind"], _TOKENS))
        key, n = hashing.joined(d["a"]), hashing.joined(d["c"], np.int64)
        ids, known = [], []
        for blob, size in zip(d["b"].to_pylist(), (len(x) // 8 for x in d["a"].to_pylist()), strict=True):
            ids.append(np.frombuffer(blob, np.int64, size))
            known.append(np.frombuffer(blob, bool, size, 8 * size))
        ids, known = np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(known or [np.zeros(0, bool)])
        sig = b"".join(d["d"].to_pylist())
        owner = np.concatenate([np.repeat(hashing.joined(t["b"]), hashing.joined(t["c"], np.uint32)), np.repeat(key, hashing.joined(d["f"], np.uint32))])
        spread = hashing.joined(t["d"], np.int32)
        token = np.concatenate([hashing.unpack48(t["a"].to_pylist()), hashing.joined(d["e"])])
        spread = np.concatenate([spread, np.full(len(token) - len(spread), _EVERYWHERE, np.int32)])
        unique, first = np.unique(key, return_index=True)  # a repeated row has its row's key; the first stands for all
        at = np.searchsorted(unique, owner)
        order = np.lexsort((token, spread, at))
        at, token = at[order], token[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (token[1:] != token[:-1])
        at, token = at[new], token[new]
        starts = np.searchsorted(at, np.arange(len(unique) + 1))
        tokens: list = [None] * len(key)
        for u, i in enumerate(first.tolist()):
            m = int(starts[u + 1] - starts[u])
            if n[i] and m * denominator >= numerator * int(n[i]):
                tokens[i] = hashing.pack48(token[starts[u] : starts[u + 1]])
        return pa.Table.from_arrays([
            pa.array(key.view(np.int64)), pa.array(ids, mask=~known), pa.array(n), pa.array([sig[16 * i : 16 * i + 16] for i in range(len(key))], pa.binary()), pa.array(tokens, pa.binary()),
        ], schema=schema)

    return run


class _Node:
    __slots__ = ("children", "docs", "end", "longest", "most", "least", "rep", "seq", "start", "uniform")

    def __init__(self, start: int, end: int, seq: np.ndarray):
        self.start, self.end, self.seq = start, end, seq
        self.children, self.docs, self.uniform, self.rep = [], [], False, -1


def prefix_tree(sets: list[np.ndarray], sizes: list[int]) -> _Node:
    """A compressed trie of ordered integer sequences; nodes know the longest sequence and the sizes of sets below."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    root = _Node(0, 0, np.zeros(0, np.int64))
    path, before = [root], np.zeros(0, np.int64)
    for i in order:
        s = sets[i]
        m = min(len(s), len(before))
        unlike = np.flatnonzero(s[:m] != before[:m])
        common = int(unlike[0]) if len(unlike) else m
        last = None
        while path[-1].end > common:
            last = path.pop()
        if path[-1].end < common:
            middle = _Node(path[-1].end, common, before)
            path[-1].children[-1] = middle
            last.start = common
            middle.children.append(last)
            path.append(middle)
        if path[-1].end == len(s):
            path[-1].docs.append(i)
        else:
            leaf = _Node(common, len(s), s)
            leaf.docs.append(i)
            path[-1].children.append(leaf)
            path.append(leaf)
        before = s
    below, at = [root], 0
    while at < len(below):
        below += below[at].children
        at += 1
    for node in reversed(below):
        node.longest = max([node.end, *(c.longest for c in node.children)])
        own = [sizes[i] for i in node.docs]
        node.least = min([*own, *(c.least for c in node.children)], default=0)
        node.most = max([*own, *(c.most for c in node.children)], default=0)
    return root


def linked(sets: list[np.ndarray], sizes: list[int], numerator: int, denominator: int, probes: list[int] | None = None, stored: list[int] | None = None) -> list[int]:
    """For each set the index of a set of its component (its own, if it stands for it).

    sets: ordered arrays of small integers (their common order), each a part of a set of sizes[i] elements whose other
    elements no other set holds. Links: denominator * overlap >= numerator * union. If probes and stored are given, only
    links between the two are looked for.
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stored = list(range(len(sets))) if stored is None else stored
    root = prefix_tree([sets[i] for i in stored], [sizes[i] for i in stored])
    space = 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
    inside = np.zeros(space, np.uint8)
    both = numerator + denominator
    for x in range(len(sets)) if probes is None else probes:
        own, n = sets[x], sizes[x]
        inside[own] = 1
        here = find(x)
        seen, todo = [], [(root, 0, len(own))]
        while todo:
            node, got, rest = todo.pop()
            if node.uniform and find(node.rep) == here:
                continue
            if node.most * denominator < numerator * n or n * denominator < numerator * node.least:
                continue
            if both * (got + min(node.longest - node.start, rest)) < numerator * (n + node.least):
                continue
            if node.end > node.start:
                run = node.seq[node.start : node.end]
                got += int(inside[run].sum())
                rest = len(own) - int(np.searchsorted(own, run[-1], side="right"))
                if both * (got + min(node.longest - node.end, rest)) < numerator * (n + node.least):
                    continue
            seen.append(node)
            for i in node.docs:
                y = stored[i]
                if both * got >= numerator * (n + sizes[y]) and (there := find(y)) != here:
                    low, high = min(here, there), max(here, there)
                    parent[high] = here = low
            todo += [(c, got, rest) for c in node.children]
        for node in reversed(seen):
            if not node.uniform and all(c.uniform for c in node.children):
                members = [c.rep for c in node.children] + [stored[i] for i in node.docs]
                if members and len({find(i) for i in members}) == 1:
                    node.uniform, node.rep = True, members[0]
        inside[own] = 0
    return [find(i) for i in range(len(sets))]


def unpack_ranked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the common order, and how many representatives hold each."""
    m = len(blob) // 10
    return hashing.unpack48([blob[: 6 * m]]), np.frombuffer(blob, np.int32, m, 6 * m)


def _join_block(numerator: int, denominator: int):
    def run(table: pa.Table) -> pa.Table:
        group, rid, block = (np.asarray(table[c]) for c in ("g", "rid", "block"))
        n, blobs = table["n"].to_pylist(), table["tokens"].to_pylist()
        cross = table["i"][0].as_py() != table["j"][0].as_py() if len(table) else False
        out_a, out_b = [], []
        order = np.argsort(group, kind="stable")
        for _, a, b in hashing.pieces(group[order]):
            pick = order[a:b]
            raw = [unpack_ranked(blobs[i]) for i in pick]
            token, count = (np.concatenate(x) for x in zip(*raw, strict=True))
            rank = np.lexsort((token, count))
            new = np.ones(len(rank), bool)
            new[1:] = token[rank][1:] != token[rank][:-1]
            local = np.empty(len(rank), np.int64)
            local[rank] = np.cumsum(new) - 1
            cuts = np.r_[0, np.cumsum([len(r[0]) for r in raw])]
            sets = [local[cuts[i] : cuts[i + 1]] for i in range(len(raw))]
            sizes = [n[i] for i in pick]
            sides = [int(block[i]) for i in pick]
            if cross:
                first = sides[0]
                stored, probes = [i for i, s in enumerate(sides) if s == first], [i for i, s in enumerate(sides) if s != first]
                roots = linked(sets, sizes, numerator, denominator, probes, stored) if probes else list(range(len(sets)))
            else:
                roots = linked(sets, sizes, numerator, denominator)
            for i, r in enumerate(roots):
                if i != r:
                    out_a.append(int(rid[pick[i]]))
                    out_b.append(int(rid[pick[r]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _labelled(docs: DataFrame, k: int, numerator: int, denominator: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n, sig) of each row, and (sig, n, label, component_id) of the sets that may have links. Both are written or read from written tables."""
    parts = _parts(docs, text)
    packs = 2 * max(parts, 2 * partitions(docs.sparkSession))
    rows = docs.select(F.xxhash64(key, text).alias("key"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.mapInArrow(hashing.trimmed(_deal(parts, k)), _SCHEMA)
    shared = dealt.groupBy("part").applyInArrow(hashing.trimmed_group(_shared(parts)), _SCHEMA)
    base = cut(shared.groupBy("part").applyInArrow(hashing.trimmed_group(_gather(numerator, denominator)), "key long, doc_id long, n long, sig binary, tokens binary"), "sets")

    able = base.where(F.col("tokens").isNotNull())
    classes = cut(able.groupBy("sig", "n").agg(F.min("key").alias("rid"), F.min("doc_id").alias("least")), "classes")
    reps = able.join(classes.select("rid"), F.col("key") == F.col("rid"), "left_semi").select(F.col("key").alias("rid"), "n", "tokens")

    # how many representatives hold a shingle is its place in the common order; it is counted where the sets are dealt again
    ranked = cut(_ranked(reps, parts), "ranked")

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_r, out_t = [], []
            for rid, n, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own, count = unpack_ranked(blob)
                take = max(0, len(own) + (numerator * n) // -denominator + 1)  # m - ceil(t * n) + 1
                out_t.append(own[:take][count[:take] > 1])
                out_r.append(np.full(len(out_t[-1]), rid, np.int64))
            tokens = np.concatenate(out_t) if out_t else np.zeros(0, np.uint64)
            ids = np.concatenate(out_r) if out_r else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens.view(np.int64))], ["rid", "token"])

    heads = ranked.select("rid", "n", "tokens").mapInArrow(prefix, "rid long, token long")
    first = heads.groupBy("token").agg(F.min("rid").alias("head"), F.count("*").alias("c")).where("c > 1")
    near = heads.join(first, "token").where("rid <> head").select("rid", "head").distinct()
    coarse = cut(connected_components(near, "rid", "head").select(F.col("id").alias("rid"), F.col("label").alias("g")), "coarse")

    members = ranked.join(coarse, "rid")
    loads = ranked.select("rid", "n").join(coarse, "rid").groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(loads, "g").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j")))
    placed = placed.select("g", "rid", "n", "tokens", "block", F.when(F.col("blocks") > 1, F.col("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(packs))).alias("pack"), (F.col("blocks") > 1).alias("big"), F.explode(pair).alias("p"))
    links = placed.select("g", "rid", "n", "tokens", "block", "pack", "big", "p.i", "p.j").groupBy("big", "pack", "i", "j").applyInArrow(hashing.trimmed_group(_join_block(numerator, denominator)), "a long, b long")
    found = connected_components(cut(links, "links"))
    labelled = classes.join(found, classes["rid"] == found["id"], "left").select("sig", classes["n"], "least", F.coalesce("label", "rid").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return base.select("key", "doc_id", "n", "sig"), labelled.join(named, "label").select("sig", "n", "label", "component_id")


def components(docs: DataFrame, k: int = 4, numerator: int = 85, denominator: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: component_id is the smallest doc_id reachable by links.

    k words a shingle; links where denominator * |A n B| >= numerator * |A u B|. Null, empty and blank texts have no
    shingle and no link. Rows that repeat a doc_id with another text are documents of their own; null ids never name a
    component unless all its ids are null. Other columns are not read. Shingles are compared by hashes, and rows by a
    64-bit hash of id and text.
    """
    base, by_set = _labelled(docs, k, numerator, denominator, key, text)
    return base.join(by_set, ["sig", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _ranked(reps: DataFrame, parts: int) -> DataFrame:
    """(rid, n, tokens): tokens holds the shingles in the common order (representatives that hold it, hash), then those counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ns, blobs = (batch.column(c).to_pylist() for c in range(3))
            sets = [hashing.unpack48([b]) for b in blobs]
            token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.array(rids, np.int64).view(np.uint64), [len(s) for s in sets])
            part = ((token >> np.uint64(20)) % np.uint64(parts)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            rows = []
            for p, a, b in hashing.pieces(part[order]):
                owners, counts = hashing.runs(owner[order[a:b]])
                rows.append((p, _TOKENS, hashing.pack48(token[order[a:b]]), owners, counts, None, None, None))
            key = np.array(rids, np.int64).view(np.uint64)
            bucket = (key % np.uint64(parts)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            size = np.array(ns, np.int64)
            rows += [(p, _DOCS, key[order[a:b]].tobytes(), size[order[a:b]].tobytes(), None, None, None, None) for p, a, b in hashing.pieces(bucket[order])]
            yield from _rows(rows).to_batches()

    def order(table: pa.Table) -> pa.Table:
        d = table.filter(pc.equal(table["kind"], _DOCS))
        t = table.filter(pc.equal(table["kind"], _TOKENS))
        key, n = hashing.joined(d["a"]), hashing.joined(d["b"], np.int64)
        owner = np.repeat(hashing.joined(t["b"]), hashing.joined(t["c"], np.uint32))
        token, spread = hashing.unpack48(t["a"].to_pylist()), hashing.joined(t["d"], np.int32)
        by = np.argsort(key)
        key, n = key[by], n[by]
        at = np.searchsorted(key, owner)
        rank = np.lexsort((token, spread, at))
        token, spread = token[rank], spread[rank]
        cuts = np.searchsorted(at[rank], np.arange(len(key) + 1))
        blobs = [hashing.pack48(token[a:b]) + spread[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"rid": pa.array(key.view(np.int64)), "n": pa.array(n), "tokens": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        out = [tuple(r[c] for c in _NAMES) for r in table.filter(pc.equal(table["kind"], _DOCS)).to_pylist()]
        t = table.filter(pc.equal(table["kind"], _TOKENS))
        token = hashing.unpack48(t["a"].to_pylist())
        owner = np.repeat(hashing.joined(t["b"]), hashing.joined(t["c"], np.uint32))
        _, inverse, held = np.unique(token, return_inverse=True, return_counts=True)
        spread = held[inverse].astype(np.int32) if len(token) else np.zeros(0, np.int32)
        bucket = (owner % np.uint64(parts)).astype(np.uint32)
        by = np.lexsort((owner, bucket))
        token, owner, spread = token[by], owner[by], spread[by]
        for p, a, b in hashing.pieces(bucket[by]):
            owners, counts = hashing.runs(owner[a:b])
            out.append((p, _TOKENS, hashing.pack48(token[a:b]), owners, counts, spread[a:b].tobytes(), None, None))
        return _rows(out)

    dealt = reps.select("rid", "n", "tokens").mapInArrow(hashing.trimmed(deal), _SCHEMA).groupBy("part").applyInArrow(hashing.trimmed_group(count), _SCHEMA)
    return dealt.groupBy("part").applyInArrow(hashing.trimmed_group(order), "rid long, n long, tokens binary")


def keep_one(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of linked documents, that with the smallest id (null ids last, ties by hash), with all its columns.

    Documents without words link with nothing and stay. Of rows with equal ids and equal texts one stays. An empty table
    gives an empty result.
    """
    base, by_set = _labelled(docs, k, numerator, denominator, key, text)
    own = cut(base.join(by_set.select("sig", "n", "label"), ["sig", "n"], "left").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("label").alias("label"), F.count("*").alias("rows")), "own")
    first = own.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).getField("key").alias("stays"), F.count("*").alias("c")).where("c > 1")
    gone = cut(own.join(first, "label").where("key <> stays").select("key"), "gone")
    name = hashing.free(docs, "row_hash")
    hashed = docs.withColumn(name, F.xxhash64(key, text))
    kept = hashed.join(gone.withColumnRenamed("key", name), name, "left_anti")
    again = cut(own.where("rows > 1").select(F.col("key").alias(name)), "again")
    if again.limit(1).count():
        kept = kept.join(again, name, "left_anti").union(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.drop(name)
