"""Set reconciliation: hash-trie summaries of manifests, their difference, and the three-way split of asked hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.session import cut

DEPTH = 3
EMPTY = "0" * 64
DIGITS = "0123456789abcdef"


def leaves(items: DataFrame, keys: list[str] = (), sha: str = "sha256", depth: int = DEPTH) -> DataFrame:
    """(keys, path, hash): SHA-256 of the sorted raw members of every non-empty bucket; hashes are lower-cased and repeats count once."""
    rows = items.select(*keys, F.lower(sha).alias("h")).distinct()
    members = F.array_sort(F.collect_list("h"))
    return rows.groupBy(*keys, F.substring("h", 1, depth).alias("path")).agg(F.sha2(F.unhex(F.array_join(members, "")), 256).alias("hash"))


def parents(nodes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The level above: SHA-256 of the 16 children in digit order, zeros for empty ones."""
    held = nodes.groupBy(*keys, F.expr("substring(path, 1, length(path) - 1)").alias("up")).agg(F.map_from_entries(F.collect_list(F.struct(F.right("path", F.lit(1)).alias("d"), "hash"))).alias("c"))
    children = F.concat(*[F.coalesce(F.element_at("c", F.lit(x)), F.lit(EMPTY)) for x in DIGITS])
    return held.select(*keys, F.col("up").alias("path"), F.sha2(F.unhex(children), 256).alias("hash"))


def tree(items: DataFrame, keys: list[str] = (), sha: str = "sha256", depth: int = DEPTH) -> DataFrame:
    """(keys, path, hash) of every non-empty node of every level; the root has path ''. Two levels share one shuffle key each."""
    level = leaves(items, keys, sha, depth)
    out = level
    for _ in range(depth):
        level = parents(level, keys)
        out = out.unionByName(level)
    return out


def children(nodes: DataFrame, path: str) -> DataFrame:
    """(digit, hash) of the 16 children of a node, zeros for empty ones."""
    spark = nodes.sparkSession
    digits = spark.createDataFrame([(x,) for x in DIGITS], "digit string")
    own = nodes.where(F.col("path").startswith(path) & (F.length("path") == len(path) + 1)).select(F.right("path", F.lit(1)).alias("digit"), "hash")
    return digits.join(own, "digit", "left").select("digit", F.coalesce("hash", F.lit(EMPTY)).alias("hash"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of nodes whose hashes differ between two trees."""
    j = a.select("path", F.col("hash").alias("x")).join(b.select("path", F.col("hash").alias("y")), "path", "full_outer")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).select("path")


def walk(local: DataFrame, remote: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, touched, differing) of a walk down two trees: each level asks for the children of the differing nodes above it
    only; level 0 asks for the root. The trees and each level's differing nodes are written, so that no level computes those above it again."""
    local, remote = cut(local, "tree"), cut(remote, "tree")
    out, above = None, None
    for level in range(depth + 1):
        own = [t.where(F.length("path") == level) for t in (local, remote)]
        if above is not None:
            up = F.expr(f"substring(path, 1, {level - 1})") if level > 1 else F.lit("")
            own = [t.join(above.withColumnRenamed("path", "up"), up == F.col("up"), "left_semi") for t in own]
        bad = cut(differing(*own), "frontier")
        touched = local.sparkSession.range(1).select(F.lit(1).cast("long").alias("touched")) if above is None else above.agg((F.count("*") * 16).alias("touched"))
        row = touched.crossJoin(bad.agg(F.count("*").alias("differing"))).select(F.lit(level).alias("level"), "touched", "differing")  # one row each
        out, above = row if out is None else out.union(row), bad
    return out


def diff(local: DataFrame, remote: DataFrame, sha: str = "sha256", depth: int = DEPTH) -> DataFrame:
    """(sha256, side): 'missing' on the remote or 'extra' there. Only members of differing buckets meet."""
    bad = differing(leaves(local, sha=sha, depth=depth), leaves(remote, sha=sha, depth=depth)).withColumnRenamed("path", "p")
    pick = lambda df: df.select(F.lower(sha).alias("sha256")).distinct().join(bad, F.substring("sha256", 1, depth) == F.col("p"), "left_semi")
    a, b = pick(local), pick(remote)
    missing = a.join(b, "sha256", "left_anti").withColumn("side", F.lit("missing"))
    return missing.union(b.join(a, "sha256", "left_anti").withColumn("side", F.lit("extra")))


def reconcile(asked: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """(sha256, status): 'linked' if the store has it (tombstones too), 'processing' if a job is queued or running, else 'upload'."""
    a = asked.select(F.lower("sha256").alias("sha256")).distinct()
    known = files.select("sha256").distinct().withColumn("_f", F.lit(True))
    busy = jobs.where(F.col("state").isin("queued", "running")).select("sha256").distinct().withColumn("_j", F.lit(True))
    j = a.join(known, "sha256", "left").join(busy, "sha256", "left")
    return j.select("sha256", F.when(F.col("_f"), "linked").when(F.col("_j"), "processing").otherwise("upload").alias("status"))


def link(manifest: DataFrame, add: DataFrame, remove: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new manifest, the rows really added and the rows really removed. Rows are added first, so what is in both goes."""
    key = ["device_id", "sha256"]
    add, remove = add.distinct(), remove.distinct()
    added = add.join(manifest, key, "left_anti")
    both = manifest.unionByName(added)
    return both.join(remove, key, "left_anti"), added, both.join(remove, key, "left_semi")


def plan_mode(local: Column, remote: Column, same_root: Column) -> Column:
    """'up_to_date' for equal roots; 'bulk' if the server is empty or the counts differ by more than 5 %; else 'merkle'."""
    return F.when(same_root, "up_to_date").when((remote == 0) | (F.abs(local - remote) > 0.05 * F.greatest(local, F.lit(1))), "bulk").otherwise("merkle")


def wire_bytes(frontier: Column, hashes: Column) -> Column:
    """Estimated bytes of a walk: 100 and 1082 a node asked for and 67 a hash."""
    return 100 + 1082 * frontier + 67 * hashes
