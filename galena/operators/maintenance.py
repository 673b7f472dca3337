"""Upkeep of the store and the catalogue: scrub, evacuation, restriping, cascades, crash recovery, album and client states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions import scalars as S
from galena.operators import sync


# -- store -------------------------------------------------------------------
def scrub_summary(states: DataFrame, k: int) -> DataFrame:
    """One row from shard states (object_id, seq, state): stripes, bad shards, stripes repaired and beyond repair."""
    bad = F.count_if(F.col("state") != "ok")
    per = states.groupBy("object_id", "seq").agg(F.count("*").alias("n"), bad.alias("bad"))
    lost = F.col("n") - F.col("bad") < k
    return per.agg(F.count("*").alias("stripes"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_shards"), F.count_if((F.col("bad") > 0) & ~lost).alias("repaired"), F.count_if(lost).alias("unrecoverable"))


def evacuate(shards: DataFrame, disks: DataFrame, source: int) -> DataFrame:
    """(object_id, seq, idx, disk_id, state): new places of the shards on a disk: a writable disk that holds no shard of the stripe, the freest by id, a stripe's shards on different ones.

    A shard that no disk can take is missing on no disk. Disks are few; each stripe is placed on its own.
    """
    able = disks.where(F.col("status").isin("online", "rebuilding") & (F.col("id") != source)).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("free_bytes")).alias("f"), "id"))), lambda x: x["id"]).alias("able"))
    held = shards.groupBy("object_id", "seq").agg(F.collect_set(F.when(F.col("disk_id") != source, F.col("disk_id"))).alias("held"), F.array_sort(F.collect_list(F.when(F.col("disk_id") == source, F.col("idx")))).alias("moved"))
    j = held.where(F.size("moved") > 0).join(F.broadcast(able))  # one row
    free = F.array_except("able", "held")
    out = j.select("object_id", "seq", free.alias("free"), F.posexplode("moved").alias("n", "idx"))
    disk = F.get("free", F.col("n"))
    return out.select("object_id", "seq", "idx", disk.alias("disk_id"), F.when(disk.isNull(), "missing").otherwise("ok").alias("state"))


def needing_restripe(stripes: DataFrame, k: Column, m: Column) -> DataFrame:
    """Objects with a stripe of another profile."""
    return stripes.where((F.col("k") != k) | (F.col("m") != m)).select("object_id").distinct()


def delete_objects(objects: DataFrame, stripes: DataFrame, shards: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the objects of the given keys and all that hangs on them."""
    gone = objects.join(keys, "key", "left_semi").select(F.col("id").alias("object_id"))
    return objects.join(keys, "key", "left_anti"), stripes.join(gone, "object_id", "left_anti"), shards.join(gone, "object_id", "left_anti")


def committed_only(objects: DataFrame, stripes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: neither pending objects, nor pending stripes, nor stripes of objects that are gone."""
    o = objects.where("state = 'committed'")
    return o, stripes.where("state <> 'pending'").join(o.select(F.col("id").alias("object_id")), "object_id", "left_semi")


def to_evacuate(disks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failed disks without a task that is queued or running."""
    active = tasks.where(F.col("state").isin("queued", "running")).select(F.col("disk_id").alias("id"))
    return disks.where("status = 'failed'").join(active, "id", "left_anti").select("id")


def health_margin(disks: DataFrame, m: int) -> DataFrame:
    """One row: failed disks, and how many more may fail."""
    return disks.agg(F.count_if(F.col("status") == "failed").alias("failed")).withColumn("margin", m - F.col("failed"))


# -- chunks ------------------------------------------------------------------
def compact(placed: DataFrame, victims: DataFrame, live: DataFrame, first_new: int) -> DataFrame:
    """(hash, batch_id, raw_offset, size): live chunks of the victims appended, in order, to one new batch; other batches stay."""
    moved = placed.join(victims.select("batch_id"), "batch_id", "left_semi").join(live.select("hash").distinct(), "hash", "left_semi")
    # a batch's chunks come after all of the batches before it: totals per batch first, so no task orders all chunks
    total = moved.groupBy("batch_id").agg(F.sum("size").alias("s"))
    ahead = total.select("batch_id", F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("batch_id").orderBy("raw_offset", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed_again = moved.withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(ahead, "batch_id")
    new = placed_again.select("hash", F.lit(first_new).cast("long").alias("batch_id"), (F.col("ahead") + F.col("at")).alias("raw_offset"), "size")
    return placed.join(victims.select("batch_id"), "batch_id", "left_anti").select("hash", "batch_id", "raw_offset", "size").unionByName(new)


def open_batch(batches: DataFrame) -> DataFrame:
    return batches.where("state = 'open'").agg(F.min("id").alias("id"))


# -- catalogue ---------------------------------------------------------------
def exif_fields(tags: Column) -> Column:
    """struct<make, model, width, height, lat, lon, ts, has_tz> of a map of EXIF tags: orientations 5 to 8 swap the sides; places out of range and (0, 0) don't count."""
    num = lambda k: tags[k].try_cast("double")
    parts = lambda k: F.transform(F.split(tags[k], r"[ ,]+"), lambda x: x.try_cast("double"))
    lat, lon = S.dms(parts("GPSLatitude"), tags["GPSLatitudeRef"]), S.dms(parts("GPSLongitude"), tags["GPSLongitudeRef"])
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    swap = F.coalesce(num("Orientation").between(5, 8), F.lit(False))
    w, h = num("Width").cast("int"), num("Height").cast("int")
    time = S.exif_time(tags["DateTimeOriginal"], tags["OffsetTimeOriginal"])
    return F.struct(F.trim(tags["Make"]).alias("make"), F.trim(tags["Model"]).alias("model"), F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), time["ts"].alias("ts"), time["has_tz"].alias("has_tz"))


def add_to_album(items: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """album_items with the wanted (album_id, file_id) that are new and not purged."""
    keys = ["album_id", "file_id"]
    able = wanted.dropDuplicates(keys).join(files.where("purged_at IS NULL").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return items.select(keys).unionByName(able.select(keys).join(items, keys, "left_anti"))


def upload_status(need: Column, known: Column, processing: Column, attempts: Column, mismatch: Column, most: int = 5) -> Column:
    """A client item's next status."""
    return F.when(mismatch, "rehash").when(attempts >= most, "failed").when(need, "needsUpload").when(processing, "processing").when(known, "synced").otherwise("pending")


def status_buckets(items: DataFrame, buckets: dict[str, list[str]], column: str = "status") -> DataFrame:
    """One row with the number of items of each bucket of statuses."""
    return items.agg(*[F.count_if(F.col(column).isin(v)).alias(k) for k, v in buckets.items()])


def valid_path(path: Column) -> Column:
    return path.rlike(r"\A[0-9a-f]{0,3}\z")


def valid_sha(sha: Column) -> Column:
    return sha.rlike(r"\A[0-9a-f]{64}\z")


def refreshed(nodes: DataFrame, items: DataFrame, touched: DataFrame, depth: int = sync.DEPTH) -> DataFrame:
    """A hash trie after changes: only the buckets of `touched` hashes and the nodes above them are computed again from `items`."""
    prefix = lambda n: touched.select(F.substring(F.lower("sha256"), 1, n).alias("path")).distinct()
    level = sync.leaves(items.join(prefix(depth), F.substring(F.lower("sha256"), 1, depth) == F.col("path"), "left_semi"), depth=depth)
    out = [level]
    for n in range(depth - 1, -1, -1):
        below = nodes.where(F.length("path") == n + 1).join(prefix(n + 1), "path", "left_anti").unionByName(level)
        level = sync.parents(below.join(prefix(n).withColumnRenamed("path", "p"), F.substring("path", 1, n) == F.col("p"), "left_semi") if n else below)
        out.append(level)
    old = reduce(lambda d, n: d.join(prefix(n), "path", "left_anti") if n else d.where("path <> ''"), range(depth, -1, -1), nodes)
    return reduce(DataFrame.unionByName, out, old)
