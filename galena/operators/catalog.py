"""Catalogue operators: pages, search, facets, roll-ups, albums, storage dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions import scalars as S


# -- pages -------------------------------------------------------------------
def keyset_page(df: DataFrame, ts: str, key: str, limit: int, cursor: tuple[float, int] | None = None) -> DataFrame:
    """The next `limit` rows and one more in (ts, key) descending order after the cursor: a filter and a top-k, no offset."""
    if cursor is not None:
        at, own = cursor
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < own)))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)


def split_page(rows: list, ts: str, key: str, limit: int) -> tuple[list, str | None]:
    """A page's rows and its next cursor, or none on the last page."""
    page = rows[:limit]
    return page, f"{page[-1][ts]}_{page[-1][key]}" if len(rows) > limit else None


def parse_cursor(text: str | None) -> tuple[float, int] | None:
    if not text:
        return None
    ts, key = text.split("_")
    return float(ts), int(key)


def summary(df: DataFrame) -> DataFrame:
    """The fields that lists show."""
    return df.select("id", "sha256", "size", "filename", "kind", "tier", "capture_ts", "width", "height", "favorite", F.col("lat").isNotNull().alias("has_location"), "trashed_at")


def detail(df: DataFrame, exif: str = "exif_json") -> DataFrame:
    """All fields, with the parsed EXIF map (empty for none)."""
    parsed = F.coalesce(F.from_json(F.col(exif), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return df.withColumn("exif", parsed).withColumn("has_location", F.col("lat").isNotNull()).drop(exif)


# -- filters -----------------------------------------------------------------
def contains(name: Column, query: str, escape: bool = False) -> Column:
    """Case-insensitive containment; `%` and `_` in the query are wildcards unless escaped. Folds all of Unicode."""
    if escape:
        query = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return name.ilike(f"%{query}%")


def search_predicates(date_from: float | None = None, date_to: float | None = None, camera: str | None = None, kind: str | None = None, query: str | None = None, cells: list[str] | None = None) -> list[Column]:
    """Conjuncts of the arguments that are given: half-open dates, camera by model or make, known kinds only, name, cells of one precision."""
    out = []
    if date_from is not None:
        out.append(F.col("capture_ts") >= date_from)
    if date_to is not None:
        out.append(F.col("capture_ts") < date_to)
    if camera:
        out.append((F.col("camera_model") == camera) | (F.col("camera_make") == camera))
    if kind in ("image", "video", "other"):
        out.append(F.col("kind") == kind)
    if query:
        out.append(contains(F.col("filename"), query))
    if cells:
        out.append(F.substring("geohash", 1, len(cells[0])).isin(cells))
    return out


def search(df: DataFrame, limit: int = 200, **arguments) -> DataFrame:
    """Top files by capture time (ties: id, descending) that meet every given argument."""
    held = reduce(lambda d, c: d.where(c), search_predicates(**arguments), df)
    return held.orderBy(F.desc("capture_ts"), F.desc("id")).limit(limit)


# -- facets and roll-ups -----------------------------------------------------
def months(df: DataFrame, ts: Column) -> DataFrame:
    """(month, n, latest) of epoch seconds, in UTC."""
    return df.groupBy(F.date_format(F.timestamp_seconds(ts), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))


def camera_facets(df: DataFrame) -> DataFrame:
    return df.where(F.col("trashed_at").isNull() & F.col("camera_model").isNotNull()).groupBy("camera_make", "camera_model").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def albums_with_cover(albums: DataFrame, items: DataFrame) -> DataFrame:
    """(album_id, n, cover): the explicit cover, else the item with the latest (ts, file_id); albums without items have n = 0."""
    per = items.groupBy("album_id").agg(F.count("*").alias("n"), F.max_by("file_id", F.struct("ts", "file_id")).alias("latest"))
    return albums.join(per, "album_id", "left").select("album_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cover_file_id", "latest").alias("cover"))


def count_with_zeros(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Rows of dim with the number of fact rows of their key, 0 for none."""
    n = fact.groupBy(key).agg(F.count("*").alias("n"))
    return dim.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose key new lacks."""
    return new.unionByName(old.join(new, keys, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and one row per key of new that old lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def keep_newest(df: DataFrame, partition: list[Column], order: Column, n: int) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn("kept", F.row_number().over(w) <= n)


def day_runs(df: DataFrame, ts: str, key: str, partition: str | None = None) -> DataFrame:
    """(run, day, n): maximal runs of equal days in (ts, key) descending order, per partition: gaps and islands."""
    by = [partition] if partition else []
    w = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(key))
    day = df.withColumn("day", F.to_date(F.timestamp_seconds(F.col(ts))))
    marked = day.withColumn("new", F.coalesce((F.col("day") != F.lag("day").over(w)).cast("int"), F.lit(1)))
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).groupBy(*by, "run", "day").agg(F.count("*").alias("n"))


# -- storage -----------------------------------------------------------------
READABLE, WRITABLE = ("online", "degraded", "rebuilding"), ("online", "rebuilding")


def capacity(disks: DataFrame, shards: DataFrame, k: int, m: int, header: int = 256) -> DataFrame:
    """One row: raw capacity of disks in use, free bytes of readable ones, usable share k/(k+m), bytes of good shards with their headers, mode."""
    d = disks.agg(
        F.coalesce(F.sum(F.when(F.col("status") != "retired", F.col("capacity_bytes"))), F.lit(0)).cast("long").alias("raw_bytes"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*READABLE), F.col("free_bytes"))), F.lit(0)).cast("long").alias("free_bytes"),
    )
    s = shards.agg(F.coalesce(F.sum(F.when(F.col("state") == "ok", F.col("shard_size") + header)), F.lit(0)).cast("long").alias("physical_bytes"))
    usable = F.floor(F.col("raw_bytes") * k / (k + m)).cast("long").alias("usable_bytes")
    return d.crossJoin(s).select("raw_bytes", "free_bytes", usable, "physical_bytes", F.lit("mirror" if k == 1 else "erasure").alias("mode"))  # one row each


def needing_repair(shards: DataFrame, disks: DataFrame) -> DataFrame:
    """Stripes with a shard that is not ok, on no disk, or on a disk that can't be read."""
    d = disks.select(F.col("id").alias("disk_id"), "status")
    bad = (F.col("state") != "ok") | F.col("status").isNull() | ~F.col("status").isin(*READABLE)
    return shards.join(F.broadcast(d), "disk_id", "left").where(bad).groupBy("object_id", "seq").agg(F.count("*").alias("bad"))


def profile(disks: Column, k: int, m: int) -> Column:
    """struct<k, m> that n disks allow: the wished one, else mirroring on at most three, else a single copy; null for none."""
    rule = lambda a, b: F.struct(F.lit(a).cast("int").alias("k"), b.cast("int").alias("m"))
    return F.when(disks >= k + m, rule(k, F.lit(m))).when(disks >= 2, rule(1, F.least(disks - 1, F.lit(2)))).when(disks == 1, rule(1, F.lit(0)))


def quorum(k: int, m: int, extra: int, landed: Column) -> Column:
    """Whether enough shards landed to commit a stripe."""
    return landed >= min(k + m, k + extra)


def rebuild_progress(tasks: DataFrame, now: Column) -> DataFrame:
    """rate (bytes a second, 0 before any time has passed) and eta (seconds, while running with something done)."""
    elapsed = now - F.col("started_at")
    rate = F.when(elapsed > 0, F.col("bytes_written") / elapsed).otherwise(F.lit(0.0))
    eta = F.when((F.col("state") == "running") & (F.col("done_stripes") > 0), (F.col("total_stripes") - F.col("done_stripes")) * elapsed / F.col("done_stripes"))
    return tasks.withColumn("rate", rate).withColumn("eta", eta)


def exclusive_quantile(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles by the exclusive method: linear between order statistics at p (n + 1) / 100; p50 is the upper median.

    Order statistics come from a sorted window, which spills, so no group is held in memory. Groups of one row are left out.
    """
    rows = df.where(F.col(value).isNotNull())
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    ranked = rows.select(*keys, F.col(value).alias("_v"), rank.alias("_r")).join(n, keys)

    def at(p: int) -> Column:
        if p == 50:
            return F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("_v")))
        m = F.col("_n") + 1
        j = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(F.lit(p) * m / 100)))
        delta = F.lit(p) * m - j * 100
        return F.sum(F.when(F.col("_r") == j, F.col("_v") * (100 - delta)).when(F.col("_r") == j + 1, F.col("_v") * delta)) / 100

    return ranked.groupBy(*keys).agg(*[at(p).alias(f"p{p}") for p in percents])


# -- lifecycle ---------------------------------------------------------------
def trash(files: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """files with the given ids trashed; those already trashed keep their time."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    j = files.join(hit, files["id"] == hit["_id"], "left")
    return j.withColumn("trashed_at", F.when(F.col("_id").isNotNull() & F.col("trashed_at").isNull(), F.lit(now)).otherwise(F.col("trashed_at"))).drop("_id")


def restore(files: DataFrame, ids: DataFrame) -> DataFrame:
    """files with the given ids out of the trash; purged ones stay purged."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    j = files.join(hit, files["id"] == hit["_id"], "left")
    return j.withColumn("trashed_at", F.when(F.col("_id").isNotNull() & F.col("purged_at").isNull(), F.lit(None)).otherwise(F.col("trashed_at"))).drop("_id")


def purge(files: DataFrame, now: float, ids: DataFrame | None = None) -> DataFrame:
    """files with trashed ones (all, or those of ids) turned into tombstones; a file that isn't trashed never is."""
    due = F.col("trashed_at").isNotNull() & F.col("purged_at").isNull()
    if ids is None:
        return files.withColumn("purged_at", F.when(due, F.lit(now)).otherwise(F.col("purged_at")))
    hit = ids.select(F.col("id").alias("_id")).distinct()
    j = files.join(hit, files["id"] == hit["_id"], "left")
    return j.withColumn("purged_at", F.when(due & F.col("_id").isNotNull(), F.lit(now)).otherwise(F.col("purged_at"))).drop("_id")


def cells_of(df: DataFrame, precision: int = 9) -> DataFrame:
    return df.withColumn("geohash", S.geohash(F.col("lat"), F.col("lon"), precision))
