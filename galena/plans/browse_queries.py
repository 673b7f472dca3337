"""Queries of the catalogue family."""

from __future__ import annotations

from pyspark.sql import functions as F

from galena.functions import scalars as S
from galena.operators import catalog as C
from galena.plans.registry import Registry
from galena.sources import bindings as B
from galena.sources.bindings import table, with_views

R = Registry()
_SUMMARY = "id, sha256, size, filename, kind, tier, capture_ts, width, height, favorite, lat IS NOT NULL AS has_location, trashed_at"
_LIVE = "trashed_at IS NULL AND tier = 'media'"
_AT = 1_705_276_800


@R.add(f"SELECT event_id AS id, epoch_us(ts) AS us, event_type FROM events WHERE epoch_us(ts) < {_AT}000000 OR (epoch_us(ts) = {_AT}000000 AND event_id < 5000) ORDER BY us DESC, id DESC LIMIT 121")
def timeline_page(spark, d):
    e = B.events(spark, d).select(F.col("event_id").alias("id"), "us", "event_type")
    return C.keyset_page(e, "us", "id", 120, (_AT * 1_000_000, 5000))


@R.add("SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us FROM orders WHERE o_custkey = 7 ORDER BY us DESC, id DESC LIMIT 61")
def timeline_page_album(spark, d):
    o = table(spark, d, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return C.keyset_page(o, "us", "id", 60)


@R.add(with_views("files") + f"SELECT {_SUMMARY} FROM files WHERE {_LIVE} AND favorite ORDER BY capture_ts DESC, id DESC LIMIT 101")
def timeline_favorites(spark, d):
    return C.summary(C.keyset_page(B.live_media(B.files(spark, d)).where("favorite"), "capture_ts", "id", 100))


@R.add(with_views("files") + "SELECT id, filename, upload_ts FROM files WHERE trashed_at IS NULL AND tier = 'nonmedia' ORDER BY upload_ts DESC, id DESC LIMIT 101")
def files_page(spark, d):
    f = B.live(B.files(spark, d)).where("tier = 'nonmedia'").select("id", "filename", "upload_ts")
    return C.keyset_page(f, "upload_ts", "id", 100)


@R.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, max(epoch_us(o_orderdate) // 1000000) AS latest FROM orders GROUP BY 1")
def months_rollup(spark, d):
    return C.months(table(spark, d, "orders"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")))


@R.add(with_views("files") + "SELECT camera_make, camera_model, count(*) AS n FROM files WHERE trashed_at IS NULL AND camera_model IS NOT NULL GROUP BY ALL")
def camera_facets(spark, d):
    return C.camera_facets(B.files(spark, d))


@R.add(with_views("files") + f"SELECT min(capture_ts) AS first, max(capture_ts) AS last, count(*) AS n FROM files WHERE {_LIVE}")
def date_range_facet(spark, d):
    return B.live_media(B.files(spark, d)).agg(F.min("capture_ts").alias("first"), F.max("capture_ts").alias("last"), F.count("*").alias("n"))


@R.add(with_views("files") + "SELECT id, trashed_at FROM files WHERE trashed_at IS NOT NULL AND purged_at IS NULL")
def trash_list(spark, d):
    return B.files(spark, d).where("trashed_at IS NOT NULL AND purged_at IS NULL").select("id", "trashed_at").orderBy(F.desc("trashed_at"), F.desc("id"))


@R.add(
    with_views("files", "jobs")
    + """, asked AS (SELECT sha256 FROM files UNION SELECT sha256('item-' || (i * 7)) FROM range(400) t(i)),
  held AS (SELECT sha256, min(id) AS file_id FROM files GROUP BY 1),
  last AS (SELECT sha256, arg_max(state, id) AS state FROM jobs GROUP BY 1)
  SELECT a.sha256, CASE WHEN h.file_id IS NOT NULL THEN 'stored' ELSE coalesce(l.state, 'unknown') END AS status, h.file_id
  FROM asked a LEFT JOIN held h USING (sha256) LEFT JOIN last l USING (sha256)"""
)
def by_hash_status(spark, d):
    f = B.files(spark, d)
    items = spark.range(400).select(F.sha2(F.concat(F.lit("item-"), (F.col("id") * 7).cast("string")), 256).alias("sha256"))
    asked = f.select("sha256").union(items).distinct()
    held = f.groupBy("sha256").agg(F.min("id").alias("file_id"))
    last = B.jobs(spark, d).groupBy("sha256").agg(F.max_by("state", "id").alias("state"))
    j = asked.join(held, "sha256", "left").join(last, "sha256", "left")
    return j.select("sha256", F.when(F.col("file_id").isNotNull(), "stored").otherwise(F.coalesce("state", F.lit("unknown"))).alias("status"), "file_id")


@R.add(with_views("files") + f"SELECT {_SUMMARY} FROM files WHERE {_LIVE} AND capture_ts >= 1704240000 AND capture_ts < 1706832000 AND kind = 'image' AND filename ILIKE '%src_/%2%.jpg%' ORDER BY capture_ts DESC, id DESC LIMIT 200")
def search_filtered(spark, d):
    found = C.search(B.live_media(B.files(spark, d)), 200, date_from=1_704_240_000.0, date_to=1_706_832_000.0, kind="image", query="src_/%2%.jpg")
    return C.summary(found)


@R.add(with_views("files") + f"SELECT {_SUMMARY} FROM files WHERE {_LIVE} AND (camera_model = 'fr' OR camera_make = 'fr') ORDER BY capture_ts DESC, id DESC LIMIT 200")
def search_camera(spark, d):
    return C.summary(C.search(B.live_media(B.files(spark, d)), 200, camera="fr"))


@R.add("SELECT c_custkey AS album_id, count(o_orderkey) AS n, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 4 END, arg_max(o_orderkey, (epoch_us(o_orderdate), o_orderkey))) AS cover FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def albums_with_cover(spark, d):
    albums = table(spark, d, "customer").select(F.col("c_custkey").alias("album_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") * 4).alias("cover_file_id"))
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").alias("file_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return C.albums_with_cover(albums, items)


@R.add("SELECT o_orderkey AS file_id, c_custkey AS album_id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def file_albums(spark, d):
    o = table(spark, d, "orders")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("file_id"), F.col("c_custkey").alias("album_id"), F.col("c_name").alias("name"))


@R.add(with_views("device_items") + "SELECT i AS device_id, count(sha256) AS n FROM range(400) t(i) LEFT JOIN device_items ON device_id = i GROUP BY i")
def devices_with_counts(spark, d):
    return C.count_with_zeros(spark.range(400).select(F.col("id").alias("device_id")), B.device_items(spark, d), "device_id")


@R.add(with_views("jobs") + "SELECT state, count(*) AS n FROM jobs GROUP BY 1")
def ingest_histogram(spark, d):
    return C.histogram(B.jobs(spark, d), "state")


@R.add(with_views("files") + "SELECT tier, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM files WHERE purged_at IS NULL GROUP BY 1")
def tier_totals(spark, d):
    return B.files(spark, d).where("purged_at IS NULL").groupBy("tier").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@R.add(
    with_views("stripes", "shards", "disks")
    + """SELECT (SELECT coalesce(sum(capacity_bytes), 0)::BIGINT FROM disks WHERE status <> 'retired') AS raw_bytes,
  (SELECT coalesce(sum(free_bytes), 0)::BIGINT FROM disks WHERE status IN ('online', 'degraded', 'rebuilding')) AS free_bytes,
  (SELECT floor(sum(capacity_bytes) * 4 / 6)::BIGINT FROM disks WHERE status <> 'retired') AS usable_bytes,
  (SELECT coalesce(sum(shard_size + 256), 0)::BIGINT FROM shards WHERE state = 'ok') AS physical_bytes, 'erasure' AS mode"""
)
def capacity_report(spark, d):
    return C.capacity(B.disks(spark), B.shards(spark, d), B.K, B.M)


@R.add(with_views("stripes", "shards") + "SELECT health, count(*) AS n FROM (SELECT CASE WHEN count(*) FILTER (WHERE state = 'ok') = 6 THEN 'healthy' WHEN count(*) FILTER (WHERE state = 'ok') >= 4 THEN 'degraded' ELSE 'unrecoverable' END AS health FROM shards GROUP BY object_id, seq) GROUP BY 1")
def stripe_health(spark, d):
    good = F.count_if(F.col("state") == "ok")
    s = B.shards(spark, d).groupBy("object_id", "seq").agg(F.when(good == B.K + B.M, "healthy").when(good >= B.K, "degraded").otherwise("unrecoverable").alias("health"))
    return C.histogram(s, "health")


@R.add(with_views("stripes", "shards", "disks") + "SELECT d.id AS disk_id, d.status, count(s.idx) AS n FROM disks d LEFT JOIN shards s ON s.disk_id = d.id AND s.state = 'ok' GROUP BY ALL")
def disk_shard_counts(spark, d):
    return C.count_with_zeros(B.disks(spark).select(F.col("id").alias("disk_id"), "status"), B.shards(spark, d).where("state = 'ok'"), "disk_id")


@R.add(with_views("stripes", "shards", "disks") + "SELECT object_id, seq, count(*) AS bad FROM shards s LEFT JOIN disks d ON d.id = s.disk_id WHERE s.state <> 'ok' OR d.id IS NULL OR d.status NOT IN ('online', 'degraded', 'rebuilding') GROUP BY ALL")
def stripes_needing_repair(spark, d):
    return C.needing_repair(B.shards(spark, d), B.disks(spark))


@R.add(with_views("stripes") + "SELECT object_id, seq FROM stripes WHERE coalesce(last_scrubbed_at, 0) < 1706832000 ORDER BY coalesce(last_scrubbed_at, 0), object_id, seq LIMIT 200")
def scrub_candidates(spark, d):
    at = F.coalesce("last_scrubbed_at", F.lit(0.0))
    return B.stripes(spark, d).where(at < 1_706_832_000).orderBy(at, "object_id", "seq").limit(200).select("object_id", "seq")


@R.add("SELECT min(coalesce(last_scrubbed_at, 0)) AS oldest FROM (" + with_views("stripes") + "SELECT * FROM stripes)")
def oldest_verified(spark, d):
    return B.stripes(spark, d).agg(F.min(F.coalesce("last_scrubbed_at", F.lit(0.0))).alias("oldest"))


@R.add(
    """SELECT o_orderkey AS id, state, CASE WHEN 2000 - started > 0 THEN round(written / (2000 - started)::DOUBLE, 4) ELSE 0.0 END AS rate,
  CASE WHEN state = 'running' AND done > 0 THEN round((total - done) * (2000 - started)::DOUBLE / done, 4) END AS eta
  FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS state, o_orderkey % 500 + 1 AS total, o_orderkey % 7 * (o_orderkey % 500) // 7 AS done, o_orderkey * 1000 AS written, o_orderkey % 2001 AS started FROM orders)"""
)
def rebuild_progress(spark, d):
    k = F.col("o_orderkey")
    tasks = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "done").otherwise("failed").alias("state"), (k % 500 + 1).alias("total_stripes"),
        F.floor(k % 7 * (k % 500) / 7).alias("done_stripes"), (k * 1000).alias("bytes_written"), (k % 2001).alias("started_at"),
    )
    p = C.rebuild_progress(tasks, F.lit(2000))
    return p.select("id", "state", F.round("rate", 4).alias("rate"), F.round("eta", 4).alias("eta"))


@R.add("SELECT o_custkey AS store, 'snapshots/' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY 'snapshots/' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey DESC) <= 7 AS kept FROM orders")
def snapshot_retention(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("store"), F.concat(F.lit("snapshots/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("key"))
    return C.keep_newest(o, [F.col("store")], F.desc("key"), 7)


@R.add("SELECT store, max(key) AS latest FROM (SELECT o_custkey AS store, 'snapshots/' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey AS key FROM orders) GROUP BY 1")
def snapshot_latest(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("store")).agg(F.max(F.concat(F.lit("snapshots/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("o_orderkey").cast("string"))).alias("latest"))


@R.add(with_views("files") + "SELECT 'trash' AS what, id FROM files WHERE purged_at IS NULL AND trashed_at < 1707000000 - 30 * 86400 + 2592000 UNION ALL SELECT 'upload', event_id FROM events WHERE epoch_us(ts) < 1705276800000000 AND event_type = 'view'")
def expiry_sets(spark, d):
    trash = B.files(spark, d).where(F.col("purged_at").isNull() & (F.col("trashed_at") < 1_707_000_000 - 30 * 86400 + 2_592_000)).select(F.lit("trash").alias("what"), "id")
    uploads = B.events(spark, d).where((F.col("us") < 1_705_276_800_000_000) & (F.col("event_type") == "view")).select(F.lit("upload").alias("what"), F.col("event_id").alias("id"))
    return trash.union(uploads)


@R.add("SELECT user_id, day, run, count(*) AS n FROM (SELECT user_id, day, sum(new) OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN day IS DISTINCT FROM lag(day) OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) THEN 1 ELSE 0 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, (to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC')::DATE AS day FROM events))) GROUP BY ALL")
def day_groups(spark, d):
    e = B.events(spark, d).select("user_id", "event_id", F.floor(F.col("us") / 1_000_000).cast("long").alias("s"))
    return C.day_runs(e, "s", "event_id", "user_id")


@R.add(
    """, s AS (SELECT o_custkey AS store, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1)
  SELECT store, v[n // 2 + 1] AS p50, (v[j95] * (100 - d95) + v[j95 + 1] * d95) / 100 AS p95, (v[j99] * (100 - d99) + v[j99 + 1] * d99) / 100 AS p99
  FROM (SELECT *, 95 * (n + 1) - j95 * 100 AS d95, 99 * (n + 1) - j99 * 100 AS d99 FROM (SELECT *, least(n - 1, greatest(1, 95 * (n + 1) // 100)) AS j95, least(n - 1, greatest(1, 99 * (n + 1) // 100)) AS j99 FROM s WHERE n > 1))""".replace(", s AS", "WITH s AS", 1)
)
def latency_percentiles(spark, d):
    return C.exclusive_quantile(table(spark, d, "orders").withColumnRenamed("o_custkey", "store"), ["store"], "o_totalprice", [50, 95, 99])


@R.add("SELECT i AS disks, CASE WHEN i >= 6 THEN 4 WHEN i >= 1 THEN 1 END AS k, (CASE WHEN i >= 6 THEN 2 WHEN i >= 2 THEN least(i - 1, 2) WHEN i = 1 THEN 0 END)::INT AS m FROM range(12) t(i)")
def write_profile(spark, d):
    return spark.range(12).select(F.col("id").alias("disks"), C.profile(F.col("id"), 4, 2).alias("p")).select("disks", "p.k", "p.m")


@R.add(with_views("stripes", "shards") + "SELECT object_id, seq, count(*) FILTER (WHERE state = 'ok') AS landed, count(*) FILTER (WHERE state = 'ok') >= 5 AS committed FROM shards GROUP BY ALL")
def write_quorum(spark, d):
    s = B.shards(spark, d).groupBy("object_id", "seq").agg(F.count_if(F.col("state") == "ok").alias("landed"))
    return s.withColumn("committed", C.quorum(4, 2, 1, F.col("landed")))


@R.add(with_views("files") + "SELECT count(*) FILTER (WHERE trashed_at IS NULL AND purged_at IS NULL) AS live, count(*) FILTER (WHERE trashed_at IS NOT NULL AND purged_at IS NULL) AS trashed, count(*) FILTER (WHERE purged_at IS NOT NULL) AS purged FROM (SELECT id, CASE WHEN id % 5 = 0 AND trashed_at IS NULL THEN 9.0 ELSE trashed_at END AS trashed_at, CASE WHEN id % 2 = 0 AND purged_at IS NULL AND (trashed_at IS NOT NULL OR id % 5 = 0) THEN 10.0 ELSE purged_at END AS purged_at FROM files)")
def trash_purge_lifecycle(spark, d):
    f = B.files(spark, d).select("id", "trashed_at", "purged_at")
    after = C.purge(C.trash(f, f.where("id % 5 = 0").select("id"), 9.0), 10.0, f.where("id % 2 = 0").select("id"))
    t, p = F.col("trashed_at"), F.col("purged_at")
    return after.agg(F.count_if(t.isNull() & p.isNull()).alias("live"), F.count_if(t.isNotNull() & p.isNull()).alias("trashed"), F.count_if(p.isNotNull()).alias("purged"))


@R.add(with_views("files") + r"SELECT id, lower(regexp_extract(regexp_extract(filename, '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)) AS suffix, size FROM files WHERE tier = 'nonmedia' ORDER BY ALL")
def suffix_order(spark, d):
    f = B.files(spark, d).where("tier = 'nonmedia'").select("id", S.suffix(F.col("filename")).alias("suffix"), "size")
    return f.orderBy("suffix", "id")


@R.add("SELECT event_id AS id, CASE WHEN ok AND s < size AND s < e THEN s END AS start, CASE WHEN ok AND s < size AND s < e THEN e END AS stop, CASE WHEN ok AND s < size AND s < e THEN 206 ELSE 416 END AS status FROM (SELECT event_id, true AS ok, user_id * 10 AS size, CASE event_id % 3 WHEN 2 THEN greatest(0, user_id * 10 - event_id % 400) ELSE event_id % 700 END AS s, CASE event_id % 3 WHEN 0 THEN least(event_id % 700 + user_id + 1, user_id * 10) ELSE user_id * 10 END AS e FROM events)")
def http_ranges(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    header = F.when(i % 3 == 0, F.concat(F.lit("bytes="), text(i % 700), F.lit("-"), text(i % 700 + u))).when(i % 3 == 1, F.concat(F.lit("bytes="), text(i % 700), F.lit("-"))).otherwise(F.concat(F.lit("bytes=-"), text(i % 400)))
    r = table(spark, d, "events").select(i.alias("id"), S.byte_range(header, u * 10).alias("r"))
    return r.select("id", "r.start", F.col("r.end").alias("stop"), "r.status")
