"""Queries of upkeep: scrub, evacuation, compaction, dashboards, client states."""

from __future__ import annotations

from pyspark.sql import functions as F

from galena.operators import catalog as C
from galena.operators import dedup as D
from galena.operators import maintenance as M
from galena.operators import sync as Y
from galena.plans.content_queries import _BATCHES, _batches, _placed
from galena.plans.registry import Registry
from galena.sources import bindings as B
from galena.sources.bindings import table, with_views

R = Registry()


@R.add(with_views("stripes", "shards") + "SELECT count(*) AS stripes, coalesce(sum(bad), 0)::BIGINT AS bad_shards, count(*) FILTER (WHERE bad > 0 AND n - bad >= 4) AS repaired, count(*) FILTER (WHERE n - bad < 4) AS unrecoverable FROM (SELECT count(*) AS n, count(*) FILTER (WHERE state <> 'ok') AS bad FROM shards GROUP BY object_id, seq)")
def scrub_summary(spark, d):
    return M.scrub_summary(B.shards(spark, d), B.K)


@R.add(
    with_views("stripes", "shards", "disks")
    + """, able AS (SELECT list(id ORDER BY free_bytes DESC, id) AS able FROM disks WHERE status IN ('online', 'rebuilding') AND id <> 5),
  held AS (SELECT object_id, seq, list(DISTINCT disk_id) FILTER (WHERE disk_id <> 5) AS held, list(idx ORDER BY idx) FILTER (WHERE disk_id = 5) AS moved FROM shards GROUP BY ALL),
  free AS (SELECT object_id, seq, moved, list_filter(able, lambda x: NOT list_contains(coalesce(held, []), x)) AS free FROM held, able WHERE len(moved) > 0)
  SELECT object_id, seq, moved[n] AS idx, free[n] AS disk_id, CASE WHEN free[n] IS NULL THEN 'missing' ELSE 'ok' END AS state FROM (SELECT *, unnest(range(1, len(moved) + 1)) AS n FROM free)"""
)
def evacuate_disk(spark, d):
    return M.evacuate(B.shards(spark, d), B.disks(spark), 5)


@R.add(with_views("stripes") + "SELECT DISTINCT object_id FROM stripes WHERE (CASE WHEN object_id % 7 = 0 THEN 1 ELSE k END) <> 4 OR m <> 2")
def restripe_candidates(spark, d):
    s = B.stripes(spark, d).withColumn("k", F.when(F.col("object_id") % 7 == 0, 1).otherwise(F.col("k")))
    return M.needing_restripe(s, F.lit(4), F.lit(2))


@R.add(with_views("stripes", "shards") + "SELECT (SELECT count(*) FROM documents WHERE source <> 'src0') AS objects, (SELECT count(*) FROM stripes JOIN documents ON doc_id = object_id WHERE source <> 'src0') AS stripes, (SELECT count(*) FROM shards JOIN documents ON doc_id = object_id WHERE source <> 'src0') AS shards")
def delete_cascade(spark, d):
    o = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), "source")
    left = M.delete_objects(o.drop("source"), B.stripes(spark, d), B.shards(spark, d), o.where("source = 'src0'").select("key"))
    counts = [x.agg(F.count("*").alias(n)) for x, n in zip(left, ("objects", "stripes", "shards"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@R.add(with_views("stripes") + "SELECT object_id, count(*) AS stripes FROM stripes WHERE object_id % 11 <> 0 AND (object_id + seq) % 13 <> 0 GROUP BY 1")
def crash_recovery(spark, d):
    o = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 0, "pending").otherwise("committed").alias("state"))
    s = B.stripes(spark, d).withColumn("state", F.when((F.col("object_id") + F.col("seq")) % 13 == 0, "pending").otherwise("committed"))
    return M.committed_only(o, s)[1].groupBy("object_id").agg(F.count("*").alias("stripes"))


@R.add("SELECT id FROM (" + B.SQL["disks"] + ") WHERE status = 'failed' AND id NOT IN (1, 2)")
def auto_evacuate(spark, d):
    return M.to_evacuate(B.disks(spark), spark.createDataFrame([(5, "done"), (1, "running"), (2, "queued")], "disk_id long, state string"))


@R.add("SELECT count(*) FILTER (WHERE status = 'failed') AS failed, 2 - count(*) FILTER (WHERE status = 'failed') AS margin FROM (" + B.SQL["disks"] + ")")
def health_margin(spark, d):
    return M.health_margin(B.disks(spark), B.M)


@R.add("SELECT status, count(*) AS n FROM (" + B.SQL["disks"] + ") GROUP BY 1")
def disk_histogram(spark, d):
    return C.histogram(B.disks(spark), "status")


@R.add(
    f"""{_BATCHES}, victims AS (SELECT batch_id FROM batches WHERE raw_bytes > 0 AND live_bytes::DOUBLE / raw_bytes < 0.5),
  moved AS (SELECT p.*, coalesce(sum(size) OVER (ORDER BY batch_id, raw_offset, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM placed p WHERE batch_id IN (SELECT batch_id FROM victims) AND hash IN (SELECT hash FROM live))
  SELECT hash, batch_id, raw_offset, size FROM placed WHERE batch_id NOT IN (SELECT batch_id FROM victims) UNION ALL SELECT hash, 1000000, spot, size FROM moved"""
)
def compaction(spark, d):
    live = B.line_chunks(spark, d).where("file_id % 3 = 0")
    return M.compact(_placed(spark, d), D.compaction_victims(_batches(spark, d)), live, 1_000_000)


@R.add(f"{_BATCHES} SELECT min(batch_id) AS id FROM batches WHERE batch_id % 3 <> 0")
def open_batch(spark, d):
    return M.open_batch(_batches(spark, d).select(F.col("batch_id").alias("id"), F.when(F.col("batch_id") % 3 != 0, "open").otherwise("sealed").alias("state")))


@R.add(with_views("line_chunks") + "SELECT hash, min(source || '/' || file_id) AS filename FROM line_chunks JOIN documents ON doc_id = file_id GROUP BY 1")
def chunk_filename(spark, d):
    names = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filename"))
    return B.line_chunks(spark, d).select("hash", "file_id").join(names, "file_id").groupBy("hash").agg(F.min("filename").alias("filename"))


@R.add(
    with_views("files", "stripes", "shards", "disks", "jobs")
    + """SELECT 'files' AS metric, tier AS name, count(*) AS n FROM files WHERE purged_at IS NULL GROUP BY 2
  UNION ALL SELECT 'jobs', state, count(*) FROM jobs GROUP BY 2 UNION ALL SELECT 'disks', status, count(*) FROM disks GROUP BY 2 UNION ALL SELECT 'shards', state, count(*) FROM shards GROUP BY 2"""
)
def dashboard(spark, d):
    part = lambda df, metric, column: C.histogram(df, column).select(F.lit(metric).alias("metric"), F.col(column).alias("name"), "n")
    return part(B.files(spark, d).where("purged_at IS NULL"), "files", "tier").union(part(B.jobs(spark, d), "jobs", "state")).union(part(B.disks(spark), "disks", "status")).union(part(B.shards(spark, d), "shards", "state"))


@R.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 3000 ELSE 4000 END AS width, CASE WHEN o_orderkey % 2 = 0 THEN 4000 ELSE 3000 END AS height, (CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN -10.5 ELSE 10.5 END)::DOUBLE AS lat, (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 20.25 END)::DOUBLE AS lon, o_orderpriority AS make FROM orders")
def exif_fields(spark, d):
    k = F.col("o_orderkey")
    zero = k % 5 == 0
    tags = F.create_map(
        F.lit("Orientation"), F.when(k % 2 == 0, "6").otherwise("1"), F.lit("Width"), F.lit("4000"), F.lit("Height"), F.lit("3000"),
        F.lit("GPSLatitude"), F.when(zero, "0 0 0").otherwise("10 30 0"), F.lit("GPSLatitudeRef"), F.when(k % 3 == 0, "S").otherwise("N"),
        F.lit("GPSLongitude"), F.when(zero, "0").otherwise("20 15"), F.lit("GPSLongitudeRef"), F.lit("E"), F.lit("Make"), F.concat(F.lit(" "), "o_orderpriority"),
    )
    e = table(spark, d, "orders").select(k.alias("id"), M.exif_fields(tags).alias("e"))
    return e.select("id", "e.width", "e.height", "e.lat", "e.lon", "e.make")


@R.add(with_views("files") + ", have AS (SELECT o_custkey AS album_id, o_orderkey % 500 AS file_id FROM orders WHERE o_orderkey % 2 = 0), want AS (SELECT o_custkey AS album_id, o_orderkey % 500 AS file_id FROM orders) SELECT * FROM have UNION ALL SELECT * FROM (SELECT * FROM want WHERE file_id IN (SELECT id FROM files WHERE purged_at IS NULL) EXCEPT SELECT * FROM have)")
def album_additions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), (F.col("o_orderkey") % 500).alias("file_id"), "o_orderkey")
    return M.add_to_album(o.where("o_orderkey % 2 = 0"), B.files(spark, d), o.drop("o_orderkey"))


_STATUS = "CASE WHEN event_id % 29 = 0 THEN 'rehash' WHEN event_id % 7 >= 5 THEN 'failed' WHEN event_id % 3 = 0 THEN 'needsUpload' WHEN event_id % 4 = 0 THEN 'processing' WHEN event_id % 2 = 0 THEN 'synced' ELSE 'pending' END"


def _statuses(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), M.upload_status(i % 3 == 0, i % 2 == 0, i % 4 == 0, i % 7, i % 29 == 0).alias("status"))


@R.add(f"SELECT event_id AS id, {_STATUS} AS status FROM events")
def client_status(spark, d):
    return _statuses(spark, d)


@R.add(f"SELECT count(*) FILTER (WHERE s = 'synced') AS synced, count(*) FILTER (WHERE s IN ('pending', 'needsUpload', 'processing', 'rehash')) AS pending, count(*) FILTER (WHERE s = 'failed') AS failed FROM (SELECT {_STATUS} AS s FROM events)")
def client_buckets(spark, d):
    return M.status_buckets(_statuses(spark, d), {"synced": ["synced"], "pending": ["pending", "needsUpload", "processing", "rehash"], "failed": ["failed"]})


@R.add("SELECT event_id AS id, regexp_full_match(p, '[0-9a-f]{0,3}') AS path_ok, regexp_full_match(h, '[0-9a-f]{64}') AS sha_ok FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a0f' WHEN 2 THEN 'A0' ELSE '0123' END AS p, CASE WHEN event_id % 3 = 0 THEN upper(sha256(event_id::VARCHAR)) ELSE sha256(event_id::VARCHAR) END AS h FROM events)")
def hash_validation(spark, d):
    i = F.col("event_id")
    sha = F.sha2(i.cast("string"), 256)
    p = F.when(i % 4 == 0, "").when(i % 4 == 1, "a0f").when(i % 4 == 2, "A0").otherwise("0123")
    return table(spark, d, "events").select(i.alias("id"), M.valid_path(p).alias("path_ok"), M.valid_sha(F.when(i % 3 == 0, F.upper(sha)).otherwise(sha)).alias("sha_ok"))


_AFTER = with_views("device_items", "stored_items") + ", s AS (SELECT sha256 FROM device_items UNION SELECT sha256 FROM stored_items WHERE purged)"
_LEAF = "SELECT path, sha256(unhex(string_agg(sha256, '' ORDER BY sha256))) AS hash FROM (SELECT sha256, substr(sha256, 1, 3) AS path FROM s) GROUP BY 1"


def _up(name: str) -> str:
    return f"SELECT up AS path, sha256(unhex(string_agg(coalesce(n.hash, repeat('0', 64)), '' ORDER BY i))) AS hash FROM (SELECT DISTINCT substr(path, 1, length(path) - 1) AS up FROM {name}) u CROSS JOIN range(16) t(i) LEFT JOIN {name} n ON n.path = up || lower(hex(i)[-1:]) GROUP BY 1"


@R.add(f"{_AFTER}, l3 AS ({_LEAF}), l2 AS ({_up('l3')}), l1 AS ({_up('l2')}), l0 AS ({_up('l1')}) SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0")
def merkle_refresh(spark, d):
    """The trie after adding the purged items of the store: touched nodes only are computed again."""
    before = B.device_items(spark, d).select("sha256").distinct()
    new = B.stored_items(spark, d).where("purged").select("sha256")
    return M.refreshed(Y.tree(before), before.union(new).distinct(), new)
