"""Catalogue views over the generic test tables. All arithmetic is on integers, so that any SQL engine gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import scalars as S

EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    lat = F.pmod(i * 7919, F.lit(17001)) / 100.0 - 85
    lon = F.pmod(i * 104729, F.lit(36000)) / 100.0 - 180
    ts = (EPOCH + i * 3600).cast("double")
    return d.select(
        i.alias("id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"),
        F.concat("source", F.lit("/"), i.cast("string"), F.when(i % 6 == 0, ".JPG").when(i % 6 == 1, ".mov").when(i % 6 == 2, "").otherwise(".txt")).alias("filename"),
        F.when(i % 5 == 0, "other").when(i % 3 == 0, "image").otherwise("video").alias("kind"),
        F.when(i % 5 == 0, "nonmedia").otherwise("media").alias("tier"),
        ts.alias("capture_ts"), (ts + 86400 * (i % 11)).alias("upload_ts"),
        F.col("source").alias("camera_make"), F.when(i % 7 != 0, F.col("lang")).alias("camera_model"),
        F.when(i % 4 != 0, lat).alias("lat"), F.when(i % 4 != 0, lon).alias("lon"),
        (640 + i % 5 * 160).cast("int").alias("width"), (480 + i % 3 * 120).cast("int").alias("height"),
        ((i * 37 % 1000) / 10.0).alias("sharpness"), (i % 9 == 0).alias("favorite"),
        F.when(i % 17 == 0, ts + 1e6).alias("trashed_at"), F.when(i % 51 == 0, ts + 2e6).alias("purged_at"),
        (i % 13 == 0).alias("dup_reviewed"), F.col("text").alias("content"),
    )


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("trashed_at").isNull())


def live_media(df: DataFrame) -> DataFrame:
    return df.where(F.col("trashed_at").isNull() & (F.col("tier") == "media"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed", "done"))), (i % 5 + 1).cast("int"))
    return events(spark, sf_dir).select(i.alias("id"), F.sha2(F.concat(F.lit("item-"), (i % 2000).cast("string")), 256).alias("sha256"), state.alias("state"), (i % 7).cast("int").alias("attempts"), F.col("us"))


def device_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("device_id"), F.sha2(F.concat(F.lit("item-"), (F.col("event_id") % 2000).cast("string")), 256).alias("sha256")).distinct()


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that the store holds: items with an even number, some of them tombstones."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 2000).alias("n")).distinct().where("n % 2 = 0")
    return e.select(F.sha2(F.concat(F.lit("item-"), F.col("n").cast("string")), 256).alias("sha256"), (F.col("n") % 10 == 0).alias("purged"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, seq, data, size, hash): the lines of each text as its chunks."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("seq", "data"))
    return lines.select("file_id", "seq", "data", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("hash"))


K, M, MAX_SHARD = 4, 2, 256


def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, seq, k, m, shard_size, data_offset, data_len, last_scrubbed_at): an empty object has one stripe."""
    cap = K * MAX_SHARD
    o = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.octet_length("text").cast("long").alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / cap)).cast("int")
    s = o.select("object_id", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    offset = (F.col("seq").cast("long") * cap).alias("data_offset")
    length = F.least(F.lit(cap), F.col("size") - F.col("seq") * cap)
    scrubbed = F.when(F.col("object_id") % 3 != 0, (EPOCH + (F.col("object_id") * 7 + F.col("seq")) % 5000 * 1000).cast("double"))
    return s.select("object_id", "seq", F.lit(K).alias("k"), F.lit(M).alias("m"), S.shard_size(length, K, MAX_SHARD).alias("shard_size"), offset, length.cast("long").alias("data_len"), scrubbed.alias("last_scrubbed_at"))


#: (id, uuid, status, capacity, free, error_count): six disks, one failed, one degraded.
DISKS = [(i, "%08x" % (i * 0x1234567), ("online", "online", "degraded", "online", "failed", "rebuilding")[i - 1], 4_000_000 * i, 1_000_000 * ((i * 5) % 7), i * 3) for i in range(1, 7)]


def disks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISKS, "id long, uuid string, status string, capacity_bytes long, free_bytes long, error_count int")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, seq, idx, disk_id, state, shard_size)"""
    s = stripes(spark, sf_dir).select("object_id", "seq", "shard_size", F.explode(F.sequence(F.lit(0), F.lit(K + M - 1))).alias("idx"))
    mark = F.col("object_id") * 31 + F.col("seq") * 7 + F.col("idx")
    disk = F.when(mark % 89 != 0, (F.col("object_id") + F.col("idx")) % 6 + 1)
    state = F.when(mark % 97 == 0, "missing").when(mark % 101 == 0, "corrupt").otherwise("ok")
    return s.select("object_id", "seq", "idx", disk.alias("disk_id"), state.alias("state"), "shard_size")


# -- the same views as SQL, for the checks -----------------------------------
SQL = {
    "files": f"""SELECT doc_id AS id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size,
  concat(source, '/', doc_id, CASE doc_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mov' WHEN 2 THEN '' ELSE '.txt' END) AS filename,
  CASE WHEN doc_id % 5 = 0 THEN 'other' WHEN doc_id % 3 = 0 THEN 'image' ELSE 'video' END AS kind,
  CASE WHEN doc_id % 5 = 0 THEN 'nonmedia' ELSE 'media' END AS tier,
  ({EPOCH} + doc_id * 3600)::DOUBLE AS capture_ts, ({EPOCH} + doc_id * 3600 + 86400 * (doc_id % 11))::DOUBLE AS upload_ts,
  source AS camera_make, CASE WHEN doc_id % 7 <> 0 THEN lang END AS camera_model,
  CASE WHEN doc_id % 4 <> 0 THEN (doc_id * 7919 % 17001)::DOUBLE / 100 - 85 END AS lat,
  CASE WHEN doc_id % 4 <> 0 THEN (doc_id * 104729 % 36000)::DOUBLE / 100 - 180 END AS lon,
  (640 + doc_id % 5 * 160)::INT AS width, (480 + doc_id % 3 * 120)::INT AS height, (doc_id * 37 % 1000)::DOUBLE / 10 AS sharpness,
  doc_id % 9 = 0 AS favorite, CASE WHEN doc_id % 17 = 0 THEN ({EPOCH} + doc_id * 3600)::DOUBLE + 1e6 END AS trashed_at,
  CASE WHEN doc_id % 51 = 0 THEN ({EPOCH} + doc_id * 3600)::DOUBLE + 2e6 END AS purged_at, doc_id % 13 = 0 AS dup_reviewed, text AS content FROM documents""",
    "jobs": "SELECT event_id AS id, sha256('item-' || (event_id % 2000)) AS sha256, ['queued', 'running', 'done', 'failed', 'done'][event_id % 5 + 1] AS state, (event_id % 7)::INT AS attempts, epoch_us(ts) AS us FROM events",
    "device_items": "SELECT DISTINCT user_id AS device_id, sha256('item-' || (event_id % 2000)) AS sha256 FROM events",
    "stored_items": "SELECT sha256('item-' || n) AS sha256, n % 10 = 0 AS purged FROM (SELECT DISTINCT event_id % 2000 AS n FROM events) WHERE n % 2 = 0",
    "line_chunks": "SELECT doc_id AS file_id, (i - 1)::INT AS seq, l[i] AS data, octet_length(encode(l[i]))::BIGINT AS size, sha256(l[i]) AS hash FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "stripes": f"""SELECT object_id, seq, {K} AS k, {M} AS m, CASE WHEN data_len > 0 THEN least({MAX_SHARD}, ceil(ceil(data_len / {K}) / 64) * 64)::BIGINT ELSE 64 END AS shard_size, data_offset, data_len,
  CASE WHEN object_id % 3 <> 0 THEN ({EPOCH} + (object_id * 7 + seq) % 5000 * 1000)::DOUBLE END AS last_scrubbed_at
  FROM (SELECT object_id, seq, (seq * {K * MAX_SHARD})::BIGINT AS data_offset, least({K * MAX_SHARD}, size - seq * {K * MAX_SHARD})::BIGINT AS data_len FROM
  (SELECT doc_id AS object_id, octet_length(encode(text)) AS size, unnest(range(0, greatest(1, ceil(octet_length(encode(text)) / {K * MAX_SHARD})::INT)))::INT AS seq FROM documents))""",
    "disks": "SELECT id::BIGINT AS id, uuid, status, capacity_bytes::BIGINT AS capacity_bytes, free_bytes::BIGINT AS free_bytes, error_count FROM (VALUES " + ", ".join(map(str, DISKS)) + ") AS t(id, uuid, status, capacity_bytes, free_bytes, error_count)",
    "shards": f"""SELECT object_id, seq, idx, CASE WHEN mark % 89 <> 0 THEN (object_id + idx) % 6 + 1 END AS disk_id, CASE WHEN mark % 97 = 0 THEN 'missing' WHEN mark % 101 = 0 THEN 'corrupt' ELSE 'ok' END AS state, shard_size
  FROM (SELECT object_id, seq, shard_size, i::INT AS idx, object_id * 31 + seq * 7 + i AS mark FROM stripes, range({K + M}) AS r(i))""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"
