"""Queries of the chunk, stripe, ingest and stateful families."""

from __future__ import annotations

from pyspark.sql import functions as F

from galena.functions import kernels as K
from galena.functions import scalars as S
from galena.operators import catalog as C
from galena.operators import dedup as D
from galena.operators import erasure as E
from galena.operators import ingest as I
from galena.operators import stateful as T
from galena.plans.registry import Registry
from galena.session import cut
from galena.sources import bindings as B
from galena.sources.bindings import table, with_views

R = Registry()

# -- chunks ------------------------------------------------------------------
_PER = "per AS (SELECT hash, any_value(size) AS size, count(*) AS n, min(file_id * 100000 + seq) AS spot FROM line_chunks GROUP BY 1)"
_PLACED = f"{with_views('line_chunks')}, {_PER}, placed AS (SELECT spot // 100000 // 50 AS batch_id, hash, size, n AS refcount, coalesce(sum(size) OVER (PARTITION BY spot // 100000 // 50 ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_offset FROM per)"
_BATCHES = f"{_PLACED}, live AS (SELECT DISTINCT hash FROM line_chunks WHERE file_id % 3 = 0), batches AS (SELECT batch_id, sum(size)::BIGINT AS raw_bytes, coalesce(sum(CASE WHEN l.hash IS NOT NULL THEN size END), 0)::BIGINT AS live_bytes FROM placed p LEFT JOIN live l USING (hash) GROUP BY 1)"


def _placed(spark, d):
    return D.layout(D.first_occurrences(B.line_chunks(spark, d)), 50)


def _batches(spark, d):
    return D.batches(_placed(spark, d), B.line_chunks(spark, d).where("file_id % 3 = 0"))


@R.add(f"{with_views('line_chunks')}, {_PER} SELECT sum(size * n)::BIGINT AS logical_bytes, sum(size)::BIGINT AS unique_bytes, sum(size * n)::DOUBLE / sum(size)::DOUBLE AS ratio, sum(n)::BIGINT AS chunks, count(*) AS distinct_chunks, sum(size)::DOUBLE / count(*) AS avg_size FROM per")
def dedup_stats(spark, d):
    return D.stats(B.line_chunks(spark, d))


@R.add(f"{with_views('line_chunks')}, {_PER} SELECT hash, size, spot // 100000 AS file_id, (spot % 100000)::INT AS seq, n AS refcount FROM per")
def chunk_dedup(spark, d):
    return D.first_occurrences(B.line_chunks(spark, d))


@R.add(f"{with_views('line_chunks')} SELECT hash, count(*) AS refcount FROM line_chunks GROUP BY 1")
def refcounts(spark, d):
    return B.line_chunks(spark, d).groupBy("hash").agg(F.count("*").alias("refcount"))


@R.add(f"{_PLACED} SELECT batch_id, hash, size, raw_offset, refcount FROM placed")
def batch_layout(spark, d):
    return _placed(spark, d)


@R.add(f"{_BATCHES} SELECT * FROM batches")
def live_bytes(spark, d):
    return _batches(spark, d)


@R.add(f"{_BATCHES} SELECT batch_id FROM batches WHERE raw_bytes > 0 AND live_bytes::DOUBLE / raw_bytes < 0.5")
def compaction_victims(spark, d):
    return D.compaction_victims(_batches(spark, d)).select("batch_id")


@R.add(f"{_BATCHES} SELECT batch_id, (raw_bytes >= 60000 OR (batch_id % 4 <> 0 AND 100000 - batch_id * 5000 >= 21600)) AND batch_id % 3 <> 0 AS due FROM batches")
def seal_due(spark, d):
    b = _batches(spark, d).withColumn("state", F.when(F.col("batch_id") % 3 != 0, "open").otherwise("sealed")).withColumn("first_data_at", F.when(F.col("batch_id") % 4 != 0, F.col("batch_id") * 5000 + 1).otherwise(0))
    return b.select("batch_id", D.seal_due(F.lit(100_001), 60_000).alias("due"))


@R.add(f"""{_PLACED}, lined AS (SELECT batch_id, size, row_number() OVER (PARTITION BY batch_id ORDER BY raw_offset, size) AS rn FROM placed),
  fold AS (SELECT batch_id, rn, 0 AS idx, size AS held, size >= 16384 AS full FROM lined WHERE rn = 1
    UNION ALL SELECT l.batch_id, l.rn, f.idx + f.full::INT, CASE WHEN f.full THEN l.size ELSE f.held + l.size END, CASE WHEN f.full THEN l.size ELSE f.held + l.size END >= 16384 FROM fold f JOIN lined l ON l.batch_id = f.batch_id AND l.rn = f.rn + 1),
  packed AS (SELECT f.batch_id, f.idx, sum(l.size)::BIGINT AS raw_len, count(*) AS chunks FROM fold f JOIN lined l USING (batch_id, rn) GROUP BY ALL)
  SELECT batch_id, idx::INT AS idx, coalesce(sum(raw_len) OVER (PARTITION BY batch_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_start, raw_len, chunks FROM packed""")
def frame_packing(spark, d):
    return D.frames(_placed(spark, d), 16_384, ["raw_offset", "size"])


@R.add()
def batch_compression(spark, d):
    c = B.line_chunks(spark, d)
    first = D.first_occurrences(c).select("hash", F.floor(F.col("file_id") / 50).cast("long").alias("batch_id"))
    data = c.groupBy("hash").agg(F.first(F.col("data").cast("binary")).alias("data"))
    return D.compressed(first.join(data, "hash"), level=3)


@R.add("SELECT o_orderkey AS id, s AS frame FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) o ASOF LEFT JOIN (SELECT c_custkey, f, c_custkey * 100 + f AS s, f * 40000.0 + 5000 AS start FROM customer, range(8) t(f)) c ON o.o_custkey = c.c_custkey AND o.o_totalprice >= c.start")
def frame_floor_join(spark, d):
    points = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("at"))
    steps = table(spark, d, "customer").select(F.col("c_custkey").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("f"))
    steps = steps.select("batch", (F.col("f") * 40000.0 + 5000).alias("start"), (F.col("batch") * 100 + F.col("f")).alias("frame"))
    return D.floor_join(points, steps, ["batch"], "at", "start", "frame").select("id", "frame")


@R.add(f"{with_views('line_chunks')} SELECT file_id, seq, size, coalesce(sum(size) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM line_chunks")
def running_offsets(spark, d):
    return D.running_offsets(B.line_chunks(spark, d).select("file_id", "seq", "size"))


@R.add(f"{with_views('stripes')} SELECT object_id, seq, greatest(0, 700 - data_offset) AS skip, least(data_len, 1800 - data_offset) - greatest(0, 700 - data_offset) AS take FROM stripes WHERE data_offset < 1800 AND data_offset + data_len > 700")
def range_overlap(spark, d):
    s = B.stripes(spark, d).select("object_id", "seq", F.col("data_offset").alias("start"), F.col("data_len").alias("size"))
    asked = s.select("object_id").distinct().select("object_id", F.lit(700).cast("long").alias("from"), F.lit(1800).cast("long").alias("to"))
    return D.overlap(s, asked, "object_id").select("object_id", "seq", "skip", "take")


@R.add("SELECT doc_id AS file_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def line_reassemble(spark, d):
    return D.reassemble(B.line_chunks(spark, d), joint="\n").select("file_id", F.sha2("content", 256).alias("sha256"))


@R.add()
def cdc_chunks(spark, d):
    return D.chunk(table(spark, d, "documents"), "doc_id", "text", 2048, 11, 16384).drop("data")


@R.add("SELECT doc_id AS file_id, sha256(text) AS sha256 FROM documents WHERE octet_length(encode(text)) > 0")
def cdc_reassemble(spark, d):
    c = D.chunk(table(spark, d, "documents"), "doc_id", "text", 2048, 11, 16384)
    return D.reassemble(c).select("file_id", F.sha2("content", 256).alias("sha256"))


@R.add()
def cdc_stats(spark, d):
    return D.stats(D.chunk(table(spark, d, "documents"), "doc_id", "text", 2048, 11, 16384).drop("data"))


@R.add()
def bloom_membership(spark, d):
    """(member, n, found): members are always found; the rest at about the designed rate."""
    chunks = B.line_chunks(spark, d).select("file_id", F.unhex("hash").alias("h")).distinct()
    n = chunks.select("h").distinct().count()
    m, k = K.bloom_size(n, 0.01)
    bits = spark.sparkContext.broadcast(D.bloom(chunks, "h", n, 0.01))  # m bits, sized by the parameters
    probes = chunks.select("h", F.lit(True).alias("member")).union(chunks.select(F.unhex(F.sha2(F.concat(F.lit(b"x"), "h"), 256)), F.lit(False)))
    return probes.withColumn("found", D.bloom_probe(F.col("h"), bits, m, k)).groupBy("member").agg(F.count("*").alias("n"), F.count_if(F.col("found")).alias("found"))


# -- stripes -----------------------------------------------------------------
@R.add(with_views("stripes") + "SELECT object_id, seq, data_offset, data_len, shard_size FROM stripes")
def stripe_layout(spark, d):
    return B.stripes(spark, d).select("object_id", "seq", "data_offset", "data_len", "shard_size")


@R.add("SELECT doc_id AS object_id, CASE WHEN n > 0 THEN ceil(ceil(n / 4) / 64)::BIGINT * 64 ELSE 64 END AS shard_size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def shard_size(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), S.shard_size(F.octet_length("text").cast("long"), 4).alias("shard_size"))


@R.add("""WITH chosen AS (SELECT list(id ORDER BY id) AS ids FROM (SELECT id FROM (""" + B.SQL["disks"] + """) WHERE status IN ('online', 'rebuilding') ORDER BY free_bytes DESC, id LIMIT 4))
  SELECT stripe_id, i::INT AS idx, ids[(i + turn) % 4 + 1] AS disk_id FROM (SELECT md5(doc_id::VARCHAR) AS stripe_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4 AS turn FROM documents), chosen, range(4) t(i)""")
def placement(spark, d):
    s = table(spark, d, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("stripe_id"))
    return E.placement(s, B.disks(spark), 4)


def _content(spark, d):
    s = B.stripes(spark, d)
    t = table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").cast("binary").alias("b"))
    return s.join(t, "object_id").select("object_id", "seq", "k", "m", "shard_size", "data_offset", "data_len", F.substring("b", (F.col("data_offset") + 1).cast("int"), F.col("data_len").cast("int")).alias("content"))


@R.add("SELECT doc_id AS object_id, sha256(text) AS sha256 FROM documents")
def rs_roundtrip(spark, d):
    s = _content(spark, d)
    return E.object_bytes(E.decode(E.encode(s), s)).select("object_id", F.sha2("content", 256).alias("sha256"))


_LOST = "(object_id * 31 + seq * 7 + idx) % 5"


@R.add(with_views("stripes") + f", few AS (SELECT object_id, max(lost) AS lost FROM (SELECT object_id, seq, count(*) FILTER (WHERE (object_id * 31 + seq * 7 + i) % 5 = 0) AS lost FROM stripes, range(6) t(i) GROUP BY ALL) GROUP BY 1) SELECT object_id, CASE WHEN lost <= 2 THEN sha256(text) END AS sha256 FROM few JOIN documents ON doc_id = object_id")
def rs_degraded_read(spark, d):
    s = _content(spark, d)
    left = E.encode(s).where(f"{_LOST} <> 0")
    return E.object_bytes(E.decode(left, s)).select("object_id", F.sha2("content", 256).alias("sha256"))


@R.add(with_views("stripes", "shards") + "SELECT object_id, seq, idx FROM shards WHERE state <> 'ok' AND (object_id, seq) IN (SELECT (object_id, seq) FROM shards GROUP BY object_id, seq HAVING count(*) FILTER (WHERE state = 'ok') >= 4)")
def rs_repair(spark, d):
    """The repaired shards whose bytes equal the lost ones."""
    s = _content(spark, d)
    coded = E.encode(s)
    fixed = E.repair(coded, s, B.shards(spark, d))
    return fixed.join(coded.select("object_id", "seq", "idx", F.col("checksum").alias("was")), ["object_id", "seq", "idx"]).where("checksum = was").select("object_id", "seq", "idx")


def _shard_files(spark, d):
    s = _content(spark, d).withColumn("stripe_id", F.md5(F.concat_ws("-", "object_id", "seq")))
    coded = E.encode(s).join(s.select("object_id", "seq", "stripe_id", "k", "m", "shard_size", "data_offset", "data_len"), ["object_id", "seq"])

    return coded.withColumn("file", E.shard_files(*map(F.col, ("stripe_id", "idx", "k", "m", "shard_size", "data_offset", "data_len", "checksum", "payload"))))


@R.add(with_views("stripes") + "SELECT object_id, seq, i::INT AS idx, CASE WHEN mark % 7 = 0 THEN 'missing' WHEN mark % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS state FROM (SELECT object_id, seq, i, object_id * 3 + seq + i AS mark FROM stripes, range(6) t(i))")
def shard_verify(spark, d):
    mark = F.col("object_id") * 3 + F.col("seq") + F.col("idx")
    f = _shard_files(spark, d)
    hurt = F.concat(F.substring("file", 1, 300), F.lit(b"\x00\xff"), F.expr("substring(file, 303)"))
    broken = F.when(hurt == F.col("file"), F.expr("substring(file, 1, 290)")).otherwise(hurt)
    f = f.withColumn("file", F.when(mark % 7 == 0, None).when(mark % 11 == 0, broken).otherwise(F.col("file")))
    return f.select("object_id", "seq", "idx", E.verify(F.col("file"), F.col("stripe_id"), F.col("idx"), F.col("checksum")).alias("state"))


_FOUND = with_views("stripes") + ", found AS (SELECT object_id, seq, i::INT AS idx, data_offset, data_len FROM stripes, range(6) t(i) WHERE (object_id + seq + i) % 9 <> 0 AND object_id % 4 <> 0)\n"


def _recovered(spark, d):
    f = _shard_files(spark, d).where("(object_id + seq + idx) % 9 <> 0").withColumn("h", E.headers(F.col("file")))
    own = f.select("object_id", "seq", ((F.col("object_id") + F.col("idx")) % 6 + 1).alias("disk_id"), "h.*")
    twice = own.union(own.where("idx = 1").withColumn("disk_id", F.lit(9).cast("long")))
    known = f.where("object_id % 4 = 0").select("stripe_id").distinct()
    return E.recover_index(cut(twice, "headers"), known)


@R.add(_FOUND + "SELECT object_id, max(data_offset + data_len) AS size, count(DISTINCT seq) AS stripes FROM found GROUP BY 1")
def index_recovery(spark, d):
    return _recovered(spark, d)[0]


@R.add(_FOUND + "SELECT s.object_id, s.seq, i::INT AS idx, CASE WHEN f.idx IS NOT NULL THEN (s.object_id + i) % 6 + 1 END AS disk_id, CASE WHEN f.idx IS NULL THEN 'missing' ELSE 'ok' END AS state FROM (SELECT DISTINCT object_id, seq FROM found) s CROSS JOIN range(6) t(i) LEFT JOIN found f ON f.object_id = s.object_id AND f.seq = s.seq AND f.idx = i")
def index_recovery_shards(spark, d):
    return _recovered(spark, d)[1].drop("stripe_id")


@R.add("SELECT l_orderkey AS object_id, bit_xor(l_partkey) AS parity FROM lineitem GROUP BY 1")
def xor_parity(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(F.bit_xor("l_partkey").alias("parity"))


# -- ingest ------------------------------------------------------------------
#: (name, leading bytes, type, kind, tier): what the rules of classification say of each.
CLASSIFIED = [
    ("a.jpg", b"\xff\xd8\xff\xe0", "image/jpeg", "image", "media"), ("b.bin", b"\x89PNG\r\n\x1a\n", "image/png", "image", "media"),
    ("raw.NEF", b"\xff\xd8\xff\xe0", "image/x-raw", "image", "nonmedia"), ("x", b"GIF89a", "image/gif", "image", "media"),
    ("c.webp", b"RIFF\1\2\3\4WEBP", "image/webp", "image", "media"), ("d", b"\0\0\0\x14ftypcrx \0\0\0\0crx ", "image/x-canon-cr3", "other", "nonmedia"),
    ("e", b"\0\0\0\x18ftypavif\0\0\0\0avifmif1", "image/avif", "image", "media"), ("f", b"\0\0\0\x18ftypmif1\0\0\0\0mif1avis", "image/avif", "image", "media"),
    ("g", b"\0\0\0\x18ftypmif1\0\0\0\0mif1hevx", "image/heic", "image", "media"), ("h", b"\0\0\0\x18ftypmsf1\0\0\0\0mif1msf1", "image/heif", "image", "media"),
    ("i.heic", b"\0\0\0\x18ftypheic\0\0\0\0mif1heic", "image/heic", "image", "media"), ("j.mov", b"\0\0\0\x14ftypqt  \0\0\0\0qt  ", "video/quicktime", "video", "media"),
    ("k", b"\0\0\0\x18ftyp3gp5\0\0\0\0isom3gp5", "video/3gpp", "video", "media"), ("l.mp4", b"\0\0\0\x18ftypmp42\0\0\0\0mp42isom", "video/mp4", "video", "media"),
    ("m", b"\0\0\0\x18ftypabcd\0\0\0\0abcddash", "video/mp4", "video", "media"), ("n.txt", b"\0\0\0\x18ftypabcd\0\0\0\0isomabcd"[:16] + b"abcdefgh", "text/plain", "other", "nonmedia"),
    ("o.MOV", b"\0\0\0\x08wide", "video/quicktime", "video", "media"), ("p.qt", b"no movie at all", "video/quicktime", "other", "nonmedia"),
    ("q.tar.gz", b"\x1f\x8b", "application/x-tar", "other", "nonmedia"), ("no suffix", b"hello", "application/octet-stream", "other", "nonmedia"),
]


@R.add("SELECT page_id AS id, " + ", ".join(f"CASE page_id % {len(CLASSIFIED)} " + " ".join(f"WHEN {i} THEN '{c[j]}'" for i, c in enumerate(CLASSIFIED)) + f" END AS {name}" for j, name in ((2, "mime"), (3, "kind"), (4, "tier"))) + " FROM pages")
def classify_bytes(spark, d):
    i = (F.col("page_id") % len(CLASSIFIED) + 1).cast("int")
    name, head = (F.element_at(F.array(*[F.lit(c[j]) for c in CLASSIFIED]), i) for j in (0, 1))
    body = F.concat(head, F.substring("html", 1, 64).cast("binary"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), I.classify(name, body).alias("c")).select("id", "c.*")


_EXIF = "(epoch_us(o_orderdate) // 1000000)::DOUBLE"


@R.add(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN {_EXIF} - 19800 WHEN o_orderkey % 3 <> 0 THEN o_orderkey::DOUBLE WHEN o_orderkey % 2 = 1 THEN {_EXIF} ELSE 5.0 END AS capture_ts FROM orders")
def capture_time(spark, d):
    k = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    exif = S.exif_time(F.when((k % 4 == 0) | (k % 2 == 1), text), F.when(k % 4 == 0, "+05:30").when(k % 4 == 1, "+5:3"))
    o = table(spark, d, "orders").select(k.alias("id"), exif.alias("e"), F.when(k % 3 == 0, 0.0).otherwise(k.cast("double")).alias("client"))
    return o.select("id", S.capture_time(F.col("e.ts"), F.col("e.has_tz"), F.col("client"), F.lit(5.0)).alias("capture_ts"))


@R.add("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 7 >= 5 THEN 'failed' ELSE 'queued' END AS state FROM events")
def job_retry(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), I.job_outcome(i % 7, i % 3 == 0).alias("state"))


@R.add(with_views("jobs") + "SELECT id, state FROM jobs WHERE state IN ('queued', 'running') ORDER BY id LIMIT 50")
def queue_pop(spark, d):
    return I.queue_head(B.jobs(spark, d), 50).select("id", "state")


@R.add("SELECT event_id AS id, 'f' || event_id || '.txt' AS filename, '' AS note FROM events")
def upload_metadata(spark, d):
    text = F.concat(F.lit("filename "), F.base64(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".txt")).cast("binary")), F.lit(",note"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), S.key_values(text).alias("m")).select("id", F.col("m")["filename"].alias("filename"), F.col("m")["note"].alias("note"))


# -- folds -------------------------------------------------------------------
@R.add()
def lru_cache(spark, d):
    """A cache per event type, so that no task folds the whole table."""
    e = B.events(spark, d).select(F.col("event_type").alias("shelf"), "event_id", "us", (F.col("user_id") * 7 + F.floor(F.col("value"))).alias("item"), (8000 + F.col("user_id") * 20).alias("size"))
    return T.hit_rate(T.lru(e, ["shelf"], ["us", "event_id"], "item", "size", 200_000))


@R.add()
def lru_prefetch(spark, d):
    e = B.events(spark, d).select("user_id", "event_id", F.row_number().over(C.Window.partitionBy("user_id").orderBy("us", "event_id")).alias("position"))
    return T.lru_prefetch(e, ["user_id"], ["event_id"], "position", lambda i: 80 + i % 40, 3000, 60, 1 << 30).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.sum("loads").alias("loads"))


_LINED = "lined AS (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY {1}) AS rn FROM ({2}))"


@R.add("WITH RECURSIVE " + _LINED.format("user_id", "sec, event_id", "SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec FROM events") + """,
  fold AS (SELECT user_id, event_id, sec, rn, true AS admitted, [sec] AS held FROM lined WHERE rn = 1
    UNION ALL SELECT n.user_id, n.event_id, n.sec, n.rn, n.ok, CASE WHEN n.ok THEN list_append(n.kept, n.sec) ELSE n.kept END FROM
      (SELECT l.user_id, l.event_id, l.sec, l.rn, list_filter(f.held, lambda x: l.sec - x <= 86400) AS kept, len(list_filter(f.held, lambda x: l.sec - x <= 86400)) < 2 AS ok FROM fold f JOIN lined l ON l.user_id = f.user_id AND l.rn = f.rn + 1) n)
  SELECT user_id, event_id, sec, admitted FROM fold""")
def rate_limit(spark, d):
    e = B.events(spark, d).select("user_id", "event_id", (F.col("us") / 1e6).alias("sec"))
    return T.rate_limit(e, ["user_id"], "sec", "event_id", 2, 86_400.0)


@R.add("WITH RECURSIVE " + _LINED.format("user_id", "sec, event_id", "SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, coalesce(abs(value), 0.0::DOUBLE) AS amount FROM events") + """,
  fold AS (SELECT user_id, event_id, sec, amount, rn, 50.0::DOUBLE - amount AS level FROM lined WHERE rn = 1
    UNION ALL SELECT l.user_id, l.event_id, l.sec, l.amount, l.rn, least(50.0::DOUBLE, f.level + (l.sec - f.sec) * 0.001::DOUBLE) - l.amount FROM fold f JOIN lined l ON l.user_id = f.user_id AND l.rn = f.rn + 1)
  SELECT user_id, event_id, sec, amount, greatest(0.0::DOUBLE, -level / 0.001::DOUBLE) AS delay FROM fold""")
def token_bucket(spark, d):
    e = B.events(spark, d).select("user_id", "event_id", (F.col("us") / 1e6).alias("sec"), F.coalesce(F.abs("value"), F.lit(0.0)).alias("amount"))
    return T.token_bucket(e, ["user_id"], "sec", "event_id", "amount", 0.001, 50.0)


_TOKENS = "SELECT user_id AS family, event_id, epoch_us(ts) / 1e6 AS sec, (event_id % 3)::VARCHAR AS token, CASE WHEN event_id % 41 = 0 THEN 'revoke_all' WHEN event_id % 2 = 0 THEN 'issue' ELSE 'use' END AS event FROM events"


@R.add("WITH RECURSIVE " + _LINED.format("family", "sec, event_id", _TOKENS) + """,
  fold AS (SELECT family, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::DOUBLE AS sec, NULL::VARCHAR AS token, NULL::VARCHAR AS event, NULL::VARCHAR AS outcome, false AS dead, MAP {}::MAP(VARCHAR, DOUBLE) AS issued, []::VARCHAR[] AS used FROM (SELECT DISTINCT family FROM lined)
    UNION ALL SELECT family, rn, event_id, sec, token, event, outcome, dead OR outcome IN ('revoked', 'reuse'),
      CASE WHEN outcome = 'issued' THEN map_from_entries(list_append(list_filter(map_entries(issued), lambda x: x.key <> token), {key: token, value: sec})) ELSE issued END,
      CASE WHEN outcome = 'issued' THEN list_filter(used, lambda x: x <> token) WHEN outcome = 'rotated' THEN list_append(used, token) ELSE used END FROM
      (SELECT l.family, l.rn, l.event_id, l.sec, l.token, l.event, f.dead, f.issued, f.used,
        CASE WHEN l.event = 'issue' THEN CASE WHEN f.dead THEN 'refused' ELSE 'issued' END WHEN l.event = 'revoke_all' THEN 'revoked'
          WHEN f.issued[l.token] IS NULL OR l.sec - f.issued[l.token] > 604800 THEN 'refused' WHEN f.dead OR list_contains(f.used, l.token) THEN 'reuse' ELSE 'rotated' END AS outcome
        FROM fold f JOIN lined l ON l.family = f.family AND l.rn = f.rn + 1) n)
  SELECT family, event_id, sec, token, event, outcome FROM fold WHERE rn > 0""")
def token_family(spark, d):
    i = F.col("event_id")
    e = B.events(spark, d).select(F.col("user_id").alias("family"), i, (F.col("us") / 1e6).alias("sec"), (i % 3).cast("string").alias("token"), F.when(i % 41 == 0, "revoke_all").when(i % 2 == 0, "issue").otherwise("use").alias("event"))
    return T.token_families(e, ["sec", "event_id"], "sec", 604_800.0)


@R.add()
def upload_replay(spark, d):
    i = F.col("event_id")
    event = F.when(i % 5 == 0, "create").when(i % 5 == 4, "head").when(i % 23 == 0, "terminate").otherwise("patch")
    e = B.events(spark, d).select((i % 500).alias("upload"), i, event.alias("event"), F.lit(300).alias("size"), (i % 3 * 100).alias("offset"), F.lit(100).alias("length"), (i % 7 != 0).alias("ok"))
    return T.upload_replay(e, ["event_id"])


_DISK_EVENTS = "SELECT event_id % 60 AS disk_id, event_id, epoch_us(ts) AS us, CASE WHEN event_id % 971 = 0 THEN 'retire' WHEN event_id % 100 < 97 THEN ['error', 'error', 'probe_ok', 'error'][event_id % 4 + 1] ELSE ['error', 'smart_fail', 'probe_bad'][event_id % 3 + 1] END AS event FROM events"


@R.add("WITH RECURSIVE " + _LINED.format("disk_id", "us, event_id", _DISK_EVENTS) + """,
  fold AS (SELECT disk_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS us, NULL::VARCHAR AS event, 'online' AS status, 0 AS errors FROM (SELECT DISTINCT disk_id FROM lined)
    UNION ALL SELECT l.disk_id, l.rn, l.event_id, l.us, l.event, CASE WHEN l.event = 'retire' OR f.status = 'retired' THEN 'retired'
      WHEN l.event = 'error' THEN CASE WHEN f.status = 'online' AND f.errors + 1 >= 10 THEN 'degraded' ELSE f.status END WHEN l.event = 'probe_bad' THEN 'failed'
      WHEN f.status = 'failed' THEN 'online' WHEN f.status = 'online' AND l.event = 'smart_fail' THEN 'degraded' ELSE f.status END, f.errors + (l.event = 'error')::INT
      FROM fold f JOIN lined l ON l.disk_id = f.disk_id AND l.rn = f.rn + 1)
  SELECT disk_id, event_id, us, event, status, errors FROM fold WHERE rn > 0""")
def disk_health(spark, d):
    i = F.col("event_id")
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    event = F.when(i % 971 == 0, "retire").when(i % 100 < 97, of(("error", "error", "probe_ok", "error"), i % 4)).otherwise(of(("error", "smart_fail", "probe_bad"), i % 3))
    return T.disk_health(B.events(spark, d).select((i % 60).alias("disk_id"), i, "us", event.alias("event")), ["us", "event_id"])


@R.add("WITH RECURSIVE " + _LINED.format("job", "event_id", "SELECT event_id % 400 AS job, event_id, ['start', 'error', 'start', 'ok', 'restart'][event_id // 7 % 5 + 1] AS event FROM events") + """,
  fold AS (SELECT job, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS event, 'queued' AS state, 0 AS attempts FROM (SELECT DISTINCT job FROM lined)
    UNION ALL SELECT l.job, l.rn, l.event_id, l.event, CASE WHEN l.event = 'start' AND f.state = 'queued' THEN 'running' WHEN f.state <> 'running' THEN f.state
      WHEN l.event = 'ok' THEN 'done' WHEN l.event = 'error' THEN CASE WHEN f.attempts >= 5 THEN 'failed' ELSE 'queued' END WHEN l.event = 'restart' THEN 'queued' ELSE f.state END,
      f.attempts + (l.event = 'start' AND f.state = 'queued')::INT FROM fold f JOIN lined l ON l.job = f.job AND l.rn = f.rn + 1)
  SELECT job, event_id, event, state, attempts FROM fold WHERE rn > 0""")
def job_states(spark, d):
    i = F.col("event_id")
    event = F.element_at(F.array(*map(F.lit, ("start", "error", "start", "ok", "restart"))), (F.floor(i / 7) % 5 + 1).cast("int"))
    return T.job_states(B.events(spark, d).select((i % 400).alias("job"), i, event.alias("event")), ["event_id"])


@R.add(with_views("files") + ", " + _LINED.format("album", "id", "SELECT camera_make AS album, id, least(3.0::DOUBLE, greatest(0.4::DOUBLE, width::DOUBLE / height)) AS aspect FROM files") + """,
  fold AS (SELECT album, rn, 0 AS line, 1 AS n, aspect AS sum, 1000.0::DOUBLE / aspect <= 200 AS full FROM lined WHERE rn = 1
    UNION ALL SELECT album, rn, line, n, s, (1000.0::DOUBLE - 4 * (n - 1)) / s <= 200 FROM
      (SELECT l.album, l.rn, f.line + f.full::INT AS line, CASE WHEN f.full THEN 1 ELSE f.n + 1 END AS n, CASE WHEN f.full THEN l.aspect ELSE f.sum + l.aspect END AS s FROM fold f JOIN lined l ON l.album IS NOT DISTINCT FROM f.album AND l.rn = f.rn + 1) x)
  SELECT album, line::INT AS row, max(n)::BIGINT AS pictures, least(200.0::DOUBLE, (1000.0::DOUBLE - 4 * (max(n) - 1)) / max(sum)) AS height FROM fold GROUP BY 1, 2""")
def justified_rows(spark, d):
    f = B.files(spark, d).select(F.col("camera_make").alias("album"), "id", "width", "height")
    return T.row_heights(T.justified_rows(f, ["album"], ["id"], "width", "height", 1000.0), ["album"], 1000.0)
