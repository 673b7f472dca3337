"""Queries that read bytes back, repair and recode the store, walk trees, and ingest a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from galena.functions import scalars as S
from galena.operators import dedup as D
from galena.operators import erasure as E
from galena.operators import ingest as I
from galena.operators import maintenance as M
from galena.operators import similarity as N
from galena.operators import spatial as G
from galena.operators import sync as Y
from galena.plans.content_queries import _PLACED, _content, _placed
from galena.plans.registry import Registry
from galena.plans.sync_queries import _LEAVES, _up
from galena.plans.upkeep_queries import R as _UPKEEP
from galena.session import cut
from galena.sources import bindings as B
from galena.sources.bindings import table, with_views

R = Registry()


# -- bytes read back ---------------------------------------------------------
@R.add("SELECT object_id, sha256(substr(h, 1401, 2200)) AS sha256 FROM (SELECT doc_id AS object_id, hex(encode(text)) AS h FROM documents) WHERE length(h) > 1400")
def range_read(spark, d):
    """Bytes 700 to 1800 of each object, read from its stripes with two shards of each lost."""
    s = _content(spark, d)
    parts = E.decode(E.encode(s).where("idx NOT IN (1, 4)"), s).select("object_id", F.col("data_offset").alias("start"), F.octet_length("data").cast("long").alias("size"), "data")
    asked = s.select("object_id").distinct().select("object_id", F.lit(700).cast("long").alias("from"), F.lit(1800).cast("long").alias("to"))
    return D.range_read(parts, asked, "object_id").select("object_id", F.sha2(F.hex("content"), 256).alias("sha256"))


@R.add(f"{_PLACED} SELECT hash, size, true AS ok FROM placed")
def chunk_reads(spark, d):
    """Every stored chunk, cut out of its sealed frame and verified."""
    placed = _placed(spark, d)
    data = B.line_chunks(spark, d).groupBy("hash").agg(F.any_value(F.col("data").cast("binary")).alias("data"))
    held = cut(placed.join(data, "hash"), "placed")
    frames = cut(D.sealed(held, 16_384, ["raw_offset", "size"]), "sealed")
    return D.read_chunks(held, frames).select("hash", F.octet_length("data").cast("long").alias("size"), "ok")


@R.add(f"{_PLACED} SELECT file_id, seq, hash, size, batch_id, raw_offset FROM line_chunks JOIN (SELECT hash, batch_id, raw_offset FROM placed) USING (hash)")
def chunk_batches(spark, d):
    return D.batch_of_chunks(B.line_chunks(spark, d), _placed(spark, d))


# -- upkeep ------------------------------------------------------------------
@R.add("SELECT doc_id AS object_id, sha256(text) AS sha256 FROM documents")
def restripe_roundtrip(spark, d):
    """All objects recoded from 4 + 2 to 3 + 2 shards, and read with two of them lost."""
    s = cut(_content(spark, d), "content")
    stripes, shards = E.restripe(E.encode(s).where("idx <> 2"), s.drop("content"), 3, 2)
    return E.object_bytes(E.decode(shards.where("idx NOT IN (0, 3)"), stripes)).select("object_id", F.sha2("content", 256).alias("sha256"))


@R.add(with_views("stripes", "shards") + """, counted AS (SELECT object_id, seq, count(*) FILTER (WHERE state <> 'ok') AS bad, count(*) FILTER (WHERE state = 'ok') AS good FROM shards GROUP BY ALL)
  SELECT object_id, seq, bad, CASE WHEN bad = 0 THEN 'ok' WHEN good >= k THEN 'repaired' ELSE 'lost' END AS outcome FROM stripes JOIN counted USING (object_id, seq)
  WHERE bad > 0 OR coalesce(last_scrubbed_at, 0) < 1706832000 ORDER BY bad > 0 DESC, coalesce(last_scrubbed_at, 0), object_id, seq LIMIT 300""")
def scrub_pass(spark, d):
    return E.scrub_pass(B.stripes(spark, d), B.shards(spark, d), 300, 1_706_832_000.0)


@R.add(f"SELECT object_id, seq, idx, disk_id, true AS same FROM ({_UPKEEP.oracles['evacuate_disk']}) WHERE disk_id IS NOT NULL")
def evacuate_rebuild(spark, d):
    """The shards of a failed disk, computed from the others of their stripes, with their new disks; same: the bytes equal the lost ones."""
    s = cut(_content(spark, d), "content")
    coded = cut(E.encode(s), "coded")
    moves = M.evacuate(B.shards(spark, d), B.disks(spark), 5)
    new = E.rebuild(coded, s.drop("content"), moves, B.disks(spark))
    old = coded.select("object_id", "seq", "idx", F.col("checksum").alias("was"))
    return new.join(old, ["object_id", "seq", "idx"]).select("object_id", "seq", "idx", "disk_id", (F.col("checksum") == F.col("was")).alias("same"))


# -- trees -------------------------------------------------------------------
_BOTH = with_views("device_items", "stored_items") + f""", ours AS (SELECT * FROM stored_items WHERE NOT purged),
  a3 AS ({_LEAVES.format('device_items')}), a2 AS ({_up('a3')}), a1 AS ({_up('a2')}), a0 AS ({_up('a1')}), b3 AS ({_LEAVES.format('ours')}), b2 AS ({_up('b3')}), b1 AS ({_up('b2')}), b0 AS ({_up('b1')}),
  d AS ({' UNION ALL '.join(f"SELECT {i} AS level, count(*) AS differing FROM a{i} x FULL JOIN b{i} y USING (path) WHERE x.hash IS DISTINCT FROM y.hash" for i in range(4))})
"""


@R.add(_BOTH + "SELECT d.level, CASE WHEN d.level = 0 THEN 1 ELSE 16 * up.differing END AS touched, d.differing FROM d LEFT JOIN d up ON up.level = d.level - 1")
def merkle_walk(spark, d):
    return Y.walk(Y.tree(B.device_items(spark, d)), Y.tree(B.stored_items(spark, d).where("NOT purged")))


# -- places ------------------------------------------------------------------
@R.add(with_views("files") + "SELECT id, floor((lat + 90) / 180 * 4194304) / 4194304 * 180 - 90 AS south, (floor((lat + 90) / 180 * 4194304) + 1) / 4194304 * 180 - 90 AS north, floor((lon + 180) / 360 * 8388608) / 8388608 * 360 - 180 AS west, (floor((lon + 180) / 360 * 8388608) + 1) / 8388608 * 360 - 180 AS east FROM files WHERE lat IS NOT NULL")
def geohash_box(spark, d):
    f = B.files(spark, d).where("lat IS NOT NULL")
    coded = f.select("id", F.inline(F.array(F.struct(S.geohash(F.col("lat"), F.col("lon")).alias("g")))))  # computed once for all digits
    return coded.select("id", F.inline(F.array(S.geohash_box(F.col("g")))))


@R.add(with_views("files") + "SELECT id FROM files WHERE abs(floor((lat + 90) / 180 * 32) - floor((48.5 + 90) / 180 * 32)) <= 1 AND least(abs(floor((lon + 180) / 360 * 32) - floor((179.5 + 180) / 360 * 32)), 32 - abs(floor((lon + 180) / 360 * 32) - floor((179.5 + 180) / 360 * 32))) <= 1")
def geohash_cover(spark, d):
    """Files in the nine cells that cover 600 km around a place at the antimeridian."""
    return B.files(spark, d).where("lat IS NOT NULL").where(G.in_covering(F.col("lat"), F.col("lon"), 48.5, 179.5, 600.0)).select("id")


# -- pictures ----------------------------------------------------------------
def _grey(i: str) -> str:
    return f"((page_id * 31 + ({i}) * ({i}) * 7 + ({i}) * page_id) % 251)"


def _pixels(spark, d, n):
    p = F.col("page_id")
    grey = lambda i: ((p * 31 + i * i * 7 + i * p) % 251).cast("double")
    return table(spark, d, "pages").select(p.alias("id"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), grey).alias("pixels"))


@R.add(f"SELECT page_id AS id, sum(CASE WHEN {_grey('9 * (b // 8) + b % 8 + 1')} > {_grey('9 * (b // 8) + b % 8')} THEN CASE WHEN b = 0 THEN (-9223372036854775808)::HUGEINT ELSE 1::HUGEINT << (63 - b)::INT END ELSE 0 END)::BIGINT AS code FROM pages, range(64) t(b) GROUP BY 1")
def image_gradient_codes(spark, d):
    return _pixels(spark, d, 72).select("id", N.image_codes(F.col("pixels"), F.lit(9), "dhash").alias("code"))


@R.add()  # SQL disagreed on some pictures of sf0.01: likely ties of the median in the last bit, which isn't shown
def image_frequency_codes(spark, d):
    return _pixels(spark, d, 1024).select("id", N.image_codes(F.col("pixels"), F.lit(32), "phash").alias("code"))


@R.add(f"""WITH px AS (SELECT page_id AS id, i // 16 AS y, i % 16 AS x, {_grey("i")}::DOUBLE AS v FROM pages, range(256) t(i)),
  sums AS (SELECT p.id, p.x, p.y, sum(q.v) FILTER (WHERE q.x <> p.x OR q.y <> p.y) - 4 * p.v AS l FROM px p JOIN px q ON q.id = p.id AND abs(q.x - p.x) + abs(q.y - p.y) <= 1 WHERE p.x BETWEEN 1 AND 14 AND p.y BETWEEN 1 AND 14 GROUP BY p.id, p.x, p.y, p.v)
  SELECT id, round(var_pop(l), 6) AS sharpness FROM sums GROUP BY 1""")
def image_sharpness(spark, d):
    return _pixels(spark, d, 256).select("id", F.round(N.image_codes(F.col("pixels"), F.lit(16), "sharpness"), 6).alias("sharpness"))


# -- ingest ------------------------------------------------------------------
@R.add("""WITH u AS (SELECT page_id AS id, sha256(html) AS actual, CASE WHEN page_id % 7 = 0 THEN sha256('another') ELSE sha256(html) END AS sha256, octet_length(encode(html)) AS size, page_id % 13 AS device FROM pages),
  f AS (SELECT sha256(html) AS sha256, min(page_id) AS known_id FROM pages WHERE page_id % 5 = 0 GROUP BY 1),
  j AS (SELECT u.*, known_id, min(CASE WHEN known_id IS NULL AND actual = u.sha256 THEN id END) OVER (PARTITION BY u.sha256) AS first_id FROM u LEFT JOIN f USING (sha256)),
  o AS (SELECT *, CASE WHEN known_id IS NOT NULL THEN 'known' WHEN actual <> sha256 THEN 'corrupt' WHEN id = first_id THEN 'stored' ELSE 'linked' END AS outcome FROM j)
  SELECT id, outcome, sha256, CASE WHEN outcome = 'stored' THEN size::BIGINT END AS size, CASE WHEN outcome = 'stored' THEN 'text/html' END AS mime, CASE WHEN outcome = 'stored' THEN 'other' END AS kind, CASE WHEN outcome = 'stored' THEN 'nonmedia' END AS tier,
  CASE WHEN outcome <> 'corrupt' THEN coalesce(known_id, first_id) END AS file_id, CASE WHEN outcome <> 'corrupt' THEN device END AS device_id FROM o""")
def ingest_batch(spark, d):
    p = F.col("page_id")
    pages = table(spark, d, "pages")
    declared = F.when(p % 7 == 0, F.sha2(F.lit("another"), 256)).otherwise(F.upper(F.sha2("html", 256)))
    uploads = pages.select(p.alias("id"), F.concat(F.lit("page"), p.cast("string"), F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"), declared.alias("sha256"), (p % 13).alias("device_id"))
    return I.ingest_batch(uploads, pages.where(p % 5 == 0).select(F.sha2("html", 256).alias("sha256"), p.alias("id")))


@R.add(with_views("jobs") + "SELECT state, count(DISTINCT sha256) AS hashes FROM jobs GROUP BY 1")
def distinct_hashes(spark, d):
    return B.jobs(spark, d).groupBy("state").agg(F.count_distinct("sha256").alias("hashes"))
