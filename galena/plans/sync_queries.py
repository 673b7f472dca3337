"""Queries of the reconciliation, spatial and near-duplicate families."""

from __future__ import annotations

from pyspark.sql import functions as F

from galena.functions import scalars as S
from galena.operators import similarity as N
from galena.operators import spatial as G
from galena.operators import sync as Y
from galena.plans.registry import Registry
from galena.session import cut
from galena.sources import bindings as B
from galena.sources.bindings import table, with_views

R = Registry()

# -- reconciliation ----------------------------------------------------------
_LEAVES = "SELECT path, sha256(unhex(string_agg(sha256, '' ORDER BY sha256))) AS hash FROM (SELECT DISTINCT sha256, substr(sha256, 1, 3) AS path FROM {0}) GROUP BY 1"


def _up(name: str) -> str:
    return f"SELECT up AS path, sha256(unhex(string_agg(coalesce(n.hash, repeat('0', 64)), '' ORDER BY i))) AS hash FROM (SELECT DISTINCT substr(path, 1, length(path) - 1) AS up FROM {name}) u CROSS JOIN range(16) t(i) LEFT JOIN {name} n ON n.path = up || lower(hex(i)[-1:]) GROUP BY 1"


_ITEMS = with_views("device_items") + f", l3 AS ({_LEAVES.format('device_items')}), l2 AS ({_up('l3')}), l1 AS ({_up('l2')}), l0 AS ({_up('l1')})\n"


@R.add(with_views("device_items") + _LEAVES.format("device_items"))
def merkle_leaves(spark, d):
    return Y.leaves(B.device_items(spark, d))


@R.add(_ITEMS + "SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0")
def merkle_nodes(spark, d):
    return Y.tree(B.device_items(spark, d))


@R.add(_ITEMS + "SELECT hash AS root FROM l0")
def merkle_root(spark, d):
    return Y.tree(B.device_items(spark, d)).where("path = ''").select(F.col("hash").alias("root"))


@R.add(_ITEMS + "SELECT lower(hex(i)[-1:]) AS digit, coalesce(hash, repeat('0', 64)) AS hash FROM range(16) t(i) LEFT JOIN l2 ON path = 'a' || lower(hex(i)[-1:])")
def merkle_children(spark, d):
    return Y.children(Y.tree(B.device_items(spark, d)), "a")


@R.add(with_views("device_items", "stored_items") + "SELECT sha256, 'missing' AS side FROM (SELECT sha256 FROM device_items EXCEPT SELECT sha256 FROM stored_items WHERE NOT purged) UNION ALL SELECT sha256, 'extra' FROM (SELECT sha256 FROM stored_items WHERE NOT purged EXCEPT SELECT sha256 FROM device_items)")
def merkle_diff(spark, d):
    return Y.diff(B.device_items(spark, d), B.stored_items(spark, d).where("NOT purged"))


@R.add(with_views("device_items", "stored_items", "jobs") + "SELECT DISTINCT a.sha256, CASE WHEN a.sha256 IN (SELECT sha256 FROM stored_items) THEN 'linked' WHEN a.sha256 IN (SELECT sha256 FROM jobs WHERE state IN ('queued', 'running')) THEN 'processing' ELSE 'upload' END AS status FROM device_items a")
def reconcile(spark, d):
    return Y.reconcile(B.device_items(spark, d), B.stored_items(spark, d), B.jobs(spark, d))


@R.add(with_views("device_items", "stored_items") + "SELECT device_id, count(*) FILTER (WHERE s.sha256 IS NOT NULL) AS known, count(*) FILTER (WHERE s.sha256 IS NULL) AS need FROM device_items LEFT JOIN stored_items s USING (sha256) GROUP BY 1")
def need_upload_split(spark, d):
    j = B.device_items(spark, d).join(B.stored_items(spark, d).select("sha256", "purged"), "sha256", "left")
    return j.groupBy("device_id").agg(F.count_if(F.col("purged").isNotNull()).alias("known"), F.count_if(F.col("purged").isNull()).alias("need"))


@R.add(with_views("files", "stored_items") + "SELECT sha256 FROM stored_items WHERE sha256 NOT IN (SELECT sha256('item-' || id) FROM files WHERE tier = 'media')")
def reingest_anti(spark, d):
    own = B.files(spark, d).where("tier = 'media'").select(F.sha2(F.concat(F.lit("item-"), F.col("id").cast("string")), 256).alias("sha256"))
    return B.stored_items(spark, d).select("sha256").join(own, "sha256", "left_anti")


@R.add(with_views("device_items", "stored_items") + ", m AS (SELECT * FROM device_items), a AS (SELECT DISTINCT user_id AS device_id, sha256('item-' || (event_id * 7 % 2000)) AS sha256 FROM events), r AS (SELECT * FROM (SELECT * FROM m UNION SELECT * FROM a) WHERE sha256 IN (SELECT sha256 FROM stored_items WHERE purged)) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM m)) AS linked, (SELECT count(*) FROM r) AS unlinked, (SELECT count(*) FROM ((SELECT * FROM m UNION SELECT * FROM a) EXCEPT SELECT * FROM r)) AS total")
def manifest_link(spark, d):
    """All manifests at once: what other items of the same devices add, and what tombstones remove."""
    i = B.device_items(spark, d)
    add = table(spark, d, "events").select(F.col("user_id").alias("device_id"), F.sha2(F.concat(F.lit("item-"), (F.col("event_id") * 7 % 2000).cast("string")), 256).alias("sha256"))
    after, added, removed = Y.link(i, add, i.union(add).join(B.stored_items(spark, d).where("purged"), "sha256", "left_semi").select("device_id", "sha256"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(added, "linked").crossJoin(one(removed, "unlinked")).crossJoin(one(after, "total"))  # one row each


@R.add(with_views("device_items") + "SELECT device_id, CASE WHEN device_id % 3 = 0 THEN 'up_to_date' WHEN remote = 0 OR abs(n - remote) > 0.05 * greatest(n, 1) THEN 'bulk' ELSE 'merkle' END AS mode, 100 + 1082 * (device_id % 5) + 67 * n AS bytes FROM (SELECT device_id, count(*) AS n, count(*) - device_id % 7 AS remote FROM device_items GROUP BY 1)")
def sync_plan(spark, d):
    c = B.device_items(spark, d).groupBy("device_id").agg(F.count("*").alias("n"))
    return c.select("device_id", Y.plan_mode(F.col("n"), F.col("n") - F.col("device_id") % 7, F.col("device_id") % 3 == 0).alias("mode"), Y.wire_bytes(F.col("device_id") % 5, F.col("n")).alias("bytes"))


# -- near duplicates ---------------------------------------------------------
_HALF = "('0x' || substr(sha256(w), {0}, 8))::BIGINT"
_CODES = f"""tokens AS (SELECT DISTINCT doc_id AS id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents),
  halves AS (SELECT id, {_HALF.format(1)} AS hi, {_HALF.format(9)} AS lo FROM tokens),
  sums AS (SELECT id, count(*) AS n, {', '.join(f"sum((hi >> {31 - b}) & 1) AS b{b}" for b in range(32))}, {', '.join(f"sum((lo >> {31 - b}) & 1) AS b{32 + b}" for b in range(32))} FROM halves GROUP BY 1),
  codes AS (SELECT id, ((CASE WHEN 2 * b0 > n THEN (-9223372036854775808)::BIGINT ELSE 0 END) + {' + '.join(f"(CASE WHEN 2 * b{b} > n THEN {1 << (63 - b)}::BIGINT ELSE 0 END)" for b in range(1, 64))})::BIGINT AS code FROM sums)"""
_PAIRS = "pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b, bit_count(xor(x.code, y.code))::INT AS distance FROM codes x JOIN codes y ON x.id < y.id WHERE bit_count(xor(x.code, y.code)) <= 10)"


def _codes(spark, d):
    return cut(table(spark, d, "documents").select(F.col("doc_id").alias("id"), N.simhash(F.col("text")).alias("code")), "codes")


@R.add("WITH " + _CODES + " SELECT id, code FROM codes")
def simhash_codes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), N.simhash(F.col("text")).alias("code"))


@R.add(f"WITH {_CODES}, {_PAIRS} SELECT * FROM pairs")
def hamming_pairs(spark, d):
    return N.hamming_pairs(_codes(spark, d), 10)


@R.add(f"WITH {_CODES}, {_PAIRS} SELECT * FROM pairs")
def hamming_pairs_bands(spark, d):
    return N.hamming_pairs(_codes(spark, d), 10, "bands")


@R.add(f"WITH {_CODES} SELECT q.id AS query, c.id, bit_count(xor(q.code, c.code))::INT AS distance FROM codes q JOIN codes c ON bit_count(xor(q.code, c.code)) <= 7 WHERE q.id % 20 = 0")
def hamming_query(spark, d):
    c = _codes(spark, d)
    return N.hamming_search(c, c.where("id % 20 = 0"), 7)


# each round every member takes the smallest label among its neighbours
_GROUPS = f"""{_CODES}, {_PAIRS}, linked AS MATERIALIZED (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
  walk(id, root) AS (SELECT x, x FROM linked UNION SELECT l.y, w.root FROM walk w JOIN linked l ON l.x = w.id WHERE w.root < l.y),
  grouped AS (SELECT id, min(root) AS dup_group FROM walk GROUP BY 1)"""


@R.add(f"WITH RECURSIVE {_GROUPS} SELECT * FROM grouped")
def dup_groups(spark, d):
    return N.groups(_codes(spark, d), 10)


_LIVE_GROUPS = _GROUPS.replace("tokens AS (SELECT DISTINCT doc_id AS id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents)", "tokens AS (SELECT DISTINCT doc_id AS id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents WHERE doc_id % 17 <> 0)")
_RANKED = f"ranked AS (SELECT f.*, g.dup_group, count(*) OVER (PARTITION BY dup_group) AS members, sum(size) OVER (PARTITION BY dup_group) AS bytes, row_number() OVER (PARTITION BY dup_group ORDER BY width * height DESC, sharpness DESC, capture_ts, f.id) AS r FROM files f JOIN grouped g ON f.id = g.id WHERE trashed_at IS NULL AND NOT dup_reviewed)"
_REPORT = f"WITH RECURSIVE files AS ({B.SQL['files']}), {_LIVE_GROUPS}, {_RANKED} "


def _live_groups(spark, d):
    f = B.files(spark, d)
    codes = B.live(f).select("id", N.simhash(F.col("content")).alias("code"))
    return f, N.groups(cut(codes, "codes"), 10)


@R.add(_REPORT + "SELECT dup_group, id AS keeper, members, (bytes - size)::BIGINT AS reclaimable FROM ranked WHERE r = 1 AND members > 1")
def dup_report(spark, d):
    f, g = _live_groups(spark, d)
    return N.report(f, g)


@R.add(_REPORT + "SELECT count(*) AS n, coalesce(sum(bytes - size), 0)::BIGINT AS reclaimable FROM ranked WHERE r = 1 AND members > 1")
def reclaimable_total(spark, d):
    f, g = _live_groups(spark, d)
    return N.report(f, g).agg(F.count("*").alias("n"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))


@R.add(_REPORT + ", own AS (SELECT dup_group, id FROM grouped) SELECT dup_group, id, CASE WHEN NOT max(id % 2 = 0) OVER (PARTITION BY dup_group) THEN 'refused' WHEN id % 2 = 0 THEN 'keep' ELSE 'trash' END AS action FROM own")
def dup_resolve(spark, d):
    f, g = _live_groups(spark, d)
    return N.resolve(g, f.where("id % 2 = 0").select("id"))


@R.add(f"WITH {_CODES}, labelled AS MATERIALIZED (SELECT bit_count(xor(x.code, y.code))::INT AS distance, a.lang || a.source = b.lang || b.source AS same FROM codes x JOIN codes y ON x.id < y.id JOIN documents a ON a.doc_id = x.id JOIN documents b ON b.doc_id = y.id) SELECT r::INT AS radius, tp, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 1 END AS precision, tp / positive AS recall, CASE WHEN tp > 0 THEN 2 * (tp / predicted) * (tp / positive) / (tp / predicted + tp / positive) ELSE 0 END AS f1 FROM (SELECT r, count(*) FILTER (WHERE distance <= r AND same) AS tp, count(*) FILTER (WHERE distance <= r) AS predicted, count(*) FILTER (WHERE same) AS positive FROM labelled, (VALUES (0), (4), (7), (10), (12)) v(r) GROUP BY r)")
def pr_curve(spark, d):
    own = _codes(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", "source").alias("label")), "id")
    return N.pr_curve(own, [0, 4, 7, 10, 12])


# -- space -------------------------------------------------------------------
def _bits(v: str, low: int, span: int, n: int) -> str:
    return f"least({2**n - 1}, greatest(0, floor(({v} - ({low})) / {span}.0 * {2**n})))::BIGINT"


_DIGITS = "substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + ({})::INT, 1)"
_HASH = " || ".join(_DIGITS.format(" + ".join(f"(({'x' if (5 * c + b) % 2 == 0 else 'y'} >> {(22 if (5 * c + b) % 2 == 0 else 21) - (5 * c + b) // 2}) & 1) * {16 >> b}" for b in range(5))) for c in range(9))
_GEO = with_views("files") + f", geo AS (SELECT id, lat, lon, capture_ts AS ts, tier, trashed_at, {_bits('lon', -180, 360, 23)} AS x, {_bits('lat', -90, 180, 22)} AS y FROM files WHERE lat IS NOT NULL)\n"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


def _geo(spark, d):
    return B.files(spark, d).where("lat IS NOT NULL").select("id", "lat", "lon", F.col("capture_ts").alias("ts"), "tier", "trashed_at")


@R.add(_GEO + f"SELECT id, {_HASH} AS geohash FROM geo")
def geohash9(spark, d):
    return _geo(spark, d).select("id", S.geohash(F.col("lat"), F.col("lon")).alias("geohash"))


@R.add(_GEO + f"SELECT id, round({_KM.format('lat', 'lon', '40.0', '20.0')}, 6) AS km FROM geo WHERE {_KM.format('lat', 'lon', '40.0', '20.0')} <= 3000 ORDER BY ts DESC, id DESC LIMIT 50")
def near_search(spark, d):
    return G.near(_geo(spark, d), 40.0, 20.0, 3000.0, 50).select("id", F.round("km", 6).alias("km"))


@R.add(_GEO + f"SELECT id, round({_KM.format('lat', 'lon', '82.0', '179.0')}, 6) AS km FROM geo WHERE {_KM.format('lat', 'lon', '82.0', '179.0')} <= 1500")
def near_search_pole(spark, d):
    return G.near(_geo(spark, d), 82.0, 179.0, 1500.0).select("id", F.round("km", 6).alias("km"))


@R.add(_GEO + f"SELECT a.id, b.id AS other, round({_KM.format('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM geo a JOIN geo b ON a.id < b.id AND abs(a.lat - b.lat) < 3 WHERE {_KM.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 300")
def radius_join(spark, d):
    g = _geo(spark, d)
    return G.radius_join(g, g, 300.0).withColumn("km", F.round("km", 6))


@R.add(_GEO + "SELECT id FROM geo WHERE trashed_at IS NULL AND lat BETWEEN -10 AND 45 AND (lon >= 120 OR lon <= -150) ORDER BY ts DESC, id DESC LIMIT 100")
def bbox_items(spark, d):
    g = _geo(spark, d).where(F.col("trashed_at").isNull() & G.in_box(F.col("lat"), F.col("lon"), -10, 120, 45, -150))
    return g.orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id")


_MX = "least(1 - 1e-12, greatest(0.0, (lon + 180) / 360))"
_MY = "least(1 - 1e-12, greatest(0.0, 0.5 - ln((1 + sin(radians(least(85.05112878, greatest(-85.05112878, lat))))) / (1 - sin(radians(least(85.05112878, greatest(-85.05112878, lat)))))) / (4 * pi())))"
_CELLS = _GEO + f", cells AS (SELECT floor(mx * 32)::BIGINT AS cx, floor(my * 32)::BIGINT AS cy, count(*) AS n, arg_max(id, (ts, id)) AS file_id FROM (SELECT *, {_MX} AS mx, {_MY} AS my FROM geo) WHERE lat BETWEEN -40 AND 60 AND (lon >= 100 OR lon <= -20) GROUP BY 1, 2)\n"


@R.add(_CELLS + "SELECT cx, cy, n, file_id FROM cells")
def map_clusters(spark, d):
    return G.clusters(_geo(spark, d), 3, (-40, 100, 60, -20), "point").select("cx", "cy", "n", "file_id")


@R.add(_CELLS + "SELECT coalesce(sum(n), 0)::BIGINT AS total FROM cells")
def cluster_total(spark, d):
    return G.clusters(_geo(spark, d), 3, (-40, 100, 60, -20), "point").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


@R.add(_GEO + "SELECT count(*) AS total FROM geo")
def clusters_whole_map(spark, d):
    return G.clusters(_geo(spark, d), 8, (-90, -180, 90, 180)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
