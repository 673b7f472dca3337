"""The registered queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm import ann, bpe, fingerprint, html_text, lang_id, lm_score, mixing, ngram_join, suffix_dedup, warc
from galena.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"), k=4, numerator=85, denominator=100)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order: documents range-sorted by their first position, those that the mix leaves out last."""
    d = mixing.mix(_table(spark, sf_dir, "documents")).withColumns({"first_position": F.get("positions", F.lit(0)), "last_position": F.get("positions", F.size("positions") - 1)})
    d = d.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "first_position", "last_position")
    order = [F.asc_nulls_last("first_position"), F.asc("doc_id")]
    return d.repartitionByRange(*order).sortWithinPartitions(*order)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = cut(warc.archives(warc.plan_revisits(_table(spark, sf_dir, "pages"))), "warc")
    back = warc.read(written, payloads=False)
    back = back.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True))  # a broken record is no page
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_id: the smallest doc_id of the near duplicates, found by bands of the fingerprints and verified."""
    d = _table(spark, sf_dir, "documents")
    f = fingerprint.compare_with_next(d)
    f = f.select("id", F.length("text").cast("long").alias("n_chars"), _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return fingerprint.with_near(f, d).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_ngram_join, op3_suffix_dedup, op4_lang_id, op5_html_text, op6_mixing, op7_ann, op8_lm_score, op9_warc, op10_fingerprint)}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
ORACLES = {
    "op6_mixing": rf"""
WITH sized AS (SELECT doc_id, {_WORDS} AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS h, source IS NULL AS none, coalesce(source, '') AS name FROM documents),
total AS (SELECT none, name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, row_number() OVER (ORDER BY none, encode(name)) - 1 AS idx FROM total),
capped AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM weighed),
levels AS (SELECT *, row_number() OVER o AS rn,
  ((sum(source_size) OVER ())::DOUBLE * 3 / 2 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM capped WINDOW o AS (ORDER BY cap::DOUBLE / w, idx)),
fill AS (SELECT arg_min(lvl, rn) AS f FROM levels WHERE cap > w * lvl),
goals AS (SELECT none, name, idx, source_size, CASE WHEN cap > w * f THEN w * f ELSE cap::DOUBLE END AS target FROM levels, fill),
placed AS (SELECT s.doc_id, s.size, g.source_size, g.target,
  CASE idx % 3 WHEN 2 THEN 3.0 ELSE 1.0 END::DOUBLE AS w0, CASE idx % 3 WHEN 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS w1, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS full_copies,
  sum(s.size) OVER (PARTITION BY s.none, s.name ORDER BY h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN goals g ON s.none = g.none AND s.name = g.name),
counted AS (SELECT *, (full_copies + CASE WHEN size > 0 AND start + size / 2.0 <= target - full_copies * source_size THEN 1 ELSE 0 END)::INT AS copies FROM placed),
shares AS (SELECT *, least(1.0::DOUBLE, start::DOUBLE / greatest(target, 1.0::DOUBLE)) AS s1,
  least(1.0::DOUBLE, ((copies - 1) * source_size + start)::DOUBLE / greatest(target, 1.0::DOUBLE)) AS s2 FROM counted)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN CASE WHEN w1 = w0 THEN s1 ELSE (sqrt(w0 * w0 + (w1 - w0) * (w0 + w1) * s1) - w0) / (w1 - w0) END END AS first_position,
  CASE WHEN copies > 0 THEN CASE WHEN w1 = w0 THEN s2 ELSE (sqrt(w0 * w0 + (w1 - w0) * (w0 + w1) * s2) - w0) / (w1 - w0) END END AS last_position FROM shares""",
    "op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p)
SELECT page_id, payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::INT, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""",
}
