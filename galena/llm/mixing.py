"""Mixing sources to target weights with a time-varying curriculum (operator 6, DataFrame functions only).

Sizes are words. Sources in code-point order, null last, have cycling weights and share `share` times all words; a
target stops at `cap` times its source's words and the excess is shared again by weight. Within a source documents
stand in the order of a hash of the key. The whole passes that fit into the target take every document, the last pass
those whose middle lies before the words that remain; each source thus misses its target by half a document at most.

A source's weight moves over training time t in [0, 1] from `schedule[i][0]` to `schedule[i][1]`. Its integral is the
source's cumulative demand; inverting it at the share of the source's words already used gives each copy's training
position, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.session import cut

WEIGHTS = (5, 2, 1)
SHARE_NUMERATOR, SHARE_DENOMINATOR, CAP = 3, 2, 2
#: Weight at the start and the end of training, cycling over the sources as the weights do.
SCHEDULE = ((1.0, 3.0), (1.0, 1.0), (3.0, 1.0))


def words(text: Column) -> Column:
    """Number of white-space separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source_key, source_size, target, idx) from rows of (source_key, size): one row per source, water-filled."""
    total = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source_key.none"), F.col("source_key.name"))
    t = total.withColumn("idx", F.row_number().over(named) - 1).withColumn("w", _cycle(weights, F.col("idx")))
    t = t.withColumn("cap", F.col("source_size") * CAP).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = F.sum("source_size").over(everything) * SHARE_NUMERATOR / SHARE_DENOMINATOR
    by = everything.orderBy("ratio", "idx")
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (whole - before) / rest).withColumn("free", F.col("cap") > F.col("w") * F.col("level")).withColumn("rn", F.row_number().over(by))
    t = t.withColumn("fill", F.min_by("level", F.when(F.col("free"), F.col("rn"))).over(everything))
    kept = F.when(F.col("cap") > F.col("w") * F.col("fill"), F.col("w") * F.col("fill")).otherwise(F.col("cap").cast("double"))
    return t.select("source_key", "source_size", kept.alias("target"), "idx")


def _position(share: Column, start: Column, end: Column) -> Column:
    """Time at which a linear weight from start to end has met the share of its whole demand."""
    slope = end - start
    bent = (F.sqrt(start * start + slope * (start + end) * share) - start) / slope
    return F.when(F.abs(slope) < 1e-12, share).otherwise(bent)


def _planned(docs: DataFrame, key: str, text: str, source: str, weights: tuple, schedule: tuple, carry: bool) -> DataFrame:
    """mix(), with all columns of docs as the struct `row` if carry."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None)
    sized = docs.select(
        F.col(key).alias("key"), words(F.col(text)).alias("size"), F.xxhash64(text).alias("tie"),
        F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")).alias("source_key"),
    )
    if carry:
        sums_of, sized = sized, docs.select(own.alias("row")).select("row", *[_within(c, key, text, source) for c in ("key", "size", "tie", "source_key")])
    else:
        sums_of = sized = cut(sized, "sizes")  # the texts are read once; what follows reads some 40 bytes a document
    placed = _hashed(sized)
    sums = _hashed(sums_of).groupBy("source_key", "group", "bucket").agg(F.sum("size").alias("n"))
    sums = cut(sums, "sums")
    goals = targets(sums.select("source_key", F.col("n").alias("size")), weights)
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("source_key", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("source_key", "group", before(["source_key"], "group").alias("outer"))
    sums = sums.select("source_key", "group", "bucket", before(["source_key", "group"], "bucket").alias("inner"))
    sums = sums.join(groups, ["source_key", "group"]).join(goals, "source_key").withColumn("ahead", F.col("outer") + F.col("inner"))
    inner = Window.partitionBy("source_key", "bucket").orderBy("h", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("run", F.sum("size").over(inner)).join(sums.drop("group", "outer", "inner"), ["source_key", "bucket"])
    start = F.col("ahead") + F.col("run") - F.col("size")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("start", start).withColumn("full", full)
    left = F.col("target") - F.col("full") * F.col("source_size")
    copies = (F.col("full") + F.when((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= left), 1).otherwise(0)).cast("int")
    placed = placed.withColumn("copies", copies)
    low, high = (_cycle(tuple(float(s[i]) for s in schedule), F.col("idx")) for i in (0, 1))
    demand = F.greatest(F.col("target"), F.lit(1.0))
    spot = lambda c: _position(F.least(F.lit(1.0), ((c - 1) * F.col("source_size") + F.col("start")) / demand), low, high)
    spots = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))), spot)).otherwise(F.array().cast("array<double>"))
    columns = ["key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), spots.alias("positions")]
    return placed.select(*columns, *(["row"] if carry else []))


def _within(what: str, key: str, text: str, source: str) -> Column:
    """One of the columns of `sized`, from the struct that holds a whole row."""
    of = lambda c: F.col("row").getField(c)
    return {
        "key": of(key), "size": words(of(text)), "tie": F.xxhash64(of(text)),
        "source_key": F.struct(of(source).isNull().alias("none"), F.coalesce(of(source).cast("string"), F.lit("")).alias("name")),
    }[what].alias(what)


def _hashed(sized: DataFrame) -> DataFrame:
    """sized with h, the hash that orders a source's documents, and its leading digits: 256 groups of 256 buckets."""
    d = sized.withColumn("h", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("null")).cast("binary")))
    return d.withColumns({"group": F.substring("h", 1, 2), "bucket": F.substring("h", 1, 4)})


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE) -> DataFrame:
    """A row per document: key, size, source_size, target, copies, taken, positions (one per copy, ascending).

    Running sums within a source go over 256 groups of 256 hash buckets: the sums of the groups, of a group's buckets, then
    within a bucket, so that no task holds a whole source or all its buckets. Rows with equal keys share a bucket and are
    told apart by size and text; equal rows follow each other. A null key is ordered as the text 'null'. Sources of no
    words have target 0; an empty table gives an empty result. Other columns are not read. The targets themselves are
    ordered in one task, a row per source.
    """
    return _planned(docs, key, text, source, weights, schedule, False)


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, schedule: tuple = SCHEDULE) -> DataFrame:
    """The documents of the mix with all their columns, a row per copy, range-sorted by training position.

    Whole rows travel with their plan, so rows that repeat a key, a text or everything get the copies planned for each.
    Rows without words are not taken, nor is anything of an empty table. Columns may have any names.
    """
    spread = _planned(docs, key, text, source, weights, schedule, True).select("row", "key", F.explode("positions").alias("spot"))
    ordered = spread.repartitionByRange(F.col("spot"), F.col("key")).sortWithinPartitions("spot", "key")
    return ordered.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
