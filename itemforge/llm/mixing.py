"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Every source gets a word target (``source_targets``); a document's expected copies are target / size of its source.
The expected copies are prefix-summed within the source in the order (size, hash bucket, id), one offset per source
is added, and a document is emitted once per integer boundary that its interval crosses. Ordering by size makes the
taken words miss the target by about the largest document at most.

Scale: the position of a document in its source is the sum of two small running counts (over distinct sizes, over
hash buckets of a size) and its rank inside one (source, size, bucket), so a source with a third of all rows is
numbered by many tasks. Joins are on those three keys together, never on the source alone.

Cases: null text or one of white space only has size 0 and takes 0 words; a null source is a source of its own, ordered
last; a source of size 0 has target 0; repeated rows each count; documents with equal keys are interchangeable; a null
id sorts first; an empty table gives no rows. Extra columns ride along in one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.shared import table

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex_value(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """``sizes`` (no_source, source_key, source_size): adds ``target``, shares of the total by weight, none above cap times its size.

    Sources in the order of size per weight; the first level that fits below the rest's caps is the common level, and
    all before it stop at their cap. One row per source is sorted here, nothing larger.
    """
    by_name = Window.orderBy("no_source", "source_key")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", choice).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    weighed = weighed.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "no_source", "source_key")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))
    settled = ranked.withColumn("common", F.min(fits).over(every))
    target = F.when(F.col("place") < F.col("common.place"), F.col("most")).otherwise(F.least("most", F.col("common.level") * F.col("weight")))
    return settled.select("no_source", "source_key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def systematic_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, seed: str = "mix") -> DataFrame:
    """One row per document: ``row`` (all its columns), size, source_size, target, copies."""
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), word_count(docs["text"]).alias("size"),
        docs["source"].isNull().alias("no_source"), F.coalesce(docs["source"], F.lit("")).alias("source_key"),
        F.coalesce(F.substring(F.md5(docs["doc_id"].cast("string")), 1, 2), F.lit("")).alias("bucket"))
    source, sized, cell = ["no_source", "source_key"], ["no_source", "source_key", "size"], ["no_source", "source_key", "size", "bucket"]
    cells = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy(*sized).agg(F.sum("n").alias("n_size"))
    earlier = Window.partitionBy(*source).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.withColumn("size_start", F.coalesce(F.sum("n_size").over(earlier), F.lit(0)))
    sources = source_targets(by_size.groupBy(*source).agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size")), weights, cap)
    earlier = Window.partitionBy(*sized).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = (cells.withColumn("cell_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .join(starts.join(sources, source), sized)
              .select(*cell, (F.col("size_start") + F.col("cell_start")).alias("start"), "source_size", "target"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex_value(F.concat(F.lit(seed), F.col("no_source").cast("string"), F.col("source_key")), 8) / F.lit(float(1 << 32))
    at = F.col("start") + F.col("rank")
    copies = F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)
    return ranked.join(placed, cell).select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document's own columns, repeated as often as it was drawn."""
    drawn = systematic_mix(docs, **options).filter(F.col("copies") > 0)
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return systematic_mix(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS ratio, row_number() OVER o AS place,
        ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, no_source, source_key)),
c AS (SELECT min(place) AS place, min_by(level, place) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.no_source, l.source_key, l.source_size, CASE WHEN l.place < c.place THEN l.most ELSE least(l.most, c.level * l.weight) END AS target FROM l, c),
k AS (SELECT d.*, row_number() OVER (PARTITION BY no_source, source_key ORDER BY size, coalesce(substr(md5(doc_id::VARCHAR), 1, 2), ''), doc_id NULLS FIRST) AS place FROM d),
r AS (SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix' || k.no_source::VARCHAR || k.source_key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
      FROM k JOIN t ON k.no_source = t.no_source AND k.source_key = t.source_key)
SELECT doc_id, size, source_size, target, (floor(place * rate + shift) - floor((place - 1) * rate + shift))::BIGINT * size AS taken FROM r
"""
