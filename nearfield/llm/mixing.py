"""Mixing sources to target weights: capped water-filling and seeded repetition.

Built from DataFrame functions alone. Word counts are taken in one pass over the
texts; all else works on (doc_id, source, size, hash) rows and on one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import WORD, checkpointed

#: The mix's source table is broadcast up to so many rows; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
_BITS, _BUCKET_BITS = 32, 12


def _draw(seed: int) -> Column:
    """32 bits that depend on seed and doc_id only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.shiftright(_draw(seed), _BITS - _BUCKET_BITS).cast("int").alias("bucket"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size) rows.

    Weights repeat over the sources by code point, null last. A source is clamped at
    ``epochs`` times its size; what it can't take goes to the others by weight, until
    none is above. Clamping in rounds ends at one water level: in the order of
    cap / weight, sources are clamped as long as the level that is left for the
    rest lies above their own ratio. Empty sources have target 0.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(epochs))
    every, upward = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(every))
    rows = rows.withColumn("below_cap", F.coalesce(F.sum("cap").over(upward), F.lit(0.0))).withColumn("below_weight", F.coalesce(F.sum("weight").over(upward), F.lit(0.0)))
    level = (F.col("budget") - F.col("below_cap")) / (F.col("all_weight") - F.col("below_weight"))
    rows = rows.withColumn("level", level).withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level"))
    water = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return rows.withColumn("water", water).select("source", "source_size", "weight", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 6) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    The rate of a source is target / source_size. All its documents are taken whole
    as often as the rate's integer part says; for its fraction, documents are drawn
    whole in the order of a seeded hash of doc_id, up to the hash bucket (of 4096)
    whose sum comes nearest to the words that are left. Null text has size 0 and is
    taken 0 words; rows that repeat a doc_id are drawn together; a null source is a
    source of its own. No rows in, none out. Reruns and other partitionings agree.
    """
    sized = checkpointed(_sized(documents, seed))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = checkpointed(targets.withColumn("whole", whole).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")))
    small = targets.count() <= BROADCAST_SOURCES
    keyed = lambda t: (F.broadcast(t) if small else t).withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # buckets without words are no draw: at want 0 they would count, and their documents be taken once too often
    drawn = buckets.withColumn("before", before).join(keyed(targets), on).where((F.col("bucket_size") > 0) & (F.col("before") + F.col("bucket_size") / 2 <= F.col("want")))
    last = drawn.groupBy("source").agg(F.max("bucket").alias("last")).withColumnRenamed("source", "_drawn")
    plan = targets.join(last, F.col("source").eqNullSafe(F.col("_drawn")), "left").select("source", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))
    out = sized.join(keyed(plan), on).withColumn("copies", F.col("whole") + (F.col("bucket") <= F.col("last")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB form of the mix with its default parameters; {documents} names the table.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('6:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3)) AS INTEGER) AS bucket
  FROM {documents}
), buckets AS (
  SELECT source, bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM sized GROUP BY ALL
), sizes AS (
  SELECT source, CAST(sum(bucket_size) AS BIGINT) AS source_size FROM buckets GROUP BY ALL
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM sizes
), below AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER up, 0) AS below_cap, coalesce(sum(weight) OVER up, 0) AS below_weight
  FROM weighed
  WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (budget - below_cap) / (all_weight - below_weight) AS level FROM below
), water AS (
  SELECT level FROM levels WHERE NOT cap <= weight * level ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * (SELECT level FROM water) END AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), cumulated AS (
  SELECT source, bucket, bucket_size,
         coalesce(sum(bucket_size) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM buckets
), last AS (
  SELECT c.source, max(c.bucket) AS last
  FROM cumulated c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.bucket_size > 0 AND c.before + c.bucket_size / 2.0::DOUBLE <= p.target - p.whole * p.source_size
  GROUP BY c.source
)
SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
       p.whole + CAST(s.bucket <= coalesce(l.last, -1) AS BIGINT) AS copies,
       (p.whole + CAST(s.bucket <= coalesce(l.last, -1) AS BIGINT)) * s.size AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN last l ON l.source IS NOT DISTINCT FROM p.source
"""
