"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate is derived for each source, and every
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction of the rate.

A document's copies follow from its id, its text's digest, its place among the rows of its
source that have both in common (0 for most) and its source's rate, so they are computed
where the document is read: the table of rates goes to all executors up to a number of
sources, and is joined by salted keys beyond it.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; an empty table gives an empty result; rows without an id and rows that repeat an id
each make a draw of their own, also where their texts are equal; columns besides id, text
and source are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import WORD, Scratch, free_names, numbered, partitions, placed_among_equals

#: Up to so many sources their table is sent to all executors (about 100 bytes a row).
BROADCAST_SOURCES = 20_000
#: Beyond that, a source's rows are dealt over so many salted keys.
SALTS = 32


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    seed: str = "mix-1"


def targets(scratch: Scratch, sizes: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    Weighted shares of ``mix.share`` times all sizes; a target stops at ``mix.cap``
    times its source's size and the excess goes to the others by weight. With sources
    ordered by stop per weight, those before some place stop and the others share what is
    left: that place is the first whose level, (all - stops before it) / (weights from it
    on), its source can take. Sums before a place come from ranges of the order, summed
    apart.
    """
    spark = scratch.spark
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(scratch, per, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("index") % len(mix.weights) + 1).cast("int"))
    table = placed.withColumn("weight", weight).withColumn("stop", F.col("source_size") * mix.cap)
    order = [F.col("stop") / F.col("weight"), F.col("index")]
    table = scratch.save(table.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "weighed")
    n, total, weights = table.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy("range").agg(F.sum("stop").alias("stops"), F.sum("weight").alias("weights"))
    # one row per range: its size is bounded by the number of shuffle partitions
    sums = sums.select("range", *(F.coalesce(F.sum(c).over(ahead), F.lit(0.0)).alias(c) for c in ("stops", "weights")))
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used, gone = (F.col(c) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) for c, x in (("stops", "stop"), ("weights", "weight")))
    ranked = table.join(F.broadcast(sums), "range").withColumn("level", (total * mix.share - used) / (weights - gone))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    level = ranked.agg(F.min_by(fits, F.when(fits.isNotNull(), F.struct(*order)))).first()[0]
    share = F.col("stop") if level is None else F.least("stop", F.col("weight") * F.lit(level))
    return table.select("source", "source_size", share.alias("target")), n


def rated(docs: DataFrame, goal: DataFrame, n: int, mix: Mix, by: tuple[str, str, str], source_col: str, size: str, target: str, copies: str) -> DataFrame:
    """``docs`` with source size, target and copies in columns of the given names. ``by``
    names a row's id, the digest of its text and its place among equal rows: a draw is
    taken from the three, so no two rows have one draw in common."""
    key, salt, row_salt = free_names([*docs.columns, size, target, copies], "_source", "_salt", "_rowsalt")
    goal = goal.select(F.col("source").alias(key), F.col("source_size").alias(size), F.col("target").alias(target))
    same = F.col(source_col).eqNullSafe(F.col(key))
    if n <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(goal), same)
    else:
        salted = docs.withColumn(row_salt, F.pmod(F.hash(*by), F.lit(SALTS)))
        spread = goal.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, same & (F.col(row_salt) == F.col(salt)))
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(0.0)
    drawn = F.concat_ws(":", F.lit(mix.seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    draw = F.conv(F.substring(F.md5(drawn.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    times = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn(copies, times).select(*docs.columns, size, target, copies)


def _digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _sizes(docs: DataFrame, text_col: str, source_col: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(source_col).alias("source"), size.alias("size"), *more)


def plan_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): what the mix takes of each row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.save(_sizes(docs, text_col, source_col, F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest")), "sizes")
    goal, n = targets(scratch, sizes, mix)
    placed = placed_among_equals(scratch, sizes, ["source", "doc_id", "digest"], "place", "repeats")
    return rated(placed, goal, n, mix, ("doc_id", "digest", "place"), "source", "source_size", "target", "copies").drop("digest", "place")


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    goal, n = targets(scratch, _sizes(docs, text_col, source_col), mix)
    size, target, copies, copy, digest, place = free_names(docs.columns, "_size", "_target", "_copies", "_copy", "_digest", "_place")
    placed = placed_among_equals(scratch, docs.withColumn(digest, _digest(text_col)), [source_col, id_col, digest], place, "repeats")
    taken = rated(placed, goal, n, mix, (id_col, digest, place), source_col, size, target, copies).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS stop
  FROM s
), p AS (
  SELECT *, row_number() OVER o AS k,
         coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM w WINDOW o AS (ORDER BY stop / weight, source NULLS LAST)
), l AS (
  SELECT coalesce(min_by(((budget - used) / free)::DOUBLE, k) FILTER (WHERE (budget - used) / free * weight <= stop), 1e300) AS level FROM p
), t AS (
  SELECT source, source_size, least(stop, weight * level)::DOUBLE AS target FROM w, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.digest || ':' || d.place::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
