"""Operational analytics: histograms, percentiles, rates and run detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.storage import Scratch


def bucket_of(value: Column, bounds=fixed.HISTOGRAM_BOUNDS) -> Column:
    """Upper bound of the bucket, or null beyond the last."""
    rule = None
    for bound in bounds:
        rule = (F if rule is None else rule).when(value <= bound, F.lit(bound))
    return rule.otherwise(F.lit(None).cast("int"))


def histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bound, n, total) of whole milliseconds."""
    ms = F.floor(F.col(value)).cast("long")
    return rows.groupBy(*keys, bucket_of(ms).cast("long").alias("bound")).agg(F.count("*").alias("n"), F.sum(ms).alias("total"))


def bucket_percentile(hist: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(keys, n, average, percentile): the first bucket whose running count reaches the
    share; in the overflow bucket, the whole mean."""
    w = Window.partitionBy(*keys)
    running = w.orderBy(F.col("bound").asc_nulls_last())
    counted = hist.withColumn("_all", F.sum("n").over(w)).withColumn("_sum", F.sum("total").over(w)).withColumn("_seen", F.sum("n").over(running))
    reach = counted.where(F.col("_seen") >= F.ceil(F.col("_all") * percent / 100))
    mean = F.floor(F.col("_sum") / F.col("_all")).cast("long")
    first = reach.withColumn("_r", F.row_number().over(w.orderBy("_seen"))).where("_r = 1")
    return first.select(*keys, F.col("_all").alias("n"), mean.alias("average"), F.coalesce("bound", mean).alias("percentile"))


def placed_in_group(rows: DataFrame, keys: list[str], order: list[str], place: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in its group. A group may hold most of all rows:
    ranges of groups and order are dealt by sampled bounds and numbered apart, and only
    their counts are summed, one row for each range and each group in it."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "places")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.withColumn("_at", within).join(bases, same).withColumn(place, F.col("_base") + F.col("_at")).select(*rows.columns, place)


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The value at floor(n * share), counted from 0, in ascending order."""
    placed = placed_in_group(rows.select(*keys, value), keys, [value], "_place")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    same = F.col("_place") - 1 == at
    for k in keys:
        same = same & placed[k].eqNullSafe(sizes[k])
    return placed.join(sizes, same).select(*[placed[k] for k in keys], "n", F.col(value).alias("percentile"))


def rate(part: Column, whole: Column) -> Column:
    """Percent, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def runs(rows: DataFrame, key: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adds ``run`` (number of the run of rows alike in ``same``) and ``at`` (from 1)."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = rows.withColumn("_new", F.when(change | (F.row_number().over(w) == 1), 1).otherwise(0)).withColumn("run", F.sum("_new").over(w))
    inner = Window.partitionBy(*key, "run").orderBy(*order)
    return numbered.withColumn("at", F.row_number().over(inner).cast("long")).drop("_new")


def loop_guard(calls: DataFrame, key: list[str], order: list[str], same: list[str], n: int = 5) -> DataFrame:
    """Adds ``blocked``: every n-th call alike in a row, n within 2 and 20."""
    return runs(calls, key, order, same).withColumn("blocked", F.col("at") % min(20, max(2, n)) == 0)


def call_limit(calls: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return calls.withColumn("over_limit", F.row_number().over(w) > most)


def convergence(scores: DataFrame, key: list[str], order: list[str], score: str, epsilon: float = 1e-6, converged: float = 0.95, patience: int = 3, most: int = 20) -> DataFrame:
    """Adds best, stagnation and status: of each score, whether it beats the best before
    it, how many in a row haven't, and what that makes of the loop."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(F.col(score) > F.coalesce(before, F.lit(0.0)) + epsilon, 1).otherwise(0)
    marked = scores.withColumn("best", F.greatest(F.max(score).over(w), F.lit(0.0))).withColumn("_better", better).withColumn("iteration", F.row_number().over(w).cast("long"))
    marked = marked.withColumn("_island", F.sum("_better").over(w))
    island = Window.partitionBy(*key, "_island").orderBy(*order)
    still = marked.withColumn("stagnation", (F.row_number().over(island) - F.when(F.col("_island") > 0, 1).otherwise(0)).cast("long"))
    status = F.when(F.col("best") >= converged, "converged").when(F.col("stagnation") >= patience, "stagnated").when(F.col("iteration") >= most, "halted").otherwise("running")
    return still.withColumn("status", status).drop("_better", "_island")


def dead_ends(calls: DataFrame, key: list[str], order: list[str], tool: str, args: str, failed: str, least: int = 2) -> DataFrame:
    """Adds ``failures`` (of the same tool and arguments since the tool last succeeded)
    and ``dead_end``."""
    by_tool = Window.partitionBy(*key, tool).orderBy(*order)
    cleared = calls.withColumn("_cleared", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(by_tool))
    w = Window.partitionBy(*key, tool, "_cleared", args).orderBy(*order)
    counted = cleared.withColumn("failures", F.sum(F.when(F.col(failed), 1).otherwise(0)).over(w))
    return counted.withColumn("dead_end", F.col(failed) & (F.col("failures") >= least)).drop("_cleared")


def last_turns(rows: DataFrame, key: list[str], order: str, n: int = 3, chars: int = 200) -> DataFrame:
    """(key, prefix): the last n texts of each key, cut and in their order."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    last = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    parts = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, F.left("text", F.lit(chars)).alias("x")))).alias("p"))
    return parts.select(*key, F.array_join(F.transform("p", lambda s: s["x"]), "\n").alias("prefix"))
