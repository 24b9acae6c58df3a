"""Curation of training rows and upkeep of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.storage import Scratch


def keep_one(df: DataFrame, keys: list, order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by an explicit order."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*([c.desc() for c in by] if last else by))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def training_rows(rows: DataFrame, position: str, strip_low_value: bool = True) -> DataFrame:
    """Trimmed rows (query, context, response), those without a response or without both
    query and context dropped, first of equal (query, context) kept, then redacted."""
    bare = rows.withColumns({c: T.trimmed(F.coalesce(F.col(c), F.lit(""))) for c in ("query", "context", "response")})
    bare = bare.where("response <> '' AND (query <> '' OR context <> '')")
    if strip_low_value:
        bare = bare.where(~(T.low_value_query("query") | T.low_value_response("response")))
    one = keep_one(bare, ["query", "context"], [position])
    return one.withColumns({c: T.redacted(c) for c in ("query", "context", "response")})


def alpaca_merge(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts that have the three instruction keys, and those keys alone."""
    names = ["instruction", "input", "output"]
    merged = None
    for part in parts:
        if not set(names) <= set(part.columns):
            continue
        rows = part.select(*names).where(" AND ".join(f"{n} IS NOT NULL" for n in names))
        merged = rows if merged is None else merged.unionByName(rows)
    return merged


def first_rows(rows: DataFrame, order: list[tuple[Column, bool]], n: int) -> DataFrame:
    """The first ``n`` rows by (column, whether descending), nulls first or, descending,
    last; of rows that are equal at the bound any.

    The keys alone are dealt by ranges and counted, which gives the key of the n-th row;
    rows are then read with that bound, so none of them is moved or sorted."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "first")
    names = [f"_o{k}" for k in range(len(order))]
    by = [F.col(c).desc() if down else F.col(c).asc() for c, (_, down) in zip(names, order, strict=True)]
    keys = rows.select(*(c.alias(name) for name, (c, _) in zip(names, order, strict=True)))
    dealt = scratch.save(keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_range", F.spark_partition_id()), "keys")
    before, at = 0, None
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():  # a row a range
        if before + r["count"] >= n:
            at = r["_range"]
            break
        before += r["count"]
    if at is None:
        return rows
    if n <= 0:
        return rows.limit(0)
    here = dealt.where(F.col("_range") == at).withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*by)))
    bound = here.where(F.col("_n") == n - before).select(*names).first()

    def compared(columns: list[Column]) -> tuple[Column, Column]:
        """Whether a row stands before the bound, and whether it has the same keys."""
        ahead, same = F.lit(False), F.lit(True)
        for c, (_, down), value in zip(columns, order, bound, strict=True):
            limit = F.lit(value)
            if value is None:
                less = c.isNotNull() if down else F.lit(False)
            else:
                less = F.coalesce(c > limit, F.lit(False)) if down else F.coalesce(c < limit, F.lit(True))
            ahead, same = ahead | (same & less), same & c.eqNullSafe(limit)
        return ahead, same

    ahead, same = compared([F.col(c) for c in names])
    sums = here.agg(F.sum(ahead.cast("int")).alias("a"), F.sum(same.cast("int")).alias("s")).first()
    ahead, same = compared([c for c, _ in order])
    missing = n - before - sums["a"]
    if missing == sums["s"]:
        return rows.where(ahead | same)
    return rows.where(ahead).unionByName(rows.where(same).limit(missing))


def keep_last_rows(rows: DataFrame, position: str, n: int) -> DataFrame:
    return first_rows(rows, [(F.col(position), True)], n)


def sample_rows(rows: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows without replacement, the same at every run: those of the smallest hash."""
    return first_rows(rows, [(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), False), (F.col(key), False)], n)


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, change) between two manifests (source, content_hash)."""
    both = old.select("source", F.col("content_hash").alias("_o")).join(new.select("source", F.col("content_hash").alias("_n")), "source", "full_outer")
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "changed").otherwise("unchanged")
    return both.select("source", change.alias("change"))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of the same keys replaced and the others appended."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def without_orphans(rows: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    return rows.join(owners.select(F.col(owner_key).alias(key)).distinct(), key, "left_semi")


def orphans(rows: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    return rows.join(owners.select(F.col(owner_key).alias(key)).distinct(), key, "left_anti")


def outdated_web(rows: DataFrame, now: Column, days: int, source: str = "source", updated: str = "last_updated") -> DataFrame:
    """Rows from the web that were last updated over ``days`` ago (Unix seconds)."""
    cutoff = F.greatest(F.lit(0).cast("long"), now - days * 86_400)
    return rows.where(F.col(source).startswith("https://") & (F.col(updated) < cutoff))


def pruned_cache(cache: DataFrame, most: int, oldest: Column, created: str = "created_at", key: str = "id") -> DataFrame:
    """The newest ``most`` rows among those not older than ``oldest``."""
    return first_rows(cache.where(F.col(created) >= oldest), [(F.col(created), True), (F.col(key), True)], most)


def secret_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, snippet): lines that hold a secret, with its value hidden. Most texts
    hold none, which one pattern over the whole text tells before it is split."""
    lines = docs.where(T.may_hold_secret(text_col)).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    return lines.where(T.holds_secret("line")).select("id", (F.col("at") + 1).cast("long").alias("line_no"), T.masked("line").alias("snippet"))
