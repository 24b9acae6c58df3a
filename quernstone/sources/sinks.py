"""Sinks: tables by source, logs, manifests and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.curation import upserted

#: A log file holds about so many bytes.
LOG_BYTES = 100 * 1024 * 1024


def replace_sources(table: DataFrame, rows: DataFrame, path: str, source: str = "source") -> None:
    """Writes ``table`` to ``path`` with all rows of the sources in ``rows`` replaced."""
    upserted(table, rows, [source]).write.mode("overwrite").parquet(path)


def upserted_chunks(chunks: DataFrame, vectors: DataFrame, rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Chunks and vectors (key, embedding) after single rows were inserted or replaced; a
    row without an embedding takes its vector out."""
    fields = [c for c in rows.columns if c != "embedding"]
    ids = rows.select(key).distinct()
    kept = vectors.join(ids, key, "left_anti")
    return upserted(chunks, rows.select(*fields), [key]), kept.unionByName(rows.where("embedding IS NOT NULL").select(key, "embedding"))


def append_log(rows: DataFrame, path: str, most_bytes: int = LOG_BYTES) -> None:
    """Appends JSON lines in files of about ``most_bytes`` each: as many files as the lines
    fill, rows dealt evenly."""
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    lines.repartition(max(1, math.ceil(size / most_bytes))).write.mode("append").text(path)


def save_manifest(rows: DataFrame, path: str, config_hash: str) -> None:
    rows.select("source", F.lit(config_hash).alias("config_hash"), "content_hash").write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str, config_hash: str) -> DataFrame:
    """The manifest, empty if it was made under another configuration."""
    return spark.read.parquet(path).where(F.col("config_hash") == config_hash)


def write_report(rows: DataFrame, path: str, order: str, line: Column | str, head: str = "") -> None:
    """One text file with an entry for each row, in order, under a head. A report is for
    people, so its rows are few; they are sorted in the task that writes the file."""
    entry = F.col(line) if isinstance(line, str) else line
    body = rows.select(F.col(order).alias("_order"), entry.alias("value")).coalesce(1).sortWithinPartitions("_order").select("value")
    if head:
        body = rows.sparkSession.range(1, numPartitions=1).select(F.lit(head).alias("value")).unionByName(body).coalesce(1)
    body.write.mode("overwrite").text(path)


def lesson(day, title, category, text) -> Column:
    kind = F.when(category == "", "general").otherwise(category)
    return F.concat(F.lit("\n## "), day, F.lit(": "), F.replace(title, F.lit("\n"), F.lit(" ")), F.lit("\n\n**Category:** "), kind, F.lit("\n\n"), text, F.lit("\n"))


def rule(time, text) -> Column:
    return F.concat(F.lit("\n\n## Rule ("), time, F.lit(")\n\n"), text)


def golden_pattern(name, time, language, code) -> Column:
    return F.concat(F.lit("\n\n## PATTERN: "), name, F.lit(" ("), time, F.lit(")\n```"), F.coalesce(language, F.lit("text")), F.lit("\n"), code, F.lit("\n```"))


def audit_section(title, body, most: int = 400) -> Column:
    """The first five lines of a lesson, and of these the first 400 characters."""
    head = F.array_join(F.slice(F.split(body, "\n"), 1, 5), "\n")
    short = F.when(F.octet_length(head) > most, F.concat(F.left(head, F.lit(most)), F.lit("..."))).otherwise(head)
    return F.concat(F.lit("## "), title, F.lit("\n\n```\n"), short, F.lit("\n```\n\nStatus: [ ] Valid  [ ] Anti-Pattern\n\n---\n"))


def skill_row(purpose, path, query, domain) -> Column:
    return F.concat(F.lit("| "), F.replace(F.left(purpose, F.lit(80)), F.lit("|"), F.lit("/")), F.lit(" | "), path, F.lit(" | "), query, F.lit(" | "), F.coalesce(domain, F.lit("")), F.lit(" |"))


def constitution_part(title, content) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n\n"), content, F.lit("\n---\n"))
