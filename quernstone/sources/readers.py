"""Readers of the formats that an index is made from."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from quernstone.functions import fixed
from quernstone.functions import text as T


def may_ingest(path: Column, length: Column, roots: list[str] | None = None) -> Column:
    """Whether a file is of a known kind, small enough and in no skipped folder."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    fine = (length <= fixed.MAX_FILE_BYTES) & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*fixed.EXTENSIONS)
    fine = fine & ~F.arrays_overlap(parts, F.array(*map(F.lit, fixed.SKIP_DIRS))) & ~name.isin(*fixed.SKIP_FILES) & ~name.startswith(".")
    return fine & allowed(path, roots) if roots else fine


def allowed(path: Column, roots: list[str], web: bool = False) -> Column:
    """Whether a path lies under one of the roots; one logical path always passes."""
    fine = path == "research/master_research.md"
    for root in roots:
        fine = fine | path.startswith(root.rstrip("/") + "/") | (path == root)
    return (fine | path.rlike("^https?://")) if web else fine


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(source, length, text, modified) of the files of a folder worth indexing. The
    filter stands before the content is decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    kept = files.where(may_ingest(path, F.col("length")))
    return kept.select(path.alias("source"), "length", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


JSONL = "path string, source string, text string, content string, chunks array<string>"


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(source, chunk_idx, text) of lines {path|source, text|content} or {path, chunks}."""
    rows = spark.read.schema(JSONL).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    one = F.coalesce("text", "content")
    rows = rows.select(F.coalesce("path", "source").alias("source"), F.coalesce("chunks", F.array(one)).alias("parts")).where("source IS NOT NULL AND source <> ''")
    out = rows.select("source", F.posexplode("parts").alias("chunk_idx", "text"))
    return out.where((F.coalesce(T.trimmed("text"), F.lit("")) != "") & (F.octet_length("text") <= fixed.MAX_FILE_BYTES))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a training log; lines that can't be read are passed over."""
    schema = "query string, context string, response string, domain string, ts long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_web_sources(spark: SparkSession, path: str) -> DataFrame:
    """(url, domain) of a list of sources, https alone."""
    rows = spark.read.schema("url string, domain string").option("multiLine", True).json(path)
    return rows.where(F.col("url").startswith("https://"))


def flat_manifest(rows: DataFrame, column: str) -> DataFrame:
    """(domain, url) of a JSON map whose values are a list of URLs or a single one."""
    entries = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("domain", "value"))
    urls = F.when(F.col("value").startswith("["), T.json_list("value")).otherwise(F.array("value"))
    return entries.select("domain", F.explode(urls).alias("url")).where(F.col("url").startswith("https://"))


def read_design_csv(spark: SparkSession, path: str, names: list[str], least: int = 2) -> DataFrame:
    """Token rows of a CSV file: its first line is a head, a line is cut at every comma,
    quotes or not, and one with fewer than ``least`` fields is passed over."""
    lines = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("quote", "\u0000").option("escape", "\u0000").option("nullValue", "\u0001")
    rows = lines.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.where(F.col(names[least - 1]).isNotNull())


def read_skills(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, description, domain, category, tags, body) of skill texts in a folder
    and those directly below it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdc}").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/+", "/")
    below = F.substring(path, len(re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/")) + 2, 2**31 - 1)
    files = files.where(F.size(F.split(below, "/")) <= 2)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.mdc?$", 1)
    meta = T.front_matter(F.col("value"))
    return files.select(name.alias("id"), *[c.alias(n) for n, c in meta.items()], F.col("value").alias("body"))


@F.pandas_udf(MapType(StringType(), StringType()))
def cargo_dependencies(text: pd.Series) -> pd.Series:
    """Name and version of dependencies, those for development and for targets included;
    of a name the first counts, and one without a version is left out."""

    def one(t: str | None) -> dict:
        try:
            doc = tomllib.loads(t or "")
        except tomllib.TOMLDecodeError:
            return {}
        found: dict[str, str] = {}
        for table in [doc, *doc.get("target", {}).values()]:
            for part in ("dependencies", "dev-dependencies"):
                for name, value in table.get(part, {}).items():
                    version = value if isinstance(value, str) else value.get("version", "") if isinstance(value, dict) else ""
                    if version:
                        found.setdefault(name, version)
        return found

    return pd.Series([one(t) for t in text])


def package_summary(text: Column, most: int = 20) -> Column:
    """(name, scripts, dependencies, total) of a package.json."""
    doc = F.from_json(text, "name string, scripts map<string,string>, dependencies map<string,string>")
    deps = F.array_sort(F.coalesce(F.map_keys(doc["dependencies"]), F.array().cast("array<string>")))
    return F.struct(
        doc["name"].alias("name"), F.array_sort(F.coalesce(F.map_keys(doc["scripts"]), F.array().cast("array<string>"))).alias("scripts"),
        F.slice(deps, 1, most).alias("dependencies"), F.size(deps).cast("long").alias("total"),
    )
