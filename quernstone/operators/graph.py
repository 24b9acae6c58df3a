"""Module graphs: edges, reachability and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.storage import Scratch


def module_of(path):
    """Module path of a Rust file below ``src``: ``a/b.rs`` and ``a/b/mod.rs`` are a::b."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(?:.*/)?src/", ""), r"(/mod)?\.rs$", "")
    return F.replace(inner, F.lit("/"), F.lit("::"))


def module_edges(files: DataFrame) -> DataFrame:
    """(parent, child, kind) of files (source, text): ``mod x;`` and ``use crate::a::b``."""
    named = files.select(module_of(F.col("source")).alias("parent"), "text")
    code = F.regexp_replace("text", r"//[^\n]*", "")
    mods = named.select("parent", F.explode(F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"), F.lit(1))).alias("name"))
    top = F.col("parent").isin("lib", "main")
    mods = mods.select("parent", F.when(top, F.col("name")).otherwise(F.concat("parent", F.lit("::"), "name")).alias("child"), F.lit("mod").alias("kind"))
    uses = named.select("parent", F.explode(F.regexp_extract_all(code, F.lit(r"\buse\s+crate::(\w+(?:::\w+)?)"), F.lit(1))).alias("child"), F.lit("use").alias("kind"))
    return mods.unionByName(uses).distinct()


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) that can be reached from ``roots`` over edges (parent, child), at any depth.
    The frontier is joined once a step; each step is written, which cuts its lineage. A
    step reaches at least one more node, so cycles end it."""
    scratch = Scratch(nodes.sparkSession, "reach")
    edges = scratch.save(edges.select("parent", "child").distinct(), "edges")
    seen = scratch.save(roots.select("node").distinct(), "seen-0")
    front, step = seen, 0
    while not front.isEmpty():
        step += 1
        ahead = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = scratch.save(ahead.join(seen, "node", "left_anti"), f"front-{step}")
        seen = scratch.save(seen.unionByName(front), f"seen-{step}")
        scratch.drop(f"seen-{step - 1}", f"front-{step - 1}")
    return seen.join(nodes, "node", "left_semi")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(reachable(nodes, edges, roots), "node", "left_anti")


def mermaid(edges: DataFrame) -> DataFrame:
    """One text: a drawing of the edges, in order."""
    line = F.concat(F.lit("  "), T.graph_id("parent"), F.when(F.col("kind") == "mod", " --> ").otherwise(" -.-> "), T.graph_id("child"))
    lines = edges.agg(F.array_sort(F.collect_set(line)).alias("lines"))
    return lines.select(F.concat(F.lit("graph TD\n"), F.array_join("lines", "\n")).alias("graph"))
