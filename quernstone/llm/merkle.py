"""Merkle manifest of a dataset: a digest for every row, every group and the whole.

Every row is a leaf. The leaves of a group stand in the order of their ids; of the nodes
of a level every ``arity`` consecutive ones become the digest of their digests (the last
ones may be fewer, even one), while there is more than one. What remains is the group's
subroot, and the subroots, ordered by group, become the root in the same way.

Aligned blocks of ``arity ** levels`` nodes are traversed in postorder: a recursive call
returns the digest of its subtree, and while the calls unwind, the siblings of each
subtree are appended to the leaves it contains. The blocks' roots are the nodes of the
next traversal, until one node of each group is left. A leaf's whole path is then its
path in its block followed by that of the block; no task holds more than a block.

Defined cases: a null in a column is written as ``-``; a null id stands before all others,
a null group before all groups; rows with one id are ordered by their digests, and equal
rows, being the same leaf, in any order; a text of any length is one leaf; an empty table
has no leaves and no root; columns that aren't asked for play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, crc_of_id, partitions

#: Columns of ``documents`` in the order in which they are digested.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


@dataclass(frozen=True)
class Tree:
    arity: int = 3
    #: levels that one traversal of a block climbs
    levels: int = 6

    @property
    def block(self) -> int:
        return self.arity**self.levels


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: each value as its length in UTF-8 bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    shown = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*shown).cast("binary"), 256)


def climb(leaves: list[str], height: int, arity: int) -> tuple[str, list[list[dict]]]:
    """The digest of the subtree over ``leaves``, ``height`` levels up, and each leaf's
    path: the siblings left and right of it on every level, from the lowest."""
    paths: list[list[dict]] = [[] for _ in leaves]

    def visit(start: int, height: int) -> str:
        if not height:
            return leaves[start]
        width = arity ** (height - 1)
        starts = range(start, min(start + arity * width, len(leaves)), width)
        digests = [visit(at, height - 1) for at in starts]
        for k, at in enumerate(starts):
            step = {"left": "".join(digests[:k]), "right": "".join(digests[k + 1 :])}
            for path in paths[at : at + width]:
                path.append(step)
        return hashlib.sha256("".join(digests).encode()).hexdigest()

    return visit(0, height), paths


def height_of(n: int, arity: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height, reach = 0, 1
    while reach < n:
        height, reach = height + 1, reach * arity
    return height


def _in_order(scratch: Scratch, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (grp, ...) with ``index``, a node's place in its group by ``order``.

    Nodes are dealt by ranges of the whole order, a running number parting equal ones, and
    numbered in their range; a group that goes on in later ranges adds what earlier ones
    hold of it. That is one number a range at most, for the range's first group."""
    spark = scratch.spark
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "_turn")]
    dealt = nodes.withColumn("_turn", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop("_turn").withColumn("_range", F.spark_partition_id())
    at_type = dealt.schema.simpleString()[len("struct<") : -1]

    def number(batches):
        last, at = None, 0
        for batch in batches:
            places = []
            for group in batch.column("grp").to_pylist():
                at = at + 1 if (group,) == last else 0
                last = (group,)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_at"])

    dealt = scratch.save(dealt.mapInArrow(number, f"{at_type},_at:bigint"), name)
    counts = dealt.groupBy("grp", "_range").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("grp").alias("_grp"), F.col("_range").alias("_in"), earlier.alias("_base")).where("_base > 0")
    # one row a range at most: its size is bounded by the number of shuffle partitions
    same = (F.col("_range") == F.col("_in")) & F.col("grp").eqNullSafe(F.col("_grp"))
    joined = dealt.join(F.broadcast(bases), same, "left")
    return joined.withColumn("index", F.col("_at") + F.coalesce("_base", F.lit(0))).drop("_range", "_in", "_at", "_grp", "_base")


def _traversed(nodes: DataFrame, tree: Tree) -> DataFrame:
    """``nodes`` (grp, index, digest, ...) with ``block``, ``path`` and, at the block's
    first node, the block's ``top``."""
    nodes = nodes.withColumn("block", F.floor(F.col("index") / tree.block).cast("long"))
    schema = nodes.schema.simpleString()[len("struct<") : -1]

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        leaves = table.column("digest").to_pylist()
        # blocks behind the first are never alone in their group, so they climb all levels
        height = height_of(len(leaves), tree.arity) if table.column("index")[0].as_py() == 0 else tree.levels
        top, paths = climb(leaves, height, tree.arity)
        table = table.append_column("path", pa.array(paths, _PATH))
        return table.append_column("top", pa.array([top] + [None] * (len(leaves) - 1), pa.string()))

    return nodes.groupBy("grp", "block").applyInArrow(block, f"{schema},path:{PATH},top:string")


def _levels(scratch: Scratch, nodes: DataFrame, tree: Tree, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Traversals from ``nodes`` up to one node a group, and these last ones (grp, digest)."""
    done = []
    while True:
        done.append(scratch.save(_traversed(nodes, tree), f"{name}-{len(done)}"))
        nodes = done[-1].where("top IS NOT NULL").select("grp", F.col("block").alias("index"), F.col("top").alias("digest"))
        if nodes.where("index > 0").isEmpty():
            return done, nodes.select("grp", "digest")


def _path_to_top(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The rows of the first level with the whole path; ``above`` (grp, path, ...) goes on
    behind the last level, and its other columns are added."""
    current = above.withColumn("index", F.lit(0).cast("long")) if above is not None else None
    for level in reversed(levels):
        if current is None:
            current = level.drop("block", "top")
            continue
        more = [c for c in current.columns if c not in ("grp", "index", "path", "digest")]
        upper = current.select(F.col("grp").alias("_grp"), F.col("index").alias("_index"), F.col("path").alias("_path"), *more)
        joined = level.join(upper, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_index")))
        current = joined.withColumn("path", F.concat("path", "_path")).drop("_grp", "_index", "_path", "block", "top")
    return current


def manifest(rows: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``rows`` (grp, id, digest, ...) with subroot, root and path.

    ``path`` holds, for each level from the leaf to the root, the siblings left and right
    of the node on the way, as digests one after another."""
    scratch = Scratch(rows.sparkSession, "merkle")
    leaves = scratch.save(rows, "leaves")
    levels, subroots = _levels(scratch, _in_order(scratch, leaves, ["id", "digest"], "placed"), tree, "level")
    # the groups' own tree: all in one group, by the same traversals
    named = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest")
    upper, tops = _levels(scratch, _in_order(scratch, named, ["name"], "groups"), tree, "upper")
    root = tops.first()
    whole = _path_to_top(upper, None).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "path")
    whole = scratch.save(whole.withColumn("root", F.lit(root["digest"] if root else None).cast("string")), "whole")
    return _path_to_top(levels, whole)


def proof_text(path: Column) -> Column:
    """All siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda below, p: F.sha2(F.concat(p["left"], below, p["right"]).cast("binary"), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stripped = F.when(F.coalesce(crc_of_id("doc_id") % 2 == 0, F.lit(False)), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaf = leaf_of(*(F.col(c) for c in COLUMNS))
    tampered = leaf_of(*(F.col(c) for c in COLUMNS[:-1]), stripped)
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), leaf.alias("digest"), tampered.alias("found"))
    made = manifest(rows)
    made = made.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("found"), F.col("path")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


_SHOWN = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_SHOWN.format(c) for c in COLUMNS)
_FOUND = " || ".join(_SHOWN.format(c if c != "text" else "stripped") for c in COLUMNS)

#: DuckDB has no crc32, so bits are taken from the polynomial's table, built by a rule.
OP11_SQL = f"""
WITH RECURSIVE entry(byte, k, c) AS (
  SELECT byte::BIGINT, 0, byte::BIGINT FROM range(256) t(byte)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM entry WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY byte) AS cells FROM entry WHERE k = 8
), crc(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, rest[2:], xor(cells[(xor(c, ord(rest[1])) & 255) + 1], c >> 8) FROM crc, crcs WHERE rest <> ''
), tampered AS (
  SELECT doc_id FROM crc WHERE rest = '' AND xor(c, 4294967295) % 2 = 0
), d AS (
  SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN replace(text, chr(10), '') ELSE text END AS stripped FROM documents
), f AS (
  SELECT doc_id, source, sha256({_LEAF}) AS leaf, sha256({_FOUND}) AS found FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM f
), up(source, step, place, h, n) AS (
  SELECT source, 0, place, leaf, n FROM leaves
  UNION ALL
  SELECT source, step + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, step, place // 3, n
), subs AS (
  SELECT source, h AS subroot, step AS steps, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), top(step, place, h, n) AS (
  SELECT 0, place, subroot, n FROM subs
  UNION ALL
  SELECT step + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY step, place // 3, n
), runs AS (
  SELECT source, step, place // 3 AS run, list(h ORDER BY place) AS hs FROM up WHERE n > 1 GROUP BY ALL
), topruns AS (
  SELECT step, place // 3 AS run, list(h ORDER BY place) AS hs FROM top WHERE n > 1 GROUP BY ALL
), walk(start, source, step, place, found, proof, over) AS (
  SELECT place, source, 0, place, found, '', false FROM leaves
  UNION ALL
  SELECT w.start, w.source, CASE WHEN over THEN w.step + 1 WHEN w.step = s.steps THEN 0 ELSE w.step + 1 END,
         CASE WHEN over THEN w.place // 3 WHEN w.step = s.steps THEN s.place ELSE w.place // 3 END,
         CASE WHEN NOT over AND w.step = s.steps THEN found
              ELSE sha256(array_to_string(list_transform(hs, lambda h, i: CASE WHEN i = w.place % 3 + 1 THEN found ELSE h END), '')) END,
         CASE WHEN NOT over AND w.step = s.steps THEN proof
              ELSE proof || array_to_string(list_transform(hs, lambda h, i: CASE WHEN i = w.place % 3 + 1 THEN '' ELSE h END), '') END,
         over OR w.step = s.steps
  FROM (
    SELECT walk.*, coalesce(r.hs, t.hs) AS hs FROM walk
    LEFT JOIN runs r ON NOT over AND r.source IS NOT DISTINCT FROM walk.source AND r.step = walk.step AND r.run = walk.place // 3
    LEFT JOIN topruns t ON over AND t.step = walk.step AND t.run = walk.place // 3
  ) w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source
  WHERE NOT over OR w.hs IS NOT NULL
), ends AS (
  SELECT source, start, found AS folded_root, proof FROM walk WHERE over QUALIFY row_number() OVER (PARTITION BY source, start ORDER BY step DESC) = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN ends ON ends.source IS NOT DISTINCT FROM leaves.source AND ends.start = leaves.place
     JOIN subs ON subs.source IS NOT DISTINCT FROM leaves.source, (SELECT h AS root FROM top WHERE n = 1)
"""
