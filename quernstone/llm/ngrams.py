"""N-gram Jaccard join by signature trees.

A document is its set of distinct word shingles. Equal sets are one class. Min-hash bands
decide which classes meet in a block: 32 bands of 4 rows miss a pair at Jaccard 0.8 with a
probability of (1 - 0.8^4)^32 = 5e-8. Classes that share bands, directly or through
others, are one block; families of documents with a template in common chain into sets
that outgrow a task, and such a set is dealt out anew, by single band keys if that
compares fewer pairs than all pairs of the set, else in cuts that all meet.

In a block a tree is built whose nodes hold the OR of their members' bitmaps, the range of
set sizes, the largest slack (shingles that share a bit) and the cuts below them; two
traversals run against each other and drop node pairs whose largest possible overlap is
too small or that lie in one cut of two that meet. The exact test on whole sets follows
for what is left, except for two documents already known to be in one group.

Defined cases: no words or no text is an empty set, linked with nothing; fewer words than
a shingle has are one shingle, the whole sequence; a null id is linked with nothing; rows
that repeat an id are documents of their own, so two texts with one id are two members of
groups; further columns are left out, or carried along by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import BLOCK, Scratch, connected, dealt_blocks, free_names, meeting, whole_blocks

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Join:
    words: int = 5
    #: similarity as a share of 100
    least: int = 80
    bands: int = 32
    rows: int = 4
    #: documents of a block that meet in one task; larger blocks are tiled
    block: int = 2000
    fanout: int = 8
    seed: int = 5


class _Words(dict):
    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, known: _Words, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _MULTIPLY + h[k : k + n]
    return np.unique(_mixed(out))


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, join: Join) -> np.ndarray:
    """One 64-bit key for each band of min-hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(low, (x[at : at + 256, None] * a + b).min(axis=0), out=low)
    key = np.arange(1, join.bands + 1, dtype=np.uint64)
    for column in low.reshape(join.bands, join.rows).T:
        key = _mixed(key * _MULTIPLY + column.astype(np.uint64))
    return key


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, sum, n_shingles, print, bands) of every document; an empty set has no print."""
    rng = np.random.default_rng(join.seed)
    a = (rng.integers(0, 2**31, join.bands * join.rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 2**32, join.bands * join.rows, dtype=np.uint32)

    def rows(batches):
        known = _Words()
        for batch in batches:
            out = []
            for doc, text, digest in zip(batch["doc_id"], batch["text"], batch["sum"], strict=True):
                s = shingles(text, known, join.words)
                if len(s):
                    out.append((doc, digest, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(s, a, b, join).view(np.int64)))
                else:
                    out.append((doc, digest, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "sum", "n_shingles", "print", "bands"])

    # ids as text: a column of whole numbers with nulls would reach pandas as floats
    rows_of = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("sum"))
    made = rows_of.mapInPandas(rows, "doc_id string, sum string, n_shingles long, print binary, bands array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


class _Groups:
    """Union-find over the members of a block, with labels that numpy can compare."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [[k] for k in range(n)]

    def merge(self, i: int, j: int) -> None:
        x, y = self.label[i], self.label[j]
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []


class Tree:
    """Levels of nodes over documents in the given order, leaves first."""

    def __init__(self, sets: list[np.ndarray], fanout: int, bits: int, cuts: np.ndarray | None = None):
        n = len(sets)
        #: per level the lowest and highest cut below each node, where cuts don't meet themselves
        self.cuts = None if cuts is None else [(cuts, cuts)]
        self.fanout = fanout
        marks = np.zeros((n, bits // 8), np.uint8)
        for k, s in enumerate(sets):
            row = np.zeros(bits, bool)
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            marks[k] = np.packbits(row)
        maps = marks.view(np.uint64)
        size = np.array([len(s) for s in sets], np.int64)
        slack = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, least, most, slack = self.levels[-1]
            starts = np.arange(0, len(maps), fanout)
            self.levels.append((np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.maximum.reduceat(slack, starts)))
            if self.cuts:
                low, high = self.cuts[-1]
                self.cuts.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
        """Whether any document under i can reach the similarity with any under j."""
        maps, low, high, slack = self.levels[level]
        shared = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(np.minimum(high[i], high[j]), shared + np.minimum(slack[i], slack[j]))
        # least * union <= 100 * overlap, with union = sizes - overlap
        return (100 + least) * overlap >= least * (np.maximum(low[i], low[j]) + np.maximum(np.minimum(low[i], low[j]), -(-least * np.maximum(low[i], low[j]) // 100)))

    def pairs(self, least: int, chunk: int = 32_768):
        """Chunks of leaf pairs (i < j) that the bounds leave."""
        waiting = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while waiting:
            level, i, j = waiting.pop()
            if len(i) > chunk:
                waiting += [(level, i[chunk:], j[chunk:])]
                i, j = i[:chunk], j[:chunk]
            keep = self.possible(level, i, j, least)
            if self.cuts:
                low, high = self.cuts[level]
                keep &= (low[i] != high[j]) | (low[j] != high[i])
            i, j = i[keep], j[keep]
            if not level:
                yield i, j
                continue
            n = len(self.levels[level - 1][0])
            span = np.arange(self.fanout)
            ci = (i[:, None, None] * self.fanout + span[None, :, None]) + np.zeros((1, 1, self.fanout), np.int64)
            cj = (j[:, None, None] * self.fanout + span[None, None, :]) + np.zeros((1, self.fanout, 1), np.int64)
            ci, cj = ci.ravel(), cj.ravel()
            fine = (ci < n) & (cj < n) & ((ci < cj) if level == 1 else (ci <= cj))
            if fine.any():
                waiting.append((level - 1, ci[fine], cj[fine]))


def links_in(sets: list[np.ndarray], join: Join, cuts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places of two sets) that connect the same sets as all links do among these;
    with ``cuts``, only links between two cuts count."""
    if len(sets) < 2:
        return []
    order = np.array(sorted(range(len(sets)), key=lambda k: (0 if cuts is None else int(cuts[k]), int(sets[k][0]), len(sets[k]))))
    sets = [sets[k] for k in order]
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.median([len(s) for s in sets]) + 1)), 9, 15))
    groups, found = _Groups(len(sets)), []
    for i, j in Tree(sets, join.fanout, bits, None if cuts is None else np.asarray(cuts)[order]).pairs(join.least):
        open_ = groups.label[i] != groups.label[j]
        for x, y in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            if groups.label[x] == groups.label[y]:
                continue
            small, large = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if 100 * both >= join.least * (len(small) + len(large) - both):
                groups.merge(x, y)
                found.append((int(order[x]), int(order[y])))
    return found


def grouped(docs: DataFrame, scratch: Scratch, join: Join) -> DataFrame:
    """(doc_id, n_shingles, sum, class, component, low) of every row of ``docs``: the md5
    of its text, its class of equal sets, its group of classes and the smallest id in the
    group. Where there is no class (empty set, null id), the last three are null."""
    docs = docs.select("doc_id", "text")
    sets = scratch.save(sets_of(docs, join), "sets")
    full = sets.where("print IS NOT NULL AND doc_id IS NOT NULL")
    first = full.groupBy("print").agg(F.min(F.struct("doc_id", "sum")).alias("first"))
    # numbered as they are written, so that a class keeps its number
    first = scratch.save(first.select("print", "first.*").withColumn("node", F.monotonically_increasing_id()), "first")
    named = first.select("node", F.col("print").alias("_print"), F.col("doc_id").alias("_id"), F.col("sum").alias("_sum"))
    # one row of each class stands for it
    one = (F.col("print") == F.col("_print")) & (F.col("doc_id") == F.col("_id")) & (F.col("sum") == F.col("_sum"))
    bands = scratch.save(full.join(named, one).select("node", "bands"), "bands")

    def keys_of(batch):
        for at in range(0, len(batch), 4096):
            part = batch.iloc[at : at + 4096]
            keys = np.concatenate(part["bands"].tolist())
            yield keys, np.repeat(part["node"].to_numpy(), join.bands)

    def keyed(some: DataFrame) -> DataFrame:
        return bands.join(some, F.col("node") == F.col("id")).select("id", F.explode("bands").alias("key")).distinct()

    blocks = scratch.save(connected(scratch, meeting(bands, keys_of), "near"), "blocks")
    tiles = scratch.save(dealt_blocks(scratch, blocks, keyed, join.block).withColumnRenamed("id", "node"), "tiles")
    scratch.drop("bands")

    def compare(batches):
        known = _Words()
        for part in whole_blocks(batches, join.block):
            node, cut, texts = part["node"].to_numpy(), part["cut"].to_numpy(), part["text"].tolist()
            across = (part["i"] != part["j"]).to_numpy()
            starts = np.flatnonzero(np.diff(part["_block"].to_numpy(), prepend=0))
            found = []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
                # rows that repeat an id and text are one
                rows = np.unique(node[at:end], return_index=True)[1] + at
                got = [shingles(texts[k], known, join.words) for k in rows.tolist()]
                links = links_in(got, join, cut[rows] if across[at] else None)
                found += [(int(node[rows[x]]), int(node[rows[y]])) for x, y in links]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    # by merging at every size: the tiles grow with the input, as does what is moved
    placed = named.select("node", "_id", "_sum").join(tiles.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    texts = docs.withColumn("sum", F.md5(F.col("text").cast("binary"))).join(placed.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("sum") == F.col("_sum")))
    texts = texts.select(*BLOCK, "cut", "node", "text").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    links = scratch.save(texts.mapInPandas(compare, "a long, b long"), "links")
    groups = scratch.save(connected(scratch, links, "groups"), "groups")
    scratch.drop("tiles", "blocks", "members", "keyed")
    whole = first.join(groups, F.col("node") == F.col("id"), "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    whole = scratch.save(whole, "whole")
    lows = whole.groupBy("component").agg(F.min("doc_id").alias("low"))
    known = named.select("node", "_print").join(whole.select(F.col("node").alias("_node"), "component").join(lows, "component"), F.col("node") == F.col("_node"))
    # a null id must not look up a group of its text's other copies
    found = sets.join(known, (F.col("print") == F.col("_print")) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", "n_shingles", "sum", F.col("node").alias("class"), "component", "low")


def similar_groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    found = grouped(docs, Scratch(docs.sparkSession, "ngrams"), join)
    return found.select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row of ``docs`` of each group: of those with the smallest id, that whose text
    has the smallest md5; of rows that repeat both, any one. Documents without words and
    rows without an id all stay."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    found = scratch.save(grouped(docs, scratch, join), "grouped")
    keep = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "sum")).alias("k"), F.count("*").alias("n"))
    of, row, id_, sum_ = free_names(docs.columns, "_of", "_row", "_id", "_sum")
    keep = scratch.save(keep.select(F.col("k.doc_id").alias(id_), F.col("k.sum").alias(sum_)), "keep")
    alone = found.where("component IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_), F.col("sum").alias(sum_))
    wide = docs.withColumn(of, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    same = (F.col("doc_id") == F.col(id_)) & (F.col(of) == F.col(sum_))
    one = wide.join(keep, same, "left_semi")
    if found.where("component IS NOT NULL").groupBy("doc_id", "sum").count().where("count > 1").isEmpty():
        single = one
    else:
        # rows that repeat an id and text are few beside the rest, so they are put in order
        single = one.withColumn(row, F.row_number().over(Window.partitionBy("doc_id", of).orderBy(F.lit(0)))).where(F.col(row) == 1).drop(row)
    rest = wide.where("doc_id IS NULL").unionByName(wide.join(alone.distinct(), same, "left_semi"))
    return single.unionByName(rest).select(*docs.columns)


def op2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.size + b.size - shared)
), r AS (
  SELECT doc_id AS id, doc_id AS low FROM d
  UNION
  SELECT l.y, r.low FROM r JOIN l ON l.x = r.id WHERE r.low < l.y
)
SELECT d.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(low) AS low FROM r GROUP BY id) c ON c.id = d.doc_id
"""
