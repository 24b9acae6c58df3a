"""Embedding near-dedup by randomised-rotation binary codes.

Equal vectors are one class. Each class stores the packed sign bits of randomly rotated
copies of its unit vector (its code) and a correction factor, the inner product of vector
and code. In a block of classes the rotated vector of one and the code of another give an
unbiased estimate of their inner product; only pairs whose upper confidence bound reaches
the least similarity are computed anew in double precision.

Which classes of a label meet in a block is decided by bands of sign bits: their number is
set so that a pair at the least similarity shares no band with a probability of ``miss``,
and they are so wide that unrelated vectors rarely meet. Classes that share bands,
directly or through others, are one block. Where vectors have a direction in common, such
sets outgrow a task; a set that does is dealt out anew, by single buckets (a band's value)
if that compares fewer pairs than all pairs of the set, else in cuts that all meet. A pair
that shares several buckets counts in that of its first band alone.

Defined cases: a null label, a null id or a vector that is null, empty, zero or holds null
or non-finite components links with nothing; vectors of different length don't link; rows
that repeat an id are rows of their own; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import BLOCK, Scratch, connected, dealt_blocks, meeting, single_threaded, whole_blocks


@dataclass(frozen=True)
class Near:
    least: float = 0.93
    #: chance that a pair at the least similarity meets in no block
    miss: float = 1e-5
    #: codes have this many rotations' bits, bounds this many standard errors
    rotations: int = 2
    errors: float = 6.0
    block: int = 1500
    most_bits: int = 40
    seed: int = 3


def usable(vector: Column) -> Column:
    """Whether a vector is finite throughout and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def band_shape(n: int, near: Near) -> tuple[int, int]:
    """(bits, bands) for labels of up to n vectors: the fewest bits at which a vector
    meets less than half an unrelated one."""
    agree = 1 - math.acos(near.least) / math.pi
    for bits in range(6, near.most_bits + 1):
        bands = math.ceil(math.log(near.miss) / math.log1p(-(agree**bits)))
        if n * bands <= 2 ** (bits - 1):
            break
    return bits, bands


@lru_cache(maxsize=16)
def rotations(dim: int, number: int, seed: int) -> np.ndarray:
    """``number`` random orthogonal matrices, one under the other."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(number)])


def _matrix(vectors) -> np.ndarray:
    return np.array(vectors.tolist(), dtype="f8").reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def band_values(unit: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """The bits of each band as a whole number."""
    dim = unit.shape[1]
    turn = rotations(dim, -(-bits * bands // dim), seed)[: bits * bands]
    out = np.empty((len(unit), bands), np.uint64)
    for at in range(0, len(unit), 2048):
        signs = (unit[at : at + 2048] @ turn.T > 0).reshape(-1, bits)
        out[at : at + 2048] = (signs.astype("f8") @ 2.0 ** np.arange(bits)).reshape(-1, bands).astype(np.uint64)
    return out


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A bucket's key has its band in the lowest bits.
BAND_BITS = 13


def bucket_keys(values: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A key of each label (``tag``), band and value."""
    band = np.arange(values.shape[1], dtype=np.uint64)
    x = (values + tag.astype(np.int64).view(np.uint64)[:, None]) * _A + band
    for k in (31, 29):
        x = (x ^ (x >> np.uint64(k))) * _B
    return (((x ^ (x >> np.uint64(32))) << np.uint64(BAND_BITS)) | band).view(np.int64)


def codes_of(unit: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, and the inner product of each vector and
    its code."""
    turned = unit @ rotations(unit.shape[1], near.rotations, near.seed + 1).T
    width = turned.shape[1]
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(width * near.rotations)


def upper_bounds(unit: np.ndarray, codes: np.ndarray, factor: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of all vectors (rows) with all codes (columns), and
    how far above its estimate a product may lie."""
    turned = (unit @ rotations(unit.shape[1], near.rotations, near.seed + 1).T).astype("f4")
    width = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=width).astype("f4") * 2 - 1
    estimate = turned @ signs.T
    estimate *= (1 / (math.sqrt(width * near.rotations) * factor)).astype("f4")
    spread = near.errors * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(width - 1, 1))
    return estimate, spread


def links_in(unit: np.ndarray, codes: np.ndarray, factor: np.ndarray, cell: np.ndarray, cut: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one cell that reach the least similarity. Rows of a cell that is
    compared crosswise have their cut, others -1; a cut isn't compared with itself."""
    estimate, spread = upper_bounds(unit, codes, factor, near)
    likely = estimate >= (near.least - spread).astype("f4")
    likely &= cell[:, None] == cell
    likely &= (cut[:, None] != cut) | (cut < 0)
    i, j = np.nonzero(np.triu(likely, 1))
    if 16 * len(i) > likely.size:
        sure = (unit @ unit.T)[i, j] >= near.least
        return i[sure], j[sure]
    sure = np.zeros(len(i), bool)
    for k in range(0, len(i), 65_536):
        part = slice(k, k + 65_536)
        sure[part] = np.einsum("ij,ij->i", unit[i[part]], unit[j[part]]) >= near.least
    return i[sure], j[sure]


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the pairs."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    return low


FOUND = "a long, b long, n long"


def compared(placed: DataFrame, near: Near, bits: int, bands: int) -> DataFrame:
    """Per block: rows (a, null, n) with the vectors that a class links to, and edges
    (a, b, 0) that connect what the links connect. ``placed`` has the columns of the
    table of classes and kind, gid, i, j, cut; blocks lie together in its partitions."""

    def some_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(rows["embedding"].map(len)):
            unit = _unit(_matrix(part["embedding"]))
            cell = part.groupby(["_block", "label"], sort=False).ngroup().to_numpy()
            cut = np.where(part["i"] == part["j"], -1, part["cut"])
            i, j = links_in(unit, np.stack([np.frombuffer(c, np.uint8) for c in part["code"]]), part["factor"].to_numpy(), cell, cut, near)
            kind = part["kind"].to_numpy()
            by_bucket = np.flatnonzero(kind[i] == 1)
            if len(by_bucket):
                values = band_values(unit, bits, bands, near.seed)
                band = part["gid"].to_numpy() & ((1 << BAND_BITS) - 1)
                keep = np.ones(len(i), bool)
                for at in range(0, len(by_bucket), 16_384):
                    k = by_bucket[at : at + 16_384]
                    keep[k] = (values[i[k]] == values[j[k]]).argmax(axis=1) == band[i[k]]
                i, j = i[keep], j[keep]
            node, n = part["node"].to_numpy(), part["n"].to_numpy()
            links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
            low = _lowest(len(node), i, j)
            has, hangs = np.flatnonzero(links > 0), np.flatnonzero(low != np.arange(len(node)))
            out.append(pd.DataFrame({"a": node[has], "b": None, "n": links[has].astype("i8")}))
            out.append(pd.DataFrame({"a": node[hangs], "b": node[low[hangs]], "n": 0}))
        return pd.concat(out).astype({"b": "Int64"})

    def rows(batches):
        single_threaded()
        for part in whole_blocks(batches, near.block):
            yield some_blocks(part)

    return placed.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInPandas(rows, FOUND)


def near_groups(vectors: DataFrame, near: Near = Near()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    label = vectors.schema["label"].dataType.simpleString()
    good = vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"))

    def coded(batches):
        single_threaded()
        for batch in batches:
            for _, some in batch.groupby(batch["embedding"].map(len)):
                codes, factor = codes_of(_unit(_matrix(some["embedding"])), near)
                yield some.assign(code=[c.tobytes() for c in codes], factor=factor)

    element = vectors.schema["embedding"].dataType.simpleString()
    classes = classes.mapInPandas(coded, f"label {label}, embedding {element}, head long, n long, code binary, factor double")
    # numbered as they are written, so that a class keeps its number
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label", F.size("embedding").alias("dim")).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, bands = band_shape(most, near)

    def keys_of(batch):
        single_threaded()
        for _, some in batch.groupby(batch["embedding"].map(len)):
            for at in range(0, len(some), 2048):
                part = some.iloc[at : at + 2048]
                values = band_values(_unit(_matrix(part["embedding"])), bits, bands, near.seed)
                yield bucket_keys(values, part["tag"].to_numpy()).ravel(), np.repeat(part["node"].to_numpy(), bands)

    def keyed(some: DataFrame) -> DataFrame:
        def rows(batches):
            for batch in batches:
                for key, node in keys_of(batch):
                    yield pd.DataFrame({"id": node, "key": key})

        return tagged.join(some, F.col("node") == F.col("id")).drop("id").mapInPandas(rows, "id long, key long")

    tagged = classes.select("node", "embedding", F.xxhash64("label", F.size("embedding")).alias("tag"))
    meet = connected(scratch, meeting(tagged, keys_of), "meet")
    places = dealt_blocks(scratch, scratch.save(meet, "blocks"), keyed, near.block)
    placed = classes.select("node", "label", "embedding", "n", "code", "factor").join(places, F.col("node") == F.col("id")).drop("id")
    found = scratch.save(compared(placed, near, bits, bands), "found")
    scratch.drop("blocks", "members", "keyed")
    groups = scratch.save(connected(scratch, found.where("b IS NOT NULL").select("a", "b"), "groups"), "groups")
    heads = groups.join(classes.select("node", "head"), F.col("id") == F.col("node"))
    lows = heads.groupBy("component").agg(F.min("head").alias("_low"))
    lows = groups.join(lows, "component").select("id", "_low")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_links"))
    known = classes.join(lows, F.col("node") == F.col("id"), "left").join(linked, F.col("node") == F.col("_a"), "left")
    known = known.select(F.col("label").alias("_label"), F.col("embedding").alias("_vector"), (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("_low", "head").alias("_low"))
    rows = vectors.select("vec_id", "label", F.when(F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.col("embedding")).alias("_v"))
    out = rows.join(known, (F.col("label") == F.col("_label")) & (F.col("_v") == F.col("_vector")), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS id, vec_id AS low FROM embeddings
  UNION
  SELECT l.y, r.low FROM r JOIN l ON l.x = r.id WHERE r.low < l.y
), c AS (SELECT id, min(low) AS low FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.low AS component_id, vec_id IS NOT DISTINCT FROM c.low AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id JOIN c ON c.id IS NOT DISTINCT FROM vec_id
"""
