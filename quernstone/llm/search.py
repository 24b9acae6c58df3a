"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors get one more component so that the largest inner product is the smallest
distance, and are projected by a few Gaussian (2-stable) directions. A kd-tree fitted on
a bounded sample parts the projected space into cells; every row is put into its cell.
A query first looks into its nearest cell, then into all those that the stopping test
leaves. In a cell the leaves of a local tree are verified from the nearest on: the test
holds once a neighbour as good as the k-th best so far would, with probability ``sure``,
have had a smaller projected distance (a chi-square value) than the next leaf has.

Equal vectors are one entry with its k + 1 smallest ids: no other can be among k nearest.

Vectors of one length have an index of their own, and queries answer from it. Lengths with
no more rows than a cell holds are one cell each and are searched together, a task a length.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors of two lengths aren't compared; a null id is no query and no
candidate; rows that repeat an id and vector are one candidate; of rows that repeat a
query's id none is a candidate for it; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, single_threaded, smallest_hashes
from quernstone.llm.vectors import usable


@dataclass(frozen=True)
class Search:
    k: int = 20
    directions: int = 8
    sure: float = 0.98
    #: rows that the cells are fitted on, at most
    sample: int = 20_000
    cell_rows: int = 4_000
    most_cells: int = 4_096
    #: rows of a cell that one task holds; larger cells are cut
    cut_rows: int = 8_000
    #: queries that one task holds
    slice_rows: int = 50_000
    leaf: int = 128
    seed: int = 9


#: bytes of distances and of routed vectors that one step makes
ROUTED_BYTES = 128 << 20


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype="f8") / 2, 600.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def split_sample(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(direction, bound) of the inner nodes of a balanced tree, in heap order."""
    nodes: list[tuple[int, float]] = []
    waiting = [points]
    while len(waiting) < cells:
        later = []
        for some in waiting:
            axis = int(np.ptp(some, axis=0).argmax()) if len(some) else 0
            bound = float(np.median(some[:, axis])) if len(some) else 0.0
            nodes.append((axis, bound))
            low = some[:, axis] <= bound
            later += [some[low], some[~low]]
        waiting = later
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not nodes:
        return at
    axis, bound = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        right = points[np.arange(len(points)), axis[at]] > bound[at]
        at = 2 * at + 1 + right
    return at - len(nodes)


def _distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out, gap = np.zeros((len(points), len(low))), np.empty((len(points), len(low)))
    for d in range(points.shape[1]):
        np.subtract(low[None, :, d], points[:, d, None], out=gap)
        np.maximum(gap, points[:, d, None] - high[None, :, d], out=gap)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


def _leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    waiting, out = [np.arange(len(points))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        half = np.argpartition(points[rows, axis], len(rows) // 2)
        waiting += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return out


def look(points: np.ndarray, vectors: np.ndarray, queries: np.ndarray, turned: np.ndarray, norms: np.ndarray, bound: np.ndarray, most: float, search: Search):
    """(query, row, score) of the best rows of one cell, at most k + 1 a query and none
    below ``bound``, the k-th best score known so far."""
    leaves = _leaves(points, search.leaf)
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    gaps = _distances(turned, low, high)
    order = np.argsort(gaps, axis=1, kind="stable")
    keep = search.k + 1
    scores, rows = np.full((len(queries), keep), -np.inf), np.full((len(queries), keep), -1)
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        leaf = order[active, turn]
        # squared distance of the k-th best: |q|^2 + most^2 - 2 score
        best = np.maximum(scores[active, -1], bound[active])
        far = np.where(np.isfinite(best), norms[active] ** 2 + most**2 - 2 * best, np.inf)
        seen = chi_square(gaps[active, leaf] / np.maximum(far, 1e-12), search.directions)
        go = seen < search.sure
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        for one in np.unique(leaf):
            who = active[leaf == one]
            found = queries[who] @ vectors[leaves[one]].T
            both = np.concatenate([scores[who], found], axis=1)
            names = np.concatenate([rows[who], np.broadcast_to(leaves[one], found.shape)], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :keep]
            scores[who], rows[who] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
    # a product's last bits depend on the rows it is taken with, so near the bound all stay
    # and what stays is computed row by row
    q, at = np.nonzero((rows >= 0) & (scores >= (bound - 1e-9 * np.maximum(1, np.abs(bound)))[:, None]))
    at = rows[q, at]
    return q, at, np.einsum("ij,ij->i", queries[q], vectors[at])


def _turn(dim: int, search: Search) -> np.ndarray:
    return np.random.default_rng(search.seed).normal(size=(dim + 1, search.directions))


def _projected(x: np.ndarray, turn: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1), 0))
    return x @ turn[:-1] + rest[:, None] * turn[-1]


def _searched(points: np.ndarray, x: np.ndarray, ids: list, names: np.ndarray, q: np.ndarray, bound: np.ndarray, turn: np.ndarray, most: float, search: Search) -> pd.DataFrame:
    """The best candidates in one cell of each of the queries ``names``."""
    out: list[tuple] = []
    for at in range(0, len(names), 1024):
        some, who = q[at : at + 1024], names[at : at + 1024]
        found = look(points, x, some, some @ turn[:-1], np.linalg.norm(some, axis=1), bound[at : at + 1024], most, search)
        out += [(int(who[i]), int(v), float(s)) for i, j, s in zip(*(f.tolist() for f in found), strict=True) for v in ids[j] if v != who[i]]
    best = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return best.groupby("query_id").head(search.k)


ANSWER = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, search: Search = Search(), every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id ``every`` divides."""
    scratch = Scratch(vectors.sparkSession, "search")
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    good = good.withColumn("dim", F.size("vector"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = good.distinct().withColumn("_place", place).where(F.col("_place") <= search.k + 1)
    entries = entries.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    entries = scratch.save(entries.withColumn("norm", norm), "entries")
    asked = scratch.save(good.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("vec_id", "vector", "dim").distinct(), "asked")
    lengths = entries.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most"))
    # lengths that fill more than a cell: fewer than there are cells' worth of rows
    large = lengths.where(F.col("n") > search.cell_rows).orderBy("dim").collect()
    names = [r["dim"] for r in large]
    found = _small(entries.where(~F.col("dim").isin(names)), asked.where(~F.col("dim").isin(names)), search)
    for r in large:
        one = F.col("dim") == r["dim"]
        found = found.unionByName(_of_length(scratch, entries.where(one).drop("dim"), asked.where(one).drop("dim"), r["dim"], r["n"], r["most"], search))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _small(entries: DataFrame, asked: DataFrame, search: Search) -> DataFrame:
    """Answers of lengths that are one cell each: its entries, by slices of the queries."""
    # a cell's queries are no more than its entries and the ids of equal vectors
    count = asked.groupBy("dim").agg(F.ceil(F.count("*") / search.slice_rows).cast("int").alias("slices"))
    here = entries.join(count, "dim").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "norm")
    asked = asked.join(count, "dim").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int")).drop("slices")

    def answer(here: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        single_threaded()
        if not len(here) or not len(asking):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        x, q = (np.array(t["vector"].tolist(), dtype="f8") for t in (here, asking))
        turn, most = _turn(x.shape[1], search), float(np.sqrt((x**2).sum(axis=1).max()))
        return _searched(_projected(x, turn, most), x, here["ids"].tolist(), asking["vec_id"].to_numpy(), q, np.full(len(q), -np.inf), turn, most, search)

    return here.groupBy("dim", "slice").cogroup(asked.groupBy("dim", "slice")).applyInPandas(answer, ANSWER)


def _of_length(scratch: Scratch, entries: DataFrame, asked: DataFrame, dim: int, n: int, most: float, search: Search) -> DataFrame:
    """Answers (query_id, vec_id, score), the best of them at least, among vectors of one length."""
    spark = scratch.spark
    turn = _turn(dim, search)

    def projected(x: np.ndarray) -> np.ndarray:
        return _projected(x, turn, most)

    chosen = smallest_hashes(entries.select("vector"), search.sample, "vector").collect()
    cells = 1 << max(0, min(search.most_cells, -(-n // search.cell_rows)) - 1).bit_length()
    nodes = split_sample(projected(np.array([r["vector"] for r in chosen], dtype="f8").reshape(-1, dim)), cells)

    def place_rows(batches):
        single_threaded()
        for batch in batches:
            x = np.array(batch["vector"].tolist(), dtype="f8").reshape(-1, dim)
            p = projected(x)
            yield pd.DataFrame({"cell": cell_of(p, nodes), "vector": batch["vector"], "point": list(p), "ids": batch["ids"]})

    index = scratch.save(entries.mapInPandas(place_rows, "cell int, vector array<double>, point array<double>, ids array<long>"), f"index-{dim}")
    # boxes and row counts: one row a cell, and there are most_cells at most
    corner = [f(F.col("point")[d]) for d in range(search.directions) for f in (F.min, F.max)]
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), F.array(*corner).alias("box")).orderBy("cell").collect()
    number = np.array([b["cell"] for b in boxes])
    edges = np.array([b["box"] for b in boxes], dtype="f8").reshape(-1, search.directions, 2)
    cuts = {b["cell"]: -(-b["n"] // search.cut_rows) for b in boxes}
    # one row a cell: most_cells at most
    parts = spark.createDataFrame(list(cuts.items()), "cell int, cuts int")
    index = index.join(F.broadcast(parts), "cell").withColumn("cut", F.pmod(F.xxhash64("vector"), F.col("cuts")).cast("int")).drop("cuts")
    # a task holds the queries of one slice at most; a cell goes to as many tasks as there are slices
    slices = max(1, -(-asked.count() // search.slice_rows))
    index = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices > 1 else index.withColumn("slice", F.lit(0))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    chunk = max(1, ROUTED_BYTES // (8 * (dim + 4) * max(1, sum(cuts.values()))))

    def route(first: bool):
        def some_rows(part: pd.DataFrame) -> pd.DataFrame:
            x = np.array(part["vector"].tolist(), dtype="f8").reshape(-1, dim)
            norms = np.linalg.norm(x, axis=1)
            gaps = _distances(x @ turn[:-1], edges[:, :, 0], edges[:, :, 1])
            home = gaps.argmin(axis=1)
            if first:
                at, to = np.arange(len(x)), home
                bound = np.full(len(x), -np.inf)
            else:
                bound = part["bound"].fillna(-np.inf).to_numpy()
                far = np.where(np.isfinite(bound), norms**2 + most**2 - 2 * bound, np.inf)
                open_ = chi_square(gaps / np.maximum(far, 1e-12)[:, None], search.directions) < search.sure
                open_[np.arange(len(x)), home] = False
                at, to = np.nonzero(open_)
            ids, slice_, vector = part["vec_id"].tolist(), part["slice"].tolist(), part["vector"].tolist()
            out = [(ids[q], vector[q], float(bound[q]), int(number[c]), k, slice_[q]) for q, c in zip(at.tolist(), to.tolist(), strict=True) for k in range(cuts[int(number[c])])]
            return pd.DataFrame(out, columns=["query_id", "query", "bound", "cell", "cut", "slice"])

        def rows(batches):
            single_threaded()
            for batch in batches:
                for at in range(0, len(batch), chunk):
                    yield some_rows(batch.iloc[at : at + chunk])

        return rows

    def search_cell(key, here: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        single_threaded()
        if not len(here) or not len(asking):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        x, points, q = (np.array(c.tolist(), dtype="f8") for c in (here["vector"], here["point"], asking["query"]))
        return _searched(points, x, here["ids"].tolist(), asking["query_id"].to_numpy(), q, asking["bound"].to_numpy(), turn, most, search)

    ask = "query_id long, query array<double>, bound double, cell int, cut int, slice int"

    def searched(routed: DataFrame) -> DataFrame:
        return index.groupBy("cell", "cut", "slice").cogroup(routed.groupBy("cell", "cut", "slice")).applyInPandas(search_cell, ANSWER)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    at_home = scratch.save(searched(asked.mapInPandas(route(True), ask)), f"home-{dim}")
    kth = at_home.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == search.k).select("query_id", F.col("score").alias("bound"))
    again = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", "slice", "bound")
    return at_home.unionByName(searched(again.mapInPandas(route(False), ask)))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
