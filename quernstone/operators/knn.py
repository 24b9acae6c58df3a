"""Exact nearest neighbours of many queries, by pivots and the triangle inequality.

A bounded sample of rows are pivots; every row belongs to the cell of its nearest pivot. A
query is answered in its own cell first. The k-th distance found there is a bound: a cell
is visited only if its nearest possible row, by the cell's radius and by the plane between
the two pivots, may lie within it. Cells of many rows are cut, and queries of one cell are
dealt in slices, so a task holds a bounded number of both.

The largest inner product is the smallest distance after one more component has brought
all rows to one length, so both measures share the search; values are computed from the
vectors as they are.

Defined cases: null and empty vectors, and such with null components, take no part;
vectors of two lengths aren't compared; equal values go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.storage import Scratch


@dataclass(frozen=True)
class Pivots:
    #: rows per cell aimed at, and pivots at most (each is a vector that all tasks get)
    cell_rows: int = 2_000
    most: int = 1_024
    #: rows of a cell and queries of a cell that one task holds
    cut_rows: int = 8_000
    slice_rows: int = 20_000
    #: bytes of vectors that one step of routing sends on
    step_bytes: int = 64 << 20
    seed: int = 3


#: Distances are rounded to nine digits, so all that may round to a bound stays.
SLACK = 1e-8


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="f8")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, a little off."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def _best(ids: np.ndarray, x: np.ndarray, names: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, dot: bool, skip_self: bool, lift: float):
    """(query, id, value) of each query's first k rows in one cell, none beyond its bound.
    Products of matrices choose the candidates with room to spare; their values are then
    computed one by one."""
    out = []
    rest = np.maximum(lift * lift - (x * x).sum(axis=1), 0) if dot else 0.0
    for at in range(0, len(q), 256):
        part, who = q[at : at + 256], names[at : at + 256]
        far = _squares(part, x) + rest
        if skip_self:
            far[who[:, None] == ids] = np.inf
        kth = np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf)
        room = np.minimum(np.sqrt(kth), bound[at : at + 256]) + SLACK
        margin = 1e-12 * (1 + (part * part).sum(axis=1) + (lift * lift if dot else (x * x).sum(axis=1).max()))
        i, j = np.nonzero((far <= (room * room + margin)[:, None]) & np.isfinite(far))
        for low in range(0, len(i), 1 << 16):
            a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            value = np.einsum("ij,ij->i", part[a], x[b]) if dot else np.sqrt(((part[a] - x[b]) ** 2).sum(axis=1))
            out.append(pd.DataFrame({"query_id": who[a], "id": ids[b], "value": np.round(value, 9)}))
    if not out:
        return pd.DataFrame({"query_id": [], "id": [], "value": []})
    found = pd.concat(out).sort_values(["query_id", "value", "id"], ascending=[True, not dot, True], kind="stable")
    return found.groupby("query_id").head(k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, measure: str = "l2", within: float | None = None, skip_self: bool = False, pivots: Pivots = Pivots()) -> DataFrame:
    """(query_id, id, measure): of each query (query_id, embedding) the first ``k`` rows
    (id, embedding); with ``within`` only rows at most so far away count."""
    scratch, dot = Scratch(rows.sparkSession, "knn"), measure == "dot"
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull())
    vector = F.col("embedding").cast("array<double>").alias("x")
    id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = scratch.save(rows.where(whole("embedding")).select("id", vector), "rows")
    asked = scratch.save(queries.where(whole("embedding")).select("query_id", vector), "asked")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    n, lift = rows.agg(F.count("*"), F.max(norm)).first()
    lift = float(lift or 0.0)
    want = max(1, min(pivots.most, -(-n // pivots.cell_rows)))
    # by lengths: a length that the sample misses has one cell without a pivot
    drawn = rows.select("x").distinct().orderBy(F.xxhash64("x", F.lit(pivots.seed))).limit(want).collect()
    by_length: dict[int, np.ndarray] = {}
    for r in drawn:
        by_length.setdefault(len(r["x"]), []).append(r["x"])
    by_length = {d: np.array(v, dtype="f8") for d, v in by_length.items()}

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(lift * lift - (x * x).sum(axis=1), 0))[:, None]], axis=1) if dot else x

    def gaps(x: np.ndarray, queries: bool) -> np.ndarray | None:
        """Distances to all pivots of one length."""
        points = by_length.get(x.shape[1])
        if points is None:
            return None
        x = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if dot and queries else lifted(x)
        return np.sqrt(np.array([((x - p) ** 2).sum(axis=1) for p in lifted(points)]).T)

    def placed(name: str, queries: bool):
        def run(batches):
            for batch in batches:
                for size, part in batch.groupby(batch["x"].map(len)):
                    far = gaps(_matrix(part["x"]), queries)
                    cell = np.zeros(len(part), np.int64) if far is None else far.argmin(axis=1)
                    near = np.full(len(part), np.inf) if far is None else far.min(axis=1)
                    yield pd.DataFrame({"dim": int(size), "cell": cell, "far": near, name: part[name], "x": part["x"]})

        return run

    cells = scratch.save(rows.mapInPandas(placed("id", False), f"dim int, cell int, far double, id {id_type}, x array<double>"), "cells")
    homes = scratch.save(asked.mapInPandas(placed("query_id", True), f"dim int, cell int, far double, query_id {query_type}, x array<double>"), "homes")
    # one row a cell: no more than pivots and lengths
    stats = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("dim", "cell").collect()
    known = {d: [(r["cell"], r["radius"]) for r in stats if r["dim"] == d] for d in {r["dim"] for r in stats}}
    cuts = rows.sparkSession.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // pivots.cut_rows)) for r in stats], "dim int, cell int, cuts int")
    cells = cells.join(F.broadcast(cuts), ["dim", "cell"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).drop("cuts", "far")

    def ways(batches):
        """The cells besides its own that a query with a bound has to visit."""
        for batch in batches:
            for size, part in batch.groupby("dim"):
                points = by_length.get(int(size))
                at = known.get(int(size), [])
                if points is None or not at:
                    continue
                step = max(1, pivots.step_bytes // (8 * int(size) * len(at)))
                number, radius = np.array([c for c, _ in at]), np.array([r for _, r in at])
                between = np.sqrt(_squares(lifted(points), lifted(points)))
                for low in range(0, len(part), step):
                    some = part.iloc[low : low + step]
                    far, home, bound = gaps(_matrix(some["x"]), True), some["cell"].to_numpy(), some["bound"].to_numpy()
                    own = far[np.arange(len(some)), home][:, None]
                    plane = (far[:, number] ** 2 - own**2) / np.maximum(2 * between[home][:, number], 1e-300)
                    least = np.maximum(far[:, number] - radius, plane)
                    go = (least <= (bound + 1e-7 * (1 + bound))[:, None]) & (number != home[:, None])
                    i, j = np.nonzero(go)
                    yield pd.DataFrame({"dim": int(size), "cell": number[j], "bound": bound[i], "query_id": some["query_id"].to_numpy()[i], "x": some["x"].to_numpy()[i]})

    def answers(visits: DataFrame) -> DataFrame:
        load = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / pivots.slice_rows).cast("int").alias("slices"))
        # a cell is sent once for each slice of its queries and not at all without any
        here = cells.join(F.broadcast(load), ["dim", "cell"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        asking = visits.join(F.broadcast(load), ["dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")).drop("slices")
        asking = asking.join(F.broadcast(cuts), ["dim", "cell"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")

        def look(here: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if not len(here) or not len(asking):
                return pd.DataFrame({"query_id": [], "id": [], "value": []})
            return _best(here["id"].to_numpy(), _matrix(here["x"]), asking["query_id"].to_numpy(), _matrix(asking["x"]), asking["bound"].to_numpy(), k, dot, skip_self, lift)

        keys = ["dim", "cell", "cut", "slice"]
        return here.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(look, f"query_id {query_type}, id {id_type}, value double")

    value = F.col("value").desc() if dot else F.col("value").asc()
    order = Window.partitionBy("query_id").orderBy(value, "id")
    top = float("inf") if within is None else within
    start = homes.select("dim", "cell", F.lit(top).alias("bound"), "query_id", "x")
    first = scratch.save(answers(start), "first")
    kth = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("query_id", F.col("value").alias("_kth"))
    # as a distance: of a product, by the lengths of the query and of the lifted rows
    reach = F.when(F.col("_kth").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), norm * norm + lift * lift - 2 * F.col("_kth")))) if dot else F.col("_kth")
    bounded = homes.join(kth, "query_id", "left").withColumn("bound", F.least(F.lit(top), F.coalesce(reach, F.lit(float("inf")))))
    visits = scratch.save(bounded.mapInPandas(ways, f"dim int, cell int, bound double, query_id {query_type}, x array<double>"), "visits")
    found = first.unionByName(answers(visits))
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query_id", "id", F.col("value").alias(measure))
