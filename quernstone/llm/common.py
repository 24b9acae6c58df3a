"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.storage import Scratch, intermediates, shared_dir

__all__ = ["Scratch", "intermediates", "shared_dir"]

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def single_threaded() -> bool:
    """Has numpy's matrix products run on one thread in this process. A task has one core;
    a second thread mostly waits for the first, and its waiting takes CPU time as well."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            with contextlib.suppress(AttributeError):
                getattr(library, name)(1)
                return True
    return False


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores added until no column has the name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def free_names(columns: list[str], *bases: str) -> list[str]:
    out: list[str] = []
    for base in bases:
        out.append(free_name([*columns, *out], base))
    return out


def partitions(spark: SparkSession, rows: int = 0, most: int = 1) -> int:
    """The session's shuffle partitions, or as many as hold ``rows`` at ``most`` each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def crc_of_id(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_share(*keys: str) -> Column:
    """A whole number below 2^31 drawn from the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(2**31))


def share_below(n: int, most: int) -> int | None:
    """The bound of ``hash_share`` below which a little fewer than ``most`` of ``n`` rows
    lie; None if there are no more than ``most``."""
    return None if n <= most else int(max(most - 6 * most**0.5, most / 8) / n * 2**31)


def smallest_hashes(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """All rows, or where there are more than ``most``, those whose key hashes lie below a
    bound that leaves a little fewer. Unlike an ordered limit, no task sends ``most`` rows."""
    share = share_below(df.count(), most)
    return df if share is None else df.where(hash_share(*keys) < share)


def numbered(scratch: Scratch, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``index``, the row's place (from 0) in the whole order. Ranges are dealt by
    sampled bounds and numbered apart; only one count per range is summed centrally."""
    spark = scratch.spark
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = scratch.save(dealt, name)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order)
    # one row per range: its size is bounded by the number of shuffle partitions
    return (
        dealt.withColumn("_at", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(bases), "_range")
        .withColumn("index", F.col("_base") + F.col("_at"))
        .drop("_range", "_at", "_base")
    )


def placed_among_equals(scratch: Scratch, rows: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """Adds ``place``, the number (from 0) of a row among those with equal ``keys``.

    Rows are counted by key and partition; where a key has several, a row's place is its
    place in its partition and what earlier partitions hold of the key, so a key of very
    many rows is never in one task. Other rows aren't moved. ``rows`` is read again, so it
    is best a table; were its partitions to change, places would repeat but no row go."""
    part, n, base, *names = free_names([*rows.columns, place], "_part", "_n", "_base", *(f"_key{k}" for k in range(len(keys))))
    rows = rows.withColumn(part, F.spark_partition_id())
    counts = rows.groupBy(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True)), F.col(part)).agg(F.count("*").alias(n))
    all_, earlier = Window.partitionBy(*names), Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(n).over(earlier), F.lit(0))).withColumn(n, F.sum(n).over(all_)).where(F.col(n) > 1)
    counts = scratch.save(counts.drop(n).withColumnRenamed(part, f"{part}s"), name)
    if counts.isEmpty():
        return rows.withColumn(place, F.lit(0).cast("long")).drop(part)
    same = F.col(part) == F.col(f"{part}s")
    for k, x in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(x))
    single = rows.join(counts, same, "left_anti").withColumn(place, F.lit(0).cast("long"))
    here = Window.partitionBy(part, *names).orderBy(F.lit(0))
    several = rows.join(counts, same).withColumn(place, F.col(base) + F.row_number().over(here) - 1)
    return single.unionByName(several.select(*single.columns)).drop(part)


#: keys held by a task before those that it has several times are combined
HELD_KEYS = 4_000_000


def meeting(rows: DataFrame, keys_of) -> DataFrame:
    """Edges (a, b) that connect all nodes with a key in common. ``keys_of`` takes a batch
    of ``rows`` and gives arrays (key, node), nodes not negative.

    Of the nodes with one key in a task only the first travels under the key; the others
    are tied to it at once and dealt by themselves, so a key of very many rows is no
    larger in the shuffle than the number of tasks.
    """

    def combined(held: list) -> pd.DataFrame:
        key, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        low = node[head][head.cumsum() - 1]
        first = pd.DataFrame({"key": key[head], "node": node[head], "low": -1})
        more = ~head & (node != low)
        spread = (node[more] ^ key[more]) * np.int64(0x1E3779B97F4A7C15)
        return pd.concat([first, pd.DataFrame({"key": spread, "node": node[more], "low": low[more]})])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for key, node in keys_of(batch):
                held.append((key, node))
                size += len(key)
                if size >= HELD_KEYS:
                    yield combined(held)
                    held, size = [], 0
        if size:
            yield combined(held)

    least = F.min(F.when(F.col("low") < 0, F.col("node"))).over(Window.partitionBy("key"))
    tied = rows.mapInPandas(run, "key long, node long, low long").withColumn("least", least)
    return tied.select(F.col("node").alias("a"), F.when(F.col("low") < 0, F.col("least")).otherwise(F.col("low")).alias("b")).where("a <> b")


def dealt_blocks(scratch: Scratch, blocks: DataFrame, keyed, most: int) -> DataFrame:
    """(id, kind, gid, i, j, cut): the blocks in which a node is compared, from ``blocks``
    (id, component).

    Kind 0 is a connected set. A set of more than ``most`` nodes is compared by single
    keys (kind 1) if that compares fewer pairs, else in cuts of which each two meet;
    ``keyed`` gives (id, key) of a table of such nodes. Large keys are cut likewise.
    """
    sizes = scratch.save(blocks.groupBy("component").agg(F.count("*").alias("m")), "sizes")
    large = sizes.where(F.col("m") > most)
    whole = blocks.join(sizes, "component").select("id", F.lit(0).alias("kind"), F.col("component").alias("gid"), F.col("m").alias("of"))
    if not large.isEmpty():
        members = scratch.save(blocks.join(large, "component"), "members")
        rows = scratch.save(keyed(members.select("id")), "keyed")
        full = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "full")
        rows = rows.join(full, "key").join(members, "id")
        by_key = rows.groupBy("component", "m").agg(F.sum("n").alias("pairs")).where(F.col("pairs") < F.col("m").cast("double") * F.col("m"))
        by_key = scratch.save(by_key.select(F.col("component").alias("_set")), "by-key")
        whole = whole.join(by_key, F.col("gid") == F.col("_set"), "left_anti")
        whole = whole.unionByName(rows.join(by_key, F.col("component") == F.col("_set")).select("id", F.lit(1).alias("kind"), F.col("key").alias("gid"), F.col("n").alias("of")))
    cut = whole.withColumn("cuts", F.ceil(F.col("of") / most).cast("int")).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return tiles.select("id", "kind", "gid", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "cut")


#: What names a block of ``dealt_blocks``.
BLOCK = ["kind", "gid", "i", "j"]


def whole_blocks(batches, most: int):
    """Frames of whole blocks, numbered in ``_block``, of ``most`` rows or fewer or of one
    block; the rows of a block follow each other in ``batches``."""
    held = None
    for batch in chain(batches, [None]):
        last = batch is None
        if not last:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if held is None or not len(held) or not last and len(held) < most:
            continue
        key = held[BLOCK].to_numpy(np.int64)
        head = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
        held = held.assign(_block=head.cumsum())
        starts, at = np.flatnonzero(head), 0
        # the last block may go on in the next batch
        ends = np.append(starts[1:], len(held)) if last else starts[1:]
        while len(ends) and ends[-1] > at:
            fits = ends[(ends > at) & (ends <= at + most)]
            until = int(fits[-1] if len(fits) else ends[ends > at][0])
            yield held.iloc[at:until]
            at = until
        held = held.iloc[at:].reset_index(drop=True)


def connected(scratch: Scratch, edges: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected ``edges`` (a, b).
    Ids may be of any type that has an order. Ids without an edge to another id don't
    appear.

    Alternating large-star and small-star steps; each round is written to the shared
    folder. The table of moves (every id that stands above another, with the least of
    these) is written before it is joined, so that adaptive execution can send it to all
    tasks while it is small and part the rows of a hot id where it isn't.
    """
    current = scratch.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}-0",
    )
    for step in range(1, most_rounds + 1):
        moves = scratch.save(current.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), f"{name}-moves")
        if current.count() == moves.count() and current.join(moves, F.col("v") == F.col("x"), "left_semi").isEmpty():
            break  # every id hangs on a least one
        # large star: what stands above v goes to the least neighbour of v
        large = current.join(moves, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: u and all that stands below it go to the least of it
        large = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.select(F.inline(F.filter(pairs, lambda p: p["u"] != p["v"]))).distinct()
        current = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    scratch.drop(f"{name}-moves")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
