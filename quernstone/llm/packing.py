"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Each partition of pieces is packed by best-fit decreasing and compared with a lower
bound from dual feasible functions. A partition that meets its bound is settled; those
with a gap put the pieces of their unfilled sequences together, are dealt anew into fewer
partitions and are packed again, as are the emptiest sequences of settled partitions.

Defined cases: a null or empty text is the end id alone; a document over the capacity is
cut into pieces of exactly the capacity, only the first being shorter; repeated rows are
packed each; a null id stays null; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch
from quernstone.llm.tokens import encoder

CAPACITY = 2048
#: pieces in a partition, about
PART = 60_000
ROUNDS = 6
#: a settled partition keeps sequences with at most this share of space left
SPARE = 1 / 256
#: a partition over its volume by more than this share exchanges all its pieces
LOOSE = 1 / 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def rows(batches):
        encode = encoder().document
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # ids as text: a column of whole numbers with nulls would reach pandas as floats
    named = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInPandas(rows, PIECES.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing, and the space left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    having: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by space left
    open_spaces, left = 0, []  # bit s: some bin has s tokens of space
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fits = open_spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = having[space].pop()
            if not having[space]:
                open_spaces &= ~(1 << space)
        else:
            space, at = capacity, len(left)
            left.append(capacity)
        bins[item], offsets[item] = at, capacity - space
        left[at] = space - length
        if left[at]:
            having[left[at]].append(at)
            open_spaces |= 1 << left[at]
    return bins, offsets, np.array(left, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 30) -> int:
    """The largest of the bounds that two families of dual feasible functions give."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    number, volume = count.cumsum(), (count * size).cumsum()
    total = int(volume[-1])
    best = -(-total // capacity)
    # items over capacity - e count as whole, those under e as nothing
    for e in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - e])
        middle = int(volume[capacity - e] - volume[e - 1])
        best = max(best, large + -(-middle // capacity))
    # x goes to floor((k + 1) x) / k, but stays where (k + 1) x is whole
    for k in range(1, most_k + 1):
        whole = (k + 1) * size % capacity == 0
        same = int((count * size)[whole].sum())
        stepped = int((count * ((k + 1) * size // capacity))[~whole].sum())
        best = max(best, -(-(same * k + stepped * capacity) // (capacity * k)))
    return best


PLACED = "_pid long, doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, _left long, _gap long, _loose boolean"


def _round(waiting: DataFrame, capacity: int) -> DataFrame:
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_pid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        # a sequence is named by its smallest piece number: unique over all partitions
        names = pd.Series(group["_pid"].to_numpy()).groupby(bins).min().to_numpy()
        gap = len(left) - lower_bound(lengths, capacity)
        loose = len(left) - -(-int(lengths.sum()) // capacity) > LOOSE * len(left)
        out = group.drop(columns=["_part"])
        return out.assign(sequence_id=names[bins], offset=offsets, _left=left[bins], _gap=gap, _loose=loose)

    return waiting.groupBy("_part").applyInPandas(place, PLACED)


def pack(scratch: Scratch, pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # ids as text: a column of whole numbers with nulls would reach pandas as floats
    pieces = scratch.save(pieces.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("_pid", F.monotonically_increasing_id()), "pieces")
    done = [pieces.where(F.col("length") == capacity).select(*columns, F.col("_pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    waiting = pieces.where(F.col("length") < capacity)
    number = waiting.count()
    for k in range(rounds):
        if not number:
            break
        parts = -(-number // (part << k))
        dealt = waiting.withColumn("_part", F.pmod(F.xxhash64("_pid", F.lit(k)), F.lit(parts)).cast("int"))
        placed = scratch.save(_round(dealt, capacity), f"round-{k}")
        final = k == rounds - 1 or parts == 1
        again = F.lit(False) if final else (F.col("_left") > 0) & ((F.col("_gap") > 0) | (F.col("_left") > SPARE * capacity)) | F.col("_loose")
        done.append(placed.where(~again).select(*columns, "sequence_id", "offset"))
        waiting = placed.where(again).select("_pid", *columns)
        number = 0 if final else waiting.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(Scratch(docs.sparkSession, "packing"), pieces_of(docs, capacity), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
