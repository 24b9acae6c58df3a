"""Training-order materialisation of token ids.

Documents become token sequences of a fixed length, each numbered in reading order. A
keyed Feistel permutation with cycle-walking maps the numbers 0..M-1 onto places; places
are range-partitioned into shards of records of a fixed stride, in order of their place.
A sequence's slot is the number of sequences before it in that order, so the record of any
slot is found by arithmetic from the shards' lengths, and reading resumes at any slot.

Numbers need no shuffle and no tokens: a token has at least one byte, so the lengths of
the texts bound the sequences of each partition of the scan, and the bounds give every
partition a range of numbers. M is the sum of the bounds; places that stay empty take no
room. The second pass checks that it saw what the first one did. In the shuffle, a task's
records of one shard travel as one compressed block. Shards are written by Spark's text
sink, the trailer of a record being the sink's line separator, so they reach any file
system that Spark reaches.

A record: place and document id (signed 64 bit), piece and length (unsigned 32 bit), ids
(unsigned 16 bit, padded with the end id), trailer (4 bytes), all little-endian.

Defined cases: a null or empty text is the end id alone; a null id is written as -2^63;
repeated rows are sequences of their own; an empty table makes no shard; further columns
are left out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch
from quernstone.llm.tokens import encoder

TRAILER = b"QNS\n"
NO_ID = -(2**63)


@dataclass(frozen=True)
class Layout:
    tokens: int = 256
    #: places of a shard; two in five or so are taken (about 14 MB at 256 tokens)
    places: int = 65_536
    key: int = 0x5EED
    rounds: int = 6

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([("place", "<i8"), ("doc_id", "<i8"), ("piece", "<u4"), ("length", "<u4"), ("ids", "<u2", (self.tokens,)), ("trailer", "S4")])


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1, given by ``key``. Values that leave the range walk on
    until they are back in it."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Ranges:
    """Of each partition of the scan: its first number, its rows and the bound of its
    sequences. Three arrays, 24 bytes a partition."""

    def __init__(self, rows: list):
        size = max((r["partition"] for r in rows), default=-1) + 1
        self.rows, self.most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in rows:
            self.rows[r["partition"]], self.most[r["partition"]] = r["rows"], r["most"]
        self.start = np.cumsum(self.most) - self.most
        self.total = int(self.most.sum())

    def of(self, partition: int) -> tuple[int, int, int]:
        if partition >= len(self.rows):
            return 0, 0, 0
        return int(self.start[partition]), int(self.rows[partition]), int(self.most[partition])


def _ranges(docs: DataFrame, layout: Layout) -> Ranges:
    most = F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + layout.tokens) / layout.tokens)
    per = docs.select(F.spark_partition_id().alias("partition"), most.alias("most")).groupBy("partition").agg(F.count("*").alias("rows"), F.sum("most").alias("most"))
    return Ranges(per.collect())


CHANGED = "the scan gave other rows than when it was measured"


def _blocks(docs: DataFrame, ranges: Ranges, layout: Layout, held_bytes: int = 32 << 20) -> DataFrame:
    """(shard, block): compressed records of a task for one shard."""
    sent, total, kind = docs.sparkSession.sparkContext.broadcast(ranges), ranges.total, layout.dtype

    def rows(batches):
        encode, packer = encoder().document, zstandard.ZstdCompressor(level=3)
        start, *expected = sent.value.of(TaskContext.get().partitionId())
        number, seen, held, waiting = 0, [0, 0], [], 0

        def send(records: np.ndarray) -> pd.DataFrame:
            first = start + number - len(records)
            records["place"] = feistel(np.arange(first, first + len(records)), total, layout.key, layout.rounds)
            records["trailer"] = TRAILER
            records = records[np.argsort(records["place"])]
            shard = records["place"] // layout.places
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            return pd.DataFrame({"shard": shard[cuts].astype(np.int32), "block": [packer.compress(p.tobytes()) for p in np.split(records, cuts[1:])]})

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.frombuffer(encode(text), "<u4")
                n = -(-len(ids) // layout.tokens)
                made = np.zeros(n, kind)
                padded = np.zeros(n * layout.tokens, "<u2")
                padded[: len(ids)] = ids
                made["ids"] = padded.reshape(n, -1)
                made["doc_id"] = NO_ID if doc is None else int(doc)
                made["piece"] = np.arange(n)
                made["length"] = layout.tokens
                made["length"][-1] = len(ids) - (n - 1) * layout.tokens
                held.append(made)
                number += n
                waiting += made.nbytes
                seen[0] += 1
                seen[1] += (len((text or "").encode()) + layout.tokens) // layout.tokens
                if waiting >= held_bytes:
                    yield send(np.concatenate(held))
                    held, waiting = [], 0
        if held:
            yield send(np.concatenate(held))
        if seen != expected:
            raise RuntimeError(CHANGED)

    # ids as text: a column of whole numbers with nulls would reach pandas as floats
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(rows, "shard int, block binary")


def write_shards(docs: DataFrame, path: str, layout: Layout = Layout(), tries: int = 3) -> bool:
    """Writes all sequences of ``docs`` (doc_id, text), a table whose scan gives the same
    rows each time. False if there are none.

    How a scan is parted can follow the number of executors. If one goes or comes between
    the two passes, the second notices other rows in its partitions, and both are run again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for left in reversed(range(tries)):
        try:
            return _write(docs, path, layout)
        except (PySparkException, Py4JJavaError) as error:
            if not left or CHANGED not in str(error):
                raise
    return False


def _write(docs: DataFrame, path: str, layout: Layout) -> bool:
    ranges = _ranges(docs, layout)
    if not ranges.total:
        return False

    def rows(batches):
        unpacker, kind = zstandard.ZstdDecompressor(), layout.dtype
        parts = [np.frombuffer(unpacker.decompress(b), kind) for batch in batches for b in batch["block"]]
        if not parts:
            return
        records = np.concatenate(parts)
        del parts
        records = records[np.argsort(records["place"])]
        width = kind.itemsize - len(TRAILER)
        for at in range(0, len(records), 4096):
            some = records[at : at + 4096].tobytes()
            yield pd.DataFrame({"record": [some[k : k + width] for k in range(0, len(some), kind.itemsize)]})

    shards = -(-ranges.total // layout.places)
    placed = _blocks(docs, ranges, layout).repartitionById(shards, F.col("shard")).mapInPandas(rows, "record binary")
    placed.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", TRAILER.decode()).text(path)
    return True


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.withColumn("shard", F.regexp_extract("path", r"part-(\d+)", 1).cast("int"))


def shard_starts(spark: SparkSession, path: str, layout: Layout = Layout()) -> dict[int, tuple[int, int]]:
    """First slot and records of each shard, from the lengths of the files."""
    starts, at = {}, 0
    for shard, length in sorted(map(tuple, _files(spark, path).select("shard", "length").collect())):
        starts[shard] = (at, length // layout.dtype.itemsize)
        at += length // layout.dtype.itemsize
    return starts


SEQUENCE = "slot long, shard int, doc_id long, piece long, length long, ids binary"


def read_shards(spark: SparkSession, path: str, layout: Layout = Layout(), start: int = 0) -> DataFrame:
    """Sequences from slot ``start`` on, ids as unsigned 16-bit numbers. Shards before it
    aren't opened; within a shard the place of a slot is its distance times the stride."""
    starts = shard_starts(spark, path, layout)
    first_shard = max((s for s, (at, _) in starts.items() if at <= start), default=0)

    def rows(batches):
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"], strict=True):
                slot, n = starts[shard]
                skip = min(max(0, start - slot), n)
                records = np.frombuffer(content, layout.dtype, offset=skip * layout.dtype.itemsize)
                if (records["trailer"] != TRAILER).any() or (np.diff(records["place"]) <= 0).any() or (records["place"] // layout.places != shard).any():
                    raise ValueError(f"shard {shard} is damaged")
                for at in range(0, len(records), 8192):
                    r = records[at : at + 8192]
                    doc = pd.Series(r["doc_id"].astype("i8")).astype("Int64")
                    ids = [x[:n].tobytes() for x, n in zip(r["ids"], r["length"].tolist(), strict=True)]
                    slots = np.arange(len(r)) + slot + skip + at
                    yield pd.DataFrame({"slot": slots, "shard": shard, "doc_id": doc.mask(doc == NO_ID), "piece": r["piece"].astype("i8"), "length": r["length"].astype("i8"), "ids": ids})

    files = _files(spark, path).where(F.col("shard") >= first_shard).select("shard", "content")
    return files.mapInPandas(rows, SEQUENCE)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, shard, doc_id, piece, length, ids_crc32) of every sequence, read back."""
    scratch = Scratch(spark, "shards")
    if not write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("shards")):
        return spark.createDataFrame([], "slot long, shard int, doc_id long, piece long, length long, ids_crc32 long")
    back = read_shards(spark, scratch.path("shards"))
    return back.select("slot", "shard", "doc_id", "piece", "length", F.crc32("ids").alias("ids_crc32"))
