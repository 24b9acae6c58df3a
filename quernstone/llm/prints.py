"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once: the high part of its hash names a bin, the low part is a
value, and a bin keeps its smallest value. A bin without shingles takes over the value of
a filled one that it picks for itself, every filled bin being equally likely (optimal
densification): each bin has its own order of all bins, the same in every document, and
takes the first filled one. The low ``bits`` bits of all bins are stored, packed. Of two
bins with different values a share of 2^-bits agrees nevertheless, and the estimate of the
similarity of two sets is corrected for it.

To set a text beside the one that follows it, rows are dealt by ranges of their order with
compressed texts, so each text moves once; the last row of a range meets the first of the
next one in a small step of its own.

Defined cases: a null or empty text, or one without words, has no shingles: its
fingerprint is empty and has a likeness of 1 to one like it and of 0 to others. Fewer
words than a shingle has are one shingle. A null id follows all others; rows with one id
are ordered by their texts' hashes, equal rows in any order; the last row is followed by
the first, a single row by itself. An empty table gives an empty result; further columns
are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, partitions

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Print:
    words: int = 5
    bins: int = 512
    bits: int = 4
    seed: int = 12
    #: rows that a range's bounds are taken from, for each range
    sample: int = 64
    #: bytes of texts, and texts, that are looked at in one step
    step: int = 4 << 20
    step_rows: int = 1_000


@lru_cache(maxsize=2)
def _orders(bins: int, seed: int) -> np.ndarray:
    """Of each bin the place of every other one in its order."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)


class _Hashes(dict):
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


class Printer:
    """Fingerprints of texts, as bytes."""

    def __init__(self, shape: Print = Print()):
        self.shape, self.known = shape, _Hashes()

    def minima(self, texts: list[bytes]) -> np.ndarray:
        """The smallest value of each bin of each text; the largest number where none is."""
        shape = self.shape
        found = [t.lower().split() for t in texts]
        lengths = np.array([len(f) for f in found], np.int64)
        hashes = np.concatenate([np.fromiter(map(self.known.__getitem__, f), np.uint64, len(f)) for f in found] or [np.empty(0, np.uint64)])
        ends = np.cumsum(lengths)
        out = np.full((len(texts), shape.bins), np.iinfo(np.uint64).max, np.uint64)
        # a shingle of full width starts at every word that has enough behind it in its
        # text; a text of fewer words is one shingle
        owner = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(hashes)) - np.repeat(ends - lengths, lengths)
        width = np.minimum(lengths, shape.words)
        starts = np.flatnonzero(place <= (lengths - width)[owner])
        of = owner[starts]
        key = width[of].astype(np.uint64)
        for k in range(shape.words):
            go = k < width[of]
            key[go] = key[go] * _MULTIPLY + hashes[starts[go] + k]
        key = _mixed(key)
        bins = ((key >> np.uint64(32)) * np.uint64(shape.bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out.reshape(-1), of * shape.bins + bins, _mixed(key ^ np.uint64(shape.seed)))
        return out

    def dense(self, least: np.ndarray) -> np.ndarray:
        """``least`` with the empty bins of every text that has a filled one filled."""
        orders = _orders(self.shape.bins, self.shape.seed)
        empty = least == np.iinfo(np.uint64).max
        for row in np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1)).tolist():
            wanting, filled = np.flatnonzero(empty[row]), np.flatnonzero(~empty[row])
            least[row, wanting] = least[row, filled[orders[np.ix_(wanting, filled)].argmin(axis=1)]]
        return least

    def prints(self, texts: list[bytes]) -> list[bytes]:
        """Packed low bits of all bins; nothing for a text without shingles."""
        if not texts:
            return []
        least = self.minima(texts)
        bare = (least == np.iinfo(np.uint64).max).all(axis=1)
        low = (self.dense(least) & np.uint64((1 << self.shape.bits) - 1)).astype(np.uint8)[:, :, None] >> np.arange(self.shape.bits, dtype=np.uint8) & 1
        packed = np.packbits(low.reshape(len(texts), -1), axis=1)
        return [b"" if none else row.tobytes() for row, none in zip(packed, bare.tolist(), strict=True)]


def likeness(first: list[bytes], second: list[bytes], shape: Print = Print()) -> list[float]:
    """The estimated similarity of each two sets whose fingerprints are given."""
    out = [float(a == b) for a, b in zip(first, second, strict=True)]
    at = [k for k, (a, b) in enumerate(zip(first, second, strict=True)) if a and b]
    if at:
        a, b = (np.unpackbits(np.frombuffer(b"".join(x[k] for k in at), np.uint8)).reshape(len(at), shape.bins, shape.bits) for x in (first, second))
        agree = (a == b).all(axis=2).mean(axis=1)
        chance = 2.0**-shape.bits
        for k, value in zip(at, np.clip((agree - chance) / (1 - chance), 0, 1).tolist(), strict=True):
            out[k] = value
    return out


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _bounds(scratch: Scratch, keys: DataFrame, shape: Print) -> list[tuple]:
    """Keys that part the rows into ranges of about equal size, from a sample of bounded
    size. They decide where a row is worked on, not what comes out."""
    n, parts = keys.count(), partitions(scratch.spark)
    share = min(1.0, shape.sample * parts / max(n, 1))
    some = sorted(_key(r) for r in (keys.sample(share, shape.seed) if share < 1 else keys).collect())
    return [some[len(some) * k // parts] for k in range(1, parts)] if some else []


def _key(row) -> tuple:
    """The place of a row in the whole order: ids, nulls last, then text hashes, then the
    running number that parts equal rows."""
    return (row[0] is None, 0 if row[0] is None else row[0], row[1], row[2])


def _steps(rows, shape: Print, bytes_of=len):
    """Lists of rows whose texts (the last field) are as many as a step takes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += bytes_of(row[-1])
        if total >= shape.step or len(held) >= shape.step_rows:
            yield held
            held, total = [], 0
    if held:
        yield held


def with_next(docs: DataFrame, shape: Print = Print()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of ``docs`` (doc_id, text): each text's fingerprint beside that of its edit
    by the next document, and the estimated likeness to the edit and to the next text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "prints")
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("mark"), "turn", F.col("text").cast("binary").alias("text"))
    bounds = _bounds(scratch, keyed.select("doc_id", "mark", "turn"), shape)
    parts = partitions(spark)
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        printer, packer = Printer(shape), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            rows = zip(range(len(ids)), ids.to_pylist(), batch.column("mark").to_pylist(), batch.column("turn").to_pylist(), (t.as_py() for t in batch.column("text")), strict=True)
            for some in _steps(rows, shape):
                at, docs_, marks, turns, texts = (list(c) for c in zip(*some, strict=True))
                ranges = [bisect.bisect_right(bounds, _key(k)) for k in zip(docs_, marks, turns, strict=True)]
                columns = [pa.array(ranges, pa.int32()), ids.take(pa.array(at)), pa.array(marks), pa.array(turns), pa.array(printer.prints(texts), pa.binary()), pa.array([packer.compress(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "doc_id", "mark", "turn", "print", "body"])

    dealt = keyed.mapInArrow(deal, f"range int, doc_id {id_type}, mark long, turn long, print binary, body binary")
    ordered = dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "mark", "turn")
    result = f"doc_id {id_type}, n_chars long, edited_sha256 string, print binary, edited binary, near_edited double, near_next double"
    names = [c.split()[0] for c in result.split(", ")]

    def compared(printer: Printer, ids: pa.Array, texts: list[str], after: list[str], prints: list[bytes], next_prints: list[bytes]) -> list[pa.Array]:
        changed = [edited(x, y).encode() for x, y in zip(texts, after, strict=True)]
        new = printer.prints(changed)
        return [
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(prints, pa.binary()), pa.array(new, pa.binary()),
            pa.array(likeness(prints, new, shape)), pa.array(likeness(prints, next_prints, shape)),
        ]

    edge = [f"{c} {t}" for c, t in (("range", "int"), ("first", "boolean"), ("body", "binary"))]

    def follow(batches):
        """Each row but the last beside the next one; the first and the last row of the
        range also as they are, with their texts."""
        printer, unpacker = Printer(shape), zstandard.ZstdDecompressor()

        def bare(range_, id_, print_, body, first):
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string())]
            rest = [pa.array([print_], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
            return pa.RecordBatch.from_arrays([id_, *none, *rest, pa.array([range_], pa.int32()), pa.array([first]), pa.array([body], pa.binary())], [*names, "range", "first", "body"])

        last = None  # (range, id, print, body) of the row that still waits for the next one
        for batch in batches:
            ids = batch.column("doc_id")
            rows = zip(batch.column("range").to_pylist(), range(len(ids)), batch.column("print").to_pylist(), (b.as_py() for b in batch.column("body")), strict=True)
            for some in _steps(rows, shape, zstandard.frame_content_size):
                some = [(r, ids.slice(k, 1), p, b) for r, k, p, b in some]
                if last is None or last[0] != some[0][0]:
                    if last is not None:
                        yield bare(*last, False)
                    yield bare(*some[0], True)
                else:
                    some = [last, *some]
                texts = [unpacker.decompress(row[3]).decode() for row in some]
                for k in range(1, len(some)):
                    if some[k][0] != some[k - 1][0]:  # two ranges in one partition
                        yield bare(*some[k - 1], False)
                        yield bare(*some[k], True)
                pairs = [k for k in range(len(some) - 1) if some[k][0] == some[k + 1][0]]
                if pairs:
                    columns = compared(printer, pa.concat_arrays([some[k][1] for k in pairs]), [texts[k] for k in pairs], [texts[k + 1] for k in pairs], [some[k][2] for k in pairs], [some[k + 1][2] for k in pairs])
                    n = len(pairs)
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], [*names, "range", "first", "body"])
                last = some[-1]
        if last is not None:
            yield bare(*last, False)

    made = scratch.save(ordered.mapInArrow(follow, ", ".join([result, *edge])), "made")
    firsts = made.where("first").select(F.col("range").alias("at"), F.col("print").alias("next_print"), F.col("body").alias("next_body"))
    # one row a range: the ranges that have rows, each with the one that follows it
    whole = Window.orderBy("at")
    turns = firsts.select("at").withColumn("before", F.coalesce(F.lag("at").over(whole), F.max("at").over(Window.partitionBy())))
    lasts = made.where("NOT first").select("range", "doc_id", "print", "body")
    edges = lasts.join(turns, F.col("range") == F.col("before")).join(firsts, "at")

    def meet(batches):
        printer, unpacker = Printer(shape), zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                texts = [unpacker.decompress(one.column(c)[0].as_py()).decode() for c in ("body", "next_body")]
                yield pa.RecordBatch.from_arrays(compared(printer, one.column("doc_id"), texts[:1], texts[1:], one.column("print").to_pylist(), one.column("next_print").to_pylist()), names)

    met = edges.select("doc_id", "print", "body", "next_print", "next_body").mapInArrow(meet, result)
    both = made.where("first IS NULL").select(*names).unionByName(met)
    return both.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next")


def op12_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
