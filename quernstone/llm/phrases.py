"""Phrase collocations by suffix arrays of word ids.

Texts are read once: each task numbers the words of a language and stores their ids in
shards of a bounded number of tokens, a zero closing each piece. For every length from one
word to the longest, a shard's suffixes are sorted by prefix doubling, and the intervals
of suffixes with so long a common prefix are its phrases and their counts; the counts of
all shards are summed by phrase, and those below ``least`` go.

A phrase can't be more frequent than its parts, so only phrases whose parts may have
passed are counted: the phrases that passed go to all tasks as a bit set of a bounded
size. It may let others through (all of them, once it is full), but never holds one back,
so it saves movement and changes no count.

Defined cases: a null text is empty; a null language is ``und``, one with documents that
say so; an empty text, or one of separators alone, has no words; repeated rows each count;
a text longer than a shard is read piece by piece; an empty table gives an empty result;
further columns are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch

#: What ends a piece, and what parts its words; all else belongs to a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: A byte that no UTF-8 text holds stands for the end of a piece.
_END = b"\xff"
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + PIECE_ENDS, bytes(range(97, 123)) + b" " + _END * len(PIECE_ENDS))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Mining:
    longest: int = 3
    #: occurrences that a phrase must have
    least: int = 10
    #: phrases of a language that are reported
    keep: int = 2000
    #: a phrase goes if a longer one has at least this share (of 100) of its occurrences
    absorbed: int = 50
    #: tokens of a shard, and bytes of a text that are read at once
    shard: int = 1_500_000
    slice: int = 4 << 20
    #: bits of the set of passed phrases: for each, and in all at most
    bits_each: int = 16
    most_bits: int = 1 << 28


SHARD = "lang string, tokens long, words array<string>, ids binary"


class _Numbers(dict):
    """Numbers words from 1 on in order of appearance."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _slices(text: bytes, size: int):
    """Cleaned runs of whole pieces, each of about ``size`` bytes."""
    text = text.translate(_CLEAN)
    at = 0
    while at < len(text):
        cut = text.find(_END, at + size)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut + 1


def shards_of(docs: DataFrame, mining: Mining) -> DataFrame:
    """Word ids of all texts (lang, text), in shards of one language each."""

    def batch_of(held: dict) -> pa.RecordBatch:
        langs, tokens, words, ids = [], [], [], []
        for lang, (numbers, parts) in held.items():
            a = np.concatenate(parts)
            a = a[np.concatenate([a[:1] > 0, (a[1:] > 0) | (a[:-1] > 0)])]  # one zero between pieces
            langs.append(lang)
            tokens.append(int(np.count_nonzero(a)))
            words.append([w for w in numbers if w != _END])
            ids.append(a.tobytes())
        named = pa.array(words, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(tokens, pa.int64()), named, pa.array(ids, pa.binary())], ["lang", "tokens", "words", "ids"])

    def rows(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for part in _slices(text.as_py() or b"", mining.slice):
                    found = part.replace(_END, b" \xff ").split()
                    if not found:
                        continue
                    found.append(_END)
                    numbers, parts = held.setdefault(lang, (_Numbers(), []))
                    parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                    size += len(found)
                    if size >= mining.shard:
                        yield batch_of(held)
                        held, size = {}, 0
        if held:
            yield batch_of(held)

    cleaned = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return cleaned.mapInArrow(rows, SHARD)


def suffix_array(ids: np.ndarray, words: int, live: np.ndarray) -> np.ndarray:
    """The places in ``live``, ordered by the ``words`` ids (or a few more) from there on.

    Ranks by 1, 2, 4, ... ids are derived from each other until a pair of ranks reaches far
    enough; the last pairs are sorted for live places alone."""
    rank, length = ids.astype(np.int64), 1

    def pairs(at: np.ndarray) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[:-length] = rank[length:]
        return rank[at] * (rank.max(initial=0) + 1) + after[at]

    while 2 * length < words:
        key = pairs(np.arange(len(rank)))
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])[: len(key)])
        length *= 2
    return live[np.argsort(pairs(live) if words > 1 else rank[live])]


def intervals(ids: np.ndarray, words: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, occurrences) of each distinct run of ``words`` ids that starts in ``live``."""
    ordered = suffix_array(ids, words, live)
    common = np.ones(max(0, len(ordered) - 1), bool)  # neighbours share so long a prefix
    for k in range(words):
        common &= ids[ordered[1:] + k] == ids[ordered[:-1] + k]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ~common]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _keys(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """A hash for each phrase, from the hashes of its first, second, ... words."""
    key = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang), np.uint64)
    for column in columns:
        key = _mixed(key * _MULTIPLY + column)
    return key


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)


#: bytes of the bit set that travel as one row
_CHUNK = 1 << 16


def bit_set(passed: DataFrame, words: int, mining: Mining) -> np.ndarray:
    """The set of ``passed`` (lang, phrase): two bits a phrase. Each task sets its bits
    first; the driver gets the sum alone, of ``most_bits`` at most."""
    bits = 1 << max(19, (mining.bits_each * passed.count()).bit_length())
    bits = min(bits, mining.most_bits)

    def rows(batches):
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            texts = batch.column("phrase").cast(pa.binary()).to_pylist()
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            columns = [_hashes(c) for c in zip(*(t.split(b" ") for t in texts), strict=True)]
            for lang in set(langs.tolist()):
                at = np.flatnonzero(langs == lang)
                for probe in _probes(_keys(lang, [c[at] for c in columns]), bits):
                    np.bitwise_or.at(mine, (probe >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (probe & np.uint64(7))).astype(np.uint8))
        chunks = mine.reshape(-1, _CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        for k in some.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunks[k].tobytes()], pa.binary())], ["chunk", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        out = np.zeros(_CHUNK, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((bits // 8 // _CHUNK, _CHUNK), np.uint8)
    kind = "chunk int, bits binary"
    for r in passed.select("lang", "phrase").mapInArrow(rows, kind).groupBy("chunk").applyInArrow(joined, kind).collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _in_set(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for probe in _probes(keys, 8 * len(held)):
        found &= (held[(probe >> np.uint64(3)).astype(np.int64)] >> (probe & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def counted(shards: DataFrame, words: int, held: np.ndarray | None, mining: Mining) -> DataFrame:
    """(lang, phrase, n) of all phrases of ``words`` words whose parts may be in ``held``,
    the set of passed phrases that are one word shorter; at least those that pass."""
    spark = shards.sparkSession
    sent = spark.sparkContext.broadcast(held)

    def rows(batches):
        held = sent.value
        for batch in batches:
            for lang, known, ids in zip(batch.column("lang").to_pylist(), batch.column("words"), batch.column("ids"), strict=True):
                ids, known = np.frombuffer(ids.as_py(), np.int32), known.values
                inside = ids > 0
                for k in range(1, words):
                    inside[:-k] &= ids[k:] > 0
                    inside[len(ids) - k :] = False
                if words > 1:
                    # a part may pass, at every place; the two parts of a phrase start one word apart
                    hashes = np.concatenate([np.zeros(1, np.uint64), _hashes(known.cast(pa.binary()).to_pylist())])
                    part = np.zeros(len(ids), bool)
                    at = np.flatnonzero(np.append(ids[: len(ids) - words + 2] > 0, np.zeros(words - 2, bool)))
                    part[at] = _in_set(_keys(lang, [hashes[ids[at + k]] for k in range(words - 1)]), held)
                    inside[:-1] &= part[:-1] & part[1:]
                place, n = intervals(ids, words, np.flatnonzero(inside))
                for low in range(0, len(place), 100_000):
                    some = place[low : low + 100_000]
                    texts = [known.take(pa.array(ids[some + k] - 1)) for k in range(words)]
                    phrase = pc.binary_join_element_wise(*texts, " ") if words > 1 else texts[0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), phrase, pa.array(n[low : low + 100_000])], ["lang", "phrase", "n"])

    # a shard has each phrase once, so summing before the exchange would find next to nothing
    found = shards.select("lang", "words", "ids").mapInArrow(rows, "lang string, phrase string, n long").repartition("lang", "phrase")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= mining.least)


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(passed: DataFrame, mining: Mining) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of ``passed`` (lang, phrase, words,
    n) that no longer one absorbs, each by its lowest-scoring cut."""
    some = passed.where("words > 1").withColumnRenamed("n", "a").withColumn("parts", F.split("phrase", " "))
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("parts"), 1, F.col("k")).alias("head"), _part(F.col("parts"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads = passed.select(F.col("lang").alias("_lang"), F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = passed.select(F.col("lang").alias("_lang"), F.col("phrase").alias("tail"), F.col("n").alias("r"))
    for side, key in ((heads, "head"), (tails, "tail")):
        cuts = cuts.join(side, [cuts["lang"] == side["_lang"], cuts[key] == side[key]]).drop("_lang", key)
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * exact["a"] * exact["a"], exact["l"] * exact["r"]).alias("score"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the phrases inside a longer candidate, with the most occurrences that one of them has
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: _part(F.col("parts"), at, n)))))
    inside = some.where("words > 2").select(F.col("lang").alias("_lang"), spans.alias("_phrase"), "a")
    inside = inside.groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    absorbed = F.col("_most") * 100 >= F.col("a") * mining.absorbed
    joined = best.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    return joined.where(F.coalesce(~absorbed, F.lit(True))).drop("_lang", "_phrase", "_most")


#: parts of a language whose first phrases are found apart
PARTS = 64


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (lang, text)."""
    scratch = Scratch(docs.sparkSession, "phrases")
    shards = scratch.save(shards_of(docs, mining), "shards")
    passed, held = None, None
    for words in range(1, mining.longest + 1):
        level = scratch.save(counted(shards, words, held, mining), f"passed-{words}")
        held = bit_set(level, words, mining) if words < mining.longest else None
        level = level.withColumn("words", F.lit(words))
        passed = level if passed is None else passed.unionByName(level)
    totals = shards.groupBy("lang").agg(F.sum("tokens").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's first ones are first in their part, so a task gets PARTS * keep of them at most
    firsts = scored(passed, mining).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    firsts = firsts.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= mining.keep)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= mining.keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(size)) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE size = 3) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.most IS NULL OR 100 * o.most < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
