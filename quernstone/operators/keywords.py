"""Keyword ranking (BM25) that scores few chunks: postings read in order of impact, and
block maxima.

Chunks are read once; of each only the phrases that queries ask for are kept, with counts,
so one row a chunk is stored and nothing is moved. Chunks are then dealt into shards, and
those of a shard into blocks of neighbours, for which the largest gain of each phrase is
kept. A query reads the lists of its most telling phrases and stops as soon as the others
can't bring up a chunk that it hasn't met; of the chunks it has met only those go on that
can still be among the first k by their blocks' maxima.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quernstone.functions import fixed
from quernstone.functions import text as T
from quernstone.storage import Scratch


@dataclass(frozen=True)
class Blocks:
    #: chunks of a block
    block: int = 16
    #: maxima (phrases x blocks) that a task holds, four bytes each; chunks and postings of
    #: a shard on average
    cells: int = 16_000_000
    chunks: int = 8_000
    postings: int = 1_000_000
    #: neighbouring chunks of one source that stay together
    together: int = 256
    #: chunks whose terms are counted at once
    step: int = 1_000
    #: phrases of queries that are searched at once; more are searched in rounds
    phrases: int = 200_000


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms, times): each word of a query is a phrase of the terms in
    it; one that a query repeats counts as often."""
    word = queries.select("query_id", F.explode(T.words("text")).alias("word")).select("query_id", T.terms("word").alias("_terms"))
    named = word.where(F.size("_terms") > 0).select("query_id", F.array_join("_terms", " ").alias("term"), F.size("_terms").alias("n_terms"))
    return named.groupBy("query_id", "term", "n_terms").agg(F.count("*").alias("times"))


def _counted(chunks: DataFrame, phrases: list[tuple[str, int]], step: int) -> DataFrame:
    """(chunk_id, dl, terms, tfs): of each chunk its length in terms and the numbers and
    counts of the given phrases in it."""
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    sent = chunks.sparkSession.sparkContext.broadcast(phrases)

    def rows(batches):
        by_length: dict[int, tuple[list[str], list[int]]] = {}
        for k, (term, n) in enumerate(sent.value):
            names, numbers = by_length.setdefault(n, ([], []))
            names.append(term)
            numbers.append(k)
        sets = {n: (pa.array(names), np.array(numbers)) for n, (names, numbers) in by_length.items()}
        firsts = {n: pa.array({name.split(" ")[0] for name in names}) for n, (names, _) in by_length.items()}
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            lists = batch.column("terms")
            values, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            lengths = np.diff(np.concatenate([[0], ends]))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            keys = []
            for n, (names, numbers) in sets.items():
                if len(values) < n:
                    continue
                if n == 1:
                    at = pc.index_in(values, value_set=names)
                    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                else:  # only behind the first term of a phrase are terms joined
                    start = pc.is_in(values.slice(0, len(values) - n + 1), value_set=firsts[n])
                    start = np.flatnonzero(start.to_numpy(zero_copy_only=False) & (owner[: len(start)] == owner[n - 1 :]))
                    grams = pc.binary_join_element_wise(*(values.take(pa.array(start + k)) for k in range(n)), " ")
                    at = pc.index_in(grams, value_set=names)
                    found = at.is_valid().to_numpy(zero_copy_only=False)
                    at, hit = at.filter(pa.array(found)), start[found]
                keys.append(owner[hit] * len(sent.value) + numbers[at.drop_null().to_numpy(zero_copy_only=False)])
            key, tf = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_counts=True)
            row, term = key // max(len(sent.value), 1), key % max(len(sent.value), 1)
            offsets = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                ["chunk_id", "dl", "terms", "tfs"],
            )

    # a chunk without a text isn't counted
    listed = chunks.where(F.col("text").isNotNull()).select("chunk_id", T.terms("text").alias("terms"))
    return listed.mapInArrow(rows, f"chunk_id {id_type}, dl bigint, terms array<int>, tfs array<int>")


class Shard:
    """The chunks of one task: a list of postings for each phrase, and block maxima."""

    def __init__(self, dl: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, average: float, phrases: int, blocks: Blocks):
        self.n, self.block = len(dl), blocks.block
        k1, b = fixed.BM25_K1, fixed.BM25_B
        owner = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        order = np.argsort(terms, kind="stable")
        self.owner, tfs = owner[order], tfs[order]
        self.starts = np.searchsorted(terms, np.arange(phrases + 1), sorter=order)
        self.gain = tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * dl / average)[self.owner])
        # rounded up, so a bound is never too low
        self.highest = np.zeros((phrases, -(-self.n // blocks.block)), np.float32)
        np.maximum.at(self.highest, (terms[order], self.owner // blocks.block), np.nextafter(self.gain.astype(np.float32), np.float32(np.inf)))

    def _list(self, term: int) -> slice:
        return slice(self.starts[term], self.starts[term + 1])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(chunks, scores, chunks scored in full): all that can be among the first k.

        Lists are read from that of the largest possible gain on. Sums so far are lower
        bounds of scores, so once the k-th of them exceeds what all other lists can add,
        chunks not seen yet are out. Those seen take up the other lists one by one, as long
        as their sum and what their block can still add reaches the k-th."""
        most = weights * self.highest[terms].max(axis=1, initial=0)
        order = np.argsort(-most, kind="stable")
        terms, weights, most = terms[order], weights[order], most[order]
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]]) * (1 + 1e-9) + 1e-8
        sums, kth, read = np.zeros(self.n), -np.inf, 0
        while read < len(terms):
            here = self._list(terms[read])
            sums[self.owner[here]] += weights[read] * self.gain[here]
            read += 1
            if self.n >= k and sums.max(initial=0) > rest[read]:
                kth = np.partition(sums, self.n - k)[self.n - k]
                if kth > rest[read]:
                    break
        left = (weights[read:] @ self.highest[terms[read:]].astype("f8")) * (1 + 1e-9) + 1e-8
        some = np.flatnonzero(sums > 0)
        some = some[sums[some] + left[some // self.block] >= kth]
        for j in range(read, len(terms)):
            here = self._list(terms[j])
            owner = self.owner[here]
            at = np.searchsorted(owner, some)
            hit = np.flatnonzero(at < len(owner))
            hit = hit[owner[at[hit]] == some[hit]]
            sums[some[hit]] += weights[j] * self.gain[here][at[hit]]
            left -= weights[j] * self.highest[terms[j]]
            if len(some) > k:
                kth = max(kth, np.partition(sums[some], len(some) - k)[len(some) - k])
                some = some[sums[some] + np.maximum(left[some // self.block], 0) + 1e-8 >= kth]
        return some, np.round(sums[some], 9), len(some)


class Keywords:
    """Rankings of all chunks (chunk_id, text) for queries (query_id, text). What is asked
    for is prepared when the first ranking is; it is stored once for all of them."""

    def __init__(self, chunks: DataFrame, queries: DataFrame, blocks: Blocks = Blocks()):
        self.chunks, self.queries, self.blocks = chunks, queries, blocks
        self.scratch = Scratch(chunks.sparkSession, "keywords")
        self.only: DataFrame | None = None
        self._rounds: list | None = None

    def _prepared(self) -> list:
        """For each round of queries (posted, asked with weights, phrases, (chunks, postings),
        average length)."""
        if self._rounds is not None:
            return self._rounds
        asked = self.scratch.save(query_phrases(self.queries), "asked")
        rounds = max(1, -(-asked.count() // self.blocks.phrases))
        self._rounds = []
        for k in range(rounds):
            mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == k)
            phrases = [(r["term"], r["n_terms"]) for r in mine.select("term", "n_terms").distinct().collect()]
            posted = self.scratch.save(_counted(self.chunks, phrases, self.blocks.step), f"posted-{k}")
            n, average, held = posted.agg(F.count("*"), F.avg("dl"), F.sum(F.size("terms"))).first()
            df = posted.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
            numbers = self.scratch.spark.createDataFrame([(t, m, i) for i, (t, m) in enumerate(phrases)], "term string, n_terms int, number int")
            idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weight = F.when(idf <= 0, F.lit(fixed.BM25_LEAST_IDF)).otherwise(idf) * F.col("times")
            weighed = mine.join(F.broadcast(numbers), ["term", "n_terms"]).join(df, "number").select("query_id", "number", weight.alias("weight"))
            self._rounds.append((posted, self.scratch.save(weighed, f"weighed-{k}"), len(phrases), (n, held or 0), average))
        return self._rounds

    def candidates(self, k: int, sources: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, bm25, looked): what can be among the first ``k`` of a
        query, of its shards, and how many chunks were scored for it there."""
        found = None
        for posted, weighed, phrases, counts, average in self._prepared():
            part = self._walked(posted, weighed, phrases, counts, average, k, sources)
            found = part if found is None else found.unionByName(part)
        return found

    def _walked(self, posted, weighed, phrases, counts, average, k, sources) -> DataFrame:
        blocks, spark = self.blocks, self.scratch.spark
        size = min(blocks.chunks, blocks.block * max(1, blocks.cells // max(phrases, 1)))
        shards = max(1, -(-counts[0] // size), -(-counts[1] // blocks.postings))
        lists: dict = {}
        for r in weighed.collect():  # one row a query and phrase: at most ``phrases`` of a round
            lists.setdefault(r["query_id"], []).append((r["number"], r["weight"]))
        asked = {q: (np.array([t for t, _ in x], np.int64), np.array([w for _, w in x])) for q, x in lists.items()}
        sent = spark.sparkContext.broadcast(asked)
        query_type, id_type = (self.queries.schema["query_id"].dataType.simpleString(), self.chunks.schema["chunk_id"].dataType.simpleString())
        schema = f"query_id {query_type}, chunk_id {id_type}, bm25 double, looked bigint"
        names = [c.split()[0] for c in schema.split(", ")]
        query_kind = to_arrow_type(self.queries.schema["query_id"].dataType)
        held = posted.where(F.size("terms") > 0)
        if sources is not None:
            wanted = sources.select(F.col("source").cast("string").alias("_source")).distinct()
            held = held.withColumn("_source", T.chunk_source("chunk_id")).join(wanted, "_source", "left_semi").drop("_source")

        def walk(table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk_id").combine_chunks()
            terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
            shard = Shard(
                table.column("dl").to_numpy(), pc.list_value_length(terms).to_numpy(zero_copy_only=False), terms.flatten().to_numpy(zero_copy_only=False),
                tfs.flatten().to_numpy(zero_copy_only=False), average, phrases, blocks,
            )
            ids, who, which, score, looked = table.column("chunk_id"), [], [], [], []
            for query, (numbers, weights) in sent.value.items():
                chunks, scores, seen = shard.best(numbers, weights, k)
                who += [query] * len(chunks)
                which.append(chunks)
                score.append(scores)
                looked += [seen] * len(chunks)
            taken = ids.take(pa.array(np.concatenate(which or [np.empty(0, np.int64)])))
            columns = [pa.array(who, query_kind), taken, pa.array(np.concatenate(score or [np.empty(0)])), pa.array(looked, pa.int64())]
            return pa.table(dict(zip(names, columns, strict=True)))

        # a source of very many chunks is more than one shard
        key = F.xxhash64(T.chunk_source("chunk_id"), F.floor(T.chunk_number("chunk_id") / blocks.together))
        dealt = held.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int") if shards > 1 else F.lit(0))
        return dealt.groupBy("shard").applyInArrow(walk, schema)

    def within(self, sources: DataFrame) -> DataFrame:
        """(query_id, chunk_id, bm25) of all chunks of each query's own sources (query_id,
        source): these are few, so each is scored."""
        wanted = sources.select("query_id", F.col("source").cast("string").alias("_source")).distinct()
        found = None
        k1, b = fixed.BM25_K1, fixed.BM25_B
        for posted, weighed, _, _, average in self._prepared():
            pairs = posted.withColumn("_source", T.chunk_source("chunk_id")).join(wanted, "_source")
            each = pairs.select("query_id", "chunk_id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("number"), F.col("tfs").alias("tf"))))
            each = each.join(weighed, ["query_id", "number"])
            gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
            part = each.groupBy("query_id", "chunk_id").agg(F.round(F.sum(gain * F.col("weight")), 9).alias("bm25"))
            found = part if found is None else found.unionByName(part)
        return found

    def of(self, only: DataFrame) -> Keywords:
        """The same for some of the queries (query_id)."""
        out = copy.copy(self)
        out.only = only.select("query_id")
        return out

    def best(self, k: int, sources: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, bm25, score) of the first ``k``, score being that of
        the rank alone; with ``sources`` only chunks of the query's sources, or of one list
        for all queries, weighed as among all chunks."""
        own = sources is not None and "query_id" in sources.columns
        found = self.within(sources) if own else self.candidates(k, sources).drop("looked")
        if self.only is not None:
            found = found.join(self.only, "query_id", "left_semi")
        w = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), F.col("chunk_id").asc())
        ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "chunk_id", "bm25", (F.lit(1.0) / (F.col("rank") + fixed.RRF_CONSTANT)).alias("score"))
