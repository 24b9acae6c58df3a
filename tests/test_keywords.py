"""Keyword ranking by blocks against the whole scored table, and the slots for models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone import models
from quernstone.operators import keywords, retrieval
from quernstone.plans import common as C


def first(frame, k):
    """The first k of a scored table."""
    out = {}
    for r in frame.select("query_id", "chunk_id", "bm25").collect():
        out.setdefault(r["query_id"], []).append((-r["bm25"], r["chunk_id"]))
    return {q: sorted(x)[:k] for q, x in out.items()}


@pytest.mark.parametrize("blocks", [keywords.Blocks(), keywords.Blocks(block=2, cells=600), keywords.Blocks(block=4, chunks=40, phrases=60)])
def test_same_as_all_scores(spark, sf_dir, blocks):
    """Also in many shards, and with queries in several rounds."""
    chunks, queries = C.chunks(spark, sf_dir), C.queries(spark, sf_dir)
    made = keywords.Keywords(chunks, queries, blocks)
    whole = retrieval.bm25(chunks, queries)
    for k in (1, 7):
        assert first(made.best(k), k) == first(whole, k)
    # ranks are complete and in order
    ranks = {}
    for r in made.best(3).collect():
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert ranks and all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())


def test_few_chunks_are_scored(spark):
    chunks, queries = C.chunks(spark, "/root/testdata/sf0.01"), C.queries(spark, "/root/testdata/sf0.01")
    made = keywords.Keywords(chunks, queries)
    looked = made.candidates(7).groupBy("query_id").agg(F.max("looked").alias("n"))
    total = retrieval.bm25(chunks, queries).count()
    assert looked.agg(F.sum("n")).first()[0] < 0.1 * total


def test_sources(spark):
    rows = [(f"{s}#{k}", f"fire wall {'fire ' * k} of {s}") for s in "abc" for k in range(4)] + [("d#0", None), ("e#0", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([("x", "fire"), ("y", "fire-wall of"), ("z", "none of it?"), ("w", None)], "query_id string, text string")
    made, whole = keywords.Keywords(chunks, queries), retrieval.bm25(chunks, queries)
    own = spark.createDataFrame([("x", "a"), ("y", "b"), ("y", "c")], "query_id string, source string")
    for sources in (own, own.select("source").where("source <> 'c'"), None):
        got = made.best(3, sources).orderBy("query_id", "rank").collect()
        want = retrieval.keyword_best(whole, 3, sources).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want] and got
    assert {r["query_id"] for r in made.of(spark.createDataFrame([("y",)], "query_id string")).best(2).collect()} == {"y"}
    nothing = keywords.Keywords(chunks.limit(0), queries)
    assert nothing.best(3).collect() == [] and keywords.Keywords(chunks, queries.limit(0)).best(3).collect() == []


def test_embedders(spark):
    # models are sent to workers by value, as these can't import the tests
    class Wrong:
        """A model whose rows have another length."""

        def encode(self, texts):
            return np.ones((len(texts), 3))

    class Choosy:
        """A model that fails for batches with a certain text."""

        def encode(self, texts):
            if "bad" in texts:
                raise ValueError
            return np.full((len(texts), 4), float(len(texts)))

    def absent():
        raise models.Unavailable

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "b a", "", None, "a a b", "bad", "ü ö", "a"])], "k int, text string").coalesce(1)
    made = {r["k"]: r["embedding"] for r in models.embedded(rows, "text", models.HashingEmbedder, 64).collect()}
    assert made[0] == made[1] != made[4] and made[3] is None and set(made[2]) == {0.0}
    assert all(abs(sum(x * x for x in made[k]) - 1) < 1e-12 for k in (0, 4, 6))
    for load in (Wrong, absent):
        assert {r["embedding"] for r in models.embedded(rows, "text", load, 4).collect()} == {None}
    some = {r["k"]: r["embedding"] for r in models.embedded(rows, "text", Choosy, 4, batch=3).collect()}
    assert some[0] == [3.0] * 4 and some[7] == [1.0] * 4 and some[3] is some[4] is some[5] is None
    long_ = models.HashingEmbedder(64).encode([" ".join(f"w{k}" for k in range(2000)), " ".join(f"w{k}" for k in range(models.TOKENS))])
    assert (long_[0] == long_[1]).all()


def test_pooling():
    x = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    assert models.pooled(x, np.array([1, 0, 1])).tolist() == [3.0, 4.0] and models.pooled(x, np.zeros(3)).tolist() == [0.0, 0.0]


def test_rerankers(spark):
    class Short:
        def score(self, pairs):
            return [1.0] * (len(pairs) - 1) if len(pairs) > 1 else [float("nan")]

    def absent():
        raise models.Unavailable

    rows = [("q", k, f"c{k}", f"text {k}", "find text 2") for k in range(1, 4)] + [("p", 1, "c1", None, "find")]
    found = spark.createDataFrame(rows, "query_id string, rank long, chunk_id string, text string, ask string")
    scored = lambda load: {(r["query_id"], r["chunk_id"]): r["m"] for r in models.scored_pairs(found, load, "ask", "text", "query_id", "chunk_id", "m").collect()}
    made = scored(models.LexicalReranker)
    assert made["q", "c2"] == pytest.approx(2 / 3) and made["q", "c1"] == pytest.approx(1 / 3) and made["p", "c1"] == 0
    assert set(scored(Short).values()) == set(scored(absent).values()) == {None}
    with pytest.raises(KeyError):
        models.chunks_by(F.lit("x"), F.lit("y"), "no such chunker")


def test_vectors_are_computed_once(spark):
    """A filter on the vectors doesn't compute them a second time below them."""
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    plan = models.embedded(rows, "text", models.HashingEmbedder, 64).where("embedding IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_shard_is_small(spark):
    """Bytes that building one takes for each posting, and long texts in shards of their own."""
    import tracemalloc

    rng = np.random.default_rng(4)
    lengths = np.full(5_000, 60)
    terms, tfs = rng.integers(0, 900, lengths.sum()).astype(np.int32), np.ones(lengths.sum(), np.int32)
    tracemalloc.start()
    keywords.Shard(np.full(5_000, 150), lengths, terms, tfs, 150.0, 900, keywords.Blocks())
    assert tracemalloc.get_traced_memory()[1] < 52 * len(terms)
    tracemalloc.stop()
    rows = [(f"a#{k}", " ".join(f"w{(k * j) % 30}" for j in range(k))) for k in range(60)] + [("b", "w1 w2")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([("x", " ".join(f"w{j}" for j in range(30))), ("y", "w1-w2 w7")], "query_id string, text string")
    made, whole = keywords.Keywords(chunks, queries, keywords.Blocks(block=2, postings=40, together=4, step=7)), retrieval.bm25(chunks, queries)
    found = made.candidates(3)
    assert first(made.best(3), 3) == first(whole, 3)
    # one source, several shards: of each come the first three
    assert found.where("query_id = 'x'").count() > 10
