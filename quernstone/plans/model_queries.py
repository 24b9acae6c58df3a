"""Queries whose vectors and scores come from texts, through the slots for models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quernstone import models
from quernstone.functions import text as T
from quernstone.operators import chunking
from quernstone.operators import retrieval as R
from quernstone.plans import common as C
from quernstone.plans.registry import register
from quernstone.session import table

DIM = 64


def _embedder() -> models.Embedder:
    return models.HashingEmbedder(DIM)


def _named(name: str, rows: str) -> str:
    """(id, v): hashed vectors of ``rows`` (id, text) as SQL."""
    return f"""
{name}_terms AS (
  SELECT id, unnest(({C.TOKENS.format('text')})[1:{models.TOKENS}]) AS t FROM ({rows})
), {name}_slots AS (
  SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS slot, sum(CASE WHEN substr(md5(t), 9, 1) >= '8' THEN -1 ELSE 1 END)::DOUBLE AS x FROM {name}_terms GROUP BY ALL
), {name}_norms AS (
  SELECT id, sqrt(sum(x * x)) AS norm FROM {name}_slots GROUP BY id
), {name} AS MATERIALIZED (
  SELECT r.id, list(coalesce(s.x, 0.0) / CASE WHEN coalesce(n.norm, 0.0) > 0 THEN n.norm ELSE 1.0 END ORDER BY d.slot) AS v
  FROM ({rows}) r CROSS JOIN range({DIM}) d(slot) LEFT JOIN {name}_slots s ON s.id = r.id AND s.slot = d.slot LEFT JOIN {name}_norms n ON n.id = r.id
  WHERE r.text IS NOT NULL GROUP BY r.id
)"""


def _near(name: str, rows: str, asked: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l2, id) AS rank FROM (SELECT a.id AS query_id, r.id, {C.L2.format('r.v', 'a.v')} AS l2 FROM {rows} r, {asked} a)
)"""


_ASKED = _named("asked_text", "SELECT query_id AS id, text FROM queries")
_CHUNK_VECTORS = _named("chunk_text", "SELECT chunk_id AS id, text FROM chunk_rows")


def _asked(spark, sf_dir):
    """(query_id, embedding): the benchmark items, embedded."""
    return models.embedded(C.queries(spark, sf_dir), "text", _embedder, DIM).select("query_id", "embedding").where("embedding IS NOT NULL")


def _chunk_vectors(spark, sf_dir):
    return models.embedded(C.chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "text"), "text", _embedder, DIM).select("id", "embedding").where("embedding IS NOT NULL")


@register("emb1_text_vectors", f"""
WITH {_named('docs', 'SELECT doc_id AS id, text FROM documents')}
SELECT id AS doc_id, list_transform(v, lambda x: round(x, 9)) AS embedding FROM docs
""")
def emb1(spark, sf_dir):
    """Vectors of all documents."""
    made = models.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _embedder, DIM)
    return made.select("doc_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@register("ret2_text_vectors", f"WITH {C.CHUNKS_SQL}, {C.QUERIES_SQL}, {_ASKED}, {_CHUNK_VECTORS}, {_near('near', 'chunk_text', 'asked_text')} SELECT query_id, rank, id, l2 FROM near WHERE rank <= 7")
def ret2_text(spark, sf_dir):
    """RET2 on vectors computed from the chunks' and the queries' texts."""
    return R.vector_topk(_chunk_vectors(spark, sf_dir), _asked(spark, sf_dir), 7).select("query_id", "rank", "id", "l2")


@register("ret4_text_hybrid", f"""
WITH {C.CHUNKS_SQL}, {C.QUERIES_SQL}, {C.BM25_SQL}, {_ASKED}, {_CHUNK_VECTORS}, {_near('near', 'chunk_text', 'asked_text')}, {C.words_sql('words')}, {C.fused_sql('fused', 'words', 'near', 7)}
SELECT query_id, rank, id AS chunk_id, score FROM fused
""")
def ret4_text(spark, sf_dir):
    """RET4 with a vector leg from texts."""
    chunks = C.chunks(spark, sf_dir)
    return R.hybrid(R.Keywords(chunks, C.queries(spark, sf_dir)), _chunk_vectors(spark, sf_dir), _asked(spark, sf_dir), 7)



@register("ret5_text_summaries", f"""
WITH {C.QUERIES_SQL}, {_ASKED}, {_named('summary', 'SELECT doc_id AS id, left(text, 120) AS text FROM documents')}, {_near('near', 'summary', 'asked_text')}
SELECT query_id, rank, id AS source, l2 FROM near WHERE rank <= 5
""")
def ret5_text(spark, sf_dir):
    """The five documents whose openings, standing for their summaries, are nearest."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(120)).alias("text"))
    vectors = models.embedded(docs, "text", _embedder, DIM).select("id", "embedding").where("embedding IS NOT NULL")
    return R.vector_topk(vectors, _asked(spark, sf_dir), 5).select("query_id", "rank", F.col("id").alias("source"), "l2")


@register("mt3_token_pooling", f"""
WITH t AS (SELECT doc_id, ts, unnest(ts) AS t FROM (SELECT doc_id, list_filter(({C.TOKENS.format('text')})[1:{models.TOKENS}], lambda x: length(x) > 2) AS ts FROM documents)),
s AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS slot, sum(CASE WHEN substr(md5(t), 9, 1) >= '8' THEN -1 ELSE 1 END) / len(any_value(ts))::DOUBLE AS x FROM t GROUP BY doc_id, 2)
SELECT d.doc_id, list(round(coalesce(s.x, 0.0), 9) ORDER BY r.slot) AS mean FROM documents d CROSS JOIN range({DIM}) r(slot) LEFT JOIN s ON s.doc_id = d.doc_id AND s.slot = r.slot GROUP BY d.doc_id
""")
def mt3_tokens(spark, sf_dir):
    """Token vectors of the first 512 terms pooled over a mask: terms of three letters or more."""

    @F.pandas_udf("array<double>")
    def mean(texts: pd.Series) -> pd.Series:
        model = _embedder()
        out = []
        for text in texts:
            terms = models.terms_of(text or "")[: models.TOKENS]
            out.append(models.pooled(model.tokens(" ".join(terms)), pd.Series([len(t) > 2 for t in terms], dtype=int).to_numpy()))
        return pd.Series(out, dtype=object)

    return table(spark, sf_dir, "documents").select("doc_id", F.transform(mean("text"), lambda x: F.round(x, 9)).alias("mean"))


class _Moody(models.LexicalReranker):
    """A model that fails for every third length of a question."""

    def score(self, pairs):
        if pairs and len(pairs[0][0]) % 3 == 0:
            raise models.Unavailable(pairs[0][0])
        return super().score(pairs)


def _reranked(fails: str) -> str:
    """Reranking as SQL: where ``fails`` holds, and for a single candidate, the old order."""
    return f"""
WITH {C.CHUNKS_SQL}, {C.QUERIES_SQL}, {C.BM25_SQL}, {C.words_sql('words')}, s AS (
  SELECT f.query_id, f.rank AS old_rank, f.id, count(*) OVER (PARTITION BY f.query_id) AS n, {fails} AS fails,
         len(list_filter(list_distinct({C.TOKENS.format('q.text')}), lambda x: list_contains({C.TOKENS.format('c.text')}, x))) / greatest(len(list_distinct({C.TOKENS.format('q.text')})), 1)
         + ([0.3, 0.25, 0.15, 0.1, 0.05, 0.0])[(c.source % 6 + 1)::INT]::DOUBLE AS value
  FROM words f JOIN chunk_rows c ON f.id = c.chunk_id JOIN queries q USING (query_id) WHERE f.rank <= 30
)
SELECT query_id, rank, id AS chunk_id, rerank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old_rank) AS rank FROM (SELECT *, round(CASE WHEN n <= 1 OR fails THEN -old_rank ELSE value END, 9) AS rerank_score FROM s)
) WHERE rank <= 7
"""


def _by_model(spark, sf_dir, load):
    found = R.keyword_topk(C.chunks(spark, sf_dir), C.queries(spark, sf_dir), 30)
    return R.rescored_by_model(found, C.chunks(spark, sf_dir), C.queries(spark, sf_dir), load, 7)


@register("ret9_model_rerank", _reranked("false"))
def ret9_model(spark, sf_dir):
    """RET9 with the scores of a model that is loaded once a worker: 30 candidates to 7."""
    return _by_model(spark, sf_dir, models.LexicalReranker)


@register("ret9_failing_model", _reranked("length(q.text) % 3 = 0"))
def ret9_failing(spark, sf_dir):
    """A model that fails for some queries: these keep their order, without bonus."""
    return _by_model(spark, sf_dir, _Moody)


@register("ret9_without_model", _reranked("true"))
def ret9_without(spark, sf_dir):
    """A model that can't be loaded: every query keeps its order."""
    return _by_model(spark, sf_dir, _missing)


def _missing() -> models.Reranker:
    raise models.Unavailable("no model file")


models.chunker("characters")(chunking.char_windows)
models.chunker("words")(chunking.word_windows)
models.chunker("lines")(lambda text: F.filter(F.split(text, "\n"), lambda line: T.trimmed(line) != ""))


@register("chk_registry", f"""
WITH {C.CHUNKS_SQL}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE lang = 'de'),
p AS (SELECT doc_id, k, array_to_string(w[450 * k + 1 : 450 * k + 500], ' ') AS t FROM (SELECT *, unnest(range(0, CASE WHEN len(w) <= 500 THEN 1 ELSE ceil((len(w) - 500) / 450)::INT + 1 END)) AS k FROM w))
SELECT source, chunk_idx, md5(text) AS sum FROM chunk_rows WHERE source NOT IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr'))
UNION ALL SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT, md5(t) FROM p WHERE t <> ''
UNION ALL SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INT, md5(unnest(ls)) FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '') AS ls FROM documents WHERE lang = 'fr')
""")
def chk_registry(spark, sf_dir):
    """Each document by the chunker that its language names: German by words, French by
    lines, others by characters."""
    kind = F.when(F.col("lang") == "de", "words").when(F.col("lang") == "fr", "lines")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text", "lang")
    out = chunking.chunked(docs, models.chunks_by(kind, F.col("text"), "characters"), most=None)
    return out.select("source", "chunk_idx", F.md5("chunk").alias("sum"))
