"""Views of the driver's tables as the engine's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import chunking
from quernstone.session import table

CHUNKS_PER_SOURCE = 4

def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, source, chunk_idx, text) of documents by character windows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    out = chunking.chunked(docs, chunking.char_windows(F.col("text")), most=None)
    return out.select("chunk_id", "source", "chunk_idx", F.col("chunk").alias("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): every benchmark item, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, embedding): each four vectors in a row are chunks of one source."""
    source, idx = F.floor(F.col("vec_id") / CHUNKS_PER_SOURCE).cast("string"), (F.col("vec_id") % CHUNKS_PER_SOURCE).cast("string")
    return table(spark, sf_dir, "embeddings").select(F.concat(source, F.lit("#"), idx).alias("id"), source.alias("source"), "embedding")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding): a source's mean vector, under the source."""
    parts = vectors(spark, sf_dir).select("source", F.posexplode("embedding").alias("k", "x"))
    mean = parts.groupBy("source", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    return whole.select(F.col("source").alias("id"), F.transform("v", lambda p: p["x"]).alias("embedding"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding): the vector of the same number as each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, sf_dir, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def defining(chunks_: DataFrame) -> DataFrame:
    """Chunks with ``defines``: prose has no definitions, so its capitalised words of five
    letters or more stand for them, in order and once each."""
    return chunks_.withColumn("defines", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))))


def symbols(chunks_: DataFrame) -> DataFrame:
    return chunks_.select(F.explode("defines").alias("symbol"), "chunk_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time that has a zone (the session's, UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, query, context, response): a turn, the one before it, and the one after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"response": F.lead("text").over(w), "context": F.lag("text").over(w)})
    return rows.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("query"), "context", "response")


CHUNKS_SQL = """
windows AS MATERIALIZED (
  SELECT source, k, substr(text, 896 * k + 1, 1024) AS text
  FROM (SELECT doc_id AS source, text, unnest(range(0, CASE WHEN length(text) < 1024 THEN 1 ELSE (length(text) - 1024) // 896 + 2 END)) AS k FROM documents WHERE length(text) > 0)
), full_windows AS (
  SELECT * FROM windows WHERE regexp_replace(text, '\\s+', '', 'g') <> ''
), chunks AS MATERIALIZED (
  SELECT source, (row_number() OVER (PARTITION BY source ORDER BY k) - 1)::INT AS chunk_idx, text FROM full_windows
), chunk_rows AS MATERIALIZED (
  SELECT source || '#' || chunk_idx AS chunk_id, source, chunk_idx, text FROM chunks
)"""

QUERIES_SQL = """
queries AS MATERIALIZED (
  SELECT item_id AS query_id, text FROM benchmark
)"""

TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
TERMS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"

BM25_SQL = f"""
token_rows AS MATERIALIZED (
  SELECT chunk_id, {TERMS.format('text')} AS toks FROM chunk_rows
), stats AS (
  SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM token_rows
), asked AS MATERIALIZED (
  SELECT query_id, array_to_string(t, ' ') AS term, len(t) AS m, count(*) AS times
  FROM (SELECT query_id, {TERMS.format('word')} AS t FROM (SELECT query_id, unnest({WORDS.format('text')}) AS word FROM queries)) WHERE len(t) > 0 GROUP BY ALL
), grams AS (
  SELECT chunk_id, len(toks) AS dl, unnest(list_transform(range(1, len(toks) - m + 2), lambda i: array_to_string(toks[i : i + m - 1], ' '))) AS term
  FROM token_rows, (SELECT DISTINCT m FROM asked)
), posted AS MATERIALIZED (
  SELECT chunk_id, term, dl, count(*) AS tf FROM grams WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), freq AS (
  SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), stats
), bm25 AS MATERIALIZED (
  SELECT query_id, chunk_id, round(sum(times * idf * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25
  FROM posted JOIN freq USING (term) JOIN asked USING (term), stats GROUP BY query_id, chunk_id
)"""

L2 = "round(list_distance({0}::DOUBLE[], {1}::DOUBLE[]), 9)"
VECTORS_SQL = f"""
vectors AS MATERIALIZED (
  SELECT (vec_id // {CHUNKS_PER_SOURCE})::VARCHAR AS source, (vec_id // {CHUNKS_PER_SOURCE}) || '#' || (vec_id % {CHUNKS_PER_SOURCE}) AS id, embedding::DOUBLE[] AS v FROM embeddings
), asked_vectors AS MATERIALIZED (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)
), near AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l2, id) AS rank FROM (SELECT query_id, id, source, {L2.format('v', 'q')} AS l2 FROM vectors, asked_vectors)
)"""

SUMMARIES_SQL = f"""
summaries AS MATERIALIZED (
  SELECT source, list(x ORDER BY k) AS v FROM (
    SELECT source, k, avg(x) AS x FROM (SELECT source, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM vectors) GROUP BY source, k
  ) GROUP BY source
), top_files AS MATERIALIZED (
  SELECT * FROM (SELECT query_id, source, l2, row_number() OVER (PARTITION BY query_id ORDER BY l2, source) AS rank FROM (SELECT query_id, source, {L2.format('v', 'q')} AS l2 FROM summaries, asked_vectors)) WHERE rank <= 5
)"""

DEFINES_SQL = """
first_seen AS MATERIALIZED (
  SELECT chunk_id, symbol, min(spot) AS spot FROM (SELECT chunk_id, unnest(names) AS symbol, generate_subscripts(names, 1) AS spot FROM (SELECT chunk_id, regexp_extract_all(text, '[A-Z][a-z]{4,}') AS names FROM chunk_rows)) GROUP BY chunk_id, symbol
), defined AS MATERIALIZED (
  SELECT chunk_id, symbol, row_number() OVER (PARTITION BY chunk_id ORDER BY spot) AS nth FROM first_seen
)"""


def fused_sql(name: str, words: str, near: str, k: int) -> str:
    """Reciprocal rank fusion of two rankings (query_id, id, rank), each of 2k, to k."""
    return f"""
{name}_legs AS (
  SELECT query_id, id, 1.0 / (rank + 20.0) AS score FROM {words} WHERE rank <= {2 * k} UNION ALL SELECT query_id, id, 1.0 / (rank + 20.0) FROM {near} WHERE rank <= {2 * k}
), {name} AS MATERIALIZED (
  SELECT query_id, rank, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(score), 12) AS score FROM {name}_legs GROUP BY query_id, id)
  ) WHERE rank <= {k}
)"""


def words_sql(name: str, where: str = "true") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm25 WHERE {where}
)"""


def near_sql(name: str, k: int, where: str) -> str:
    """The nearest 3k, of which those that hold stay."""
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY l2, id) AS rank FROM near WHERE rank <= {3 * k} AND {where}
)"""


def expanded_sql(name: str, found: str, rows: int, most: int) -> str:
    """(query_id, rank, id): what ``found`` has, then what its first rows lead to."""
    return f"""
{name}_hits AS (
  SELECT f.query_id, s.chunk_id, min(f.rank * 100 + d.nth) AS key FROM {found} f JOIN defined d ON d.chunk_id = f.id AND d.nth <= 3 JOIN defined s ON s.symbol = d.symbol
  WHERE f.rank <= {rows} AND NOT EXISTS (SELECT 1 FROM {found} g WHERE g.query_id = f.query_id AND g.id = s.chunk_id) GROUP BY f.query_id, s.chunk_id
), {name}_extra AS MATERIALIZED (
  SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key, chunk_id) AS place FROM {name}_hits) WHERE place <= {most}
), {name} AS MATERIALIZED (
  SELECT query_id, rank, id FROM {found} UNION ALL
  SELECT query_id, place + last, chunk_id FROM {name}_extra JOIN (SELECT query_id, max(rank) AS last FROM {found} GROUP BY query_id) USING (query_id)
)"""


def reranked_sql(name: str, found: str, k: int) -> str:
    """Found chunks (query_id, rank, id) by terms in common with the query and kind of source."""
    return f"""
{name}_scored AS (
  SELECT f.query_id, f.rank AS old_rank, f.id, count(*) OVER (PARTITION BY f.query_id) AS n,
         len(list_filter(list_distinct({TOKENS.format('q.text')}), lambda x: list_contains({TOKENS.format('c.text')}, x))) / greatest(len(list_distinct({TOKENS.format('q.text')})), 1)
         + ([0.3, 0.25, 0.15, 0.1, 0.05, 0.0])[(c.source % 6 + 1)::INT]::DOUBLE AS value
  FROM {found} f JOIN chunk_rows c ON f.id = c.chunk_id JOIN queries q USING (query_id)
), {name} AS MATERIALIZED (
  SELECT query_id, rank, id, rerank_score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old_rank) AS rank FROM (SELECT *, round(CASE WHEN n <= 1 THEN -old_rank ELSE value END, 9) AS rerank_score FROM {name}_scored)
  ) WHERE rank <= {k}
)"""


def diversified_sql(name: str, found: str, k: int) -> str:
    """k of the first 3k of ``found``, picked one by one."""
    return f"""
{name}_base AS (
  SELECT query_id, list({{'id': id, 'source': regexp_replace(id, '#[^#]*$', ''), 'idx': regexp_extract(id, '#([0-9]+)$', 1)::BIGINT, 'rel': 1 - 0.5 * (spot - 1) / n}} ORDER BY spot) AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS spot, count(*) OVER (PARTITION BY query_id) AS n FROM {found} WHERE rank <= {3 * k}) GROUP BY query_id
), {name}_steps AS (
  SELECT query_id, items[1:0] AS picked, items AS rest FROM {name}_base
  UNION ALL
  SELECT query_id, list_append(picked, rest[spot]), list_concat(list_concat(rest[1 : spot - 1], CASE WHEN spot < len(rest) THEN rest[len(rest) : len(rest)] ELSE rest[1:0] END), rest[spot + 1 : len(rest) - 1])
  FROM (
    SELECT *, list_position(worth, list_max(worth)) AS spot FROM (
      SELECT *, list_transform(rest, lambda c: 0.5 * c.rel - CASE WHEN len(list_filter(picked, lambda p: p.source = c.source AND abs(p.idx - c.idx) <= 2)) > 0 THEN 0.5 * 0.95 ELSE 0.0 END) AS worth
      FROM {name}_steps WHERE len(picked) < {k} AND len(rest) > 0
    )
  )
), {name} AS MATERIALIZED (
  SELECT query_id, generate_subscripts(picked, 1) AS rank, unnest(picked).id AS id FROM (SELECT query_id, arg_max(picked, len(picked)) AS picked FROM {name}_steps GROUP BY query_id)
)"""


TURNS_SQL = """
turns AS MATERIALIZED (
  SELECT conv_id * 1000 + turn AS pos, text AS query, context, response FROM (
    SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations
  ) WHERE role = 'user'
)"""
