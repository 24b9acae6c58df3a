"""Queries over chunks, postings and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.functions import vector as V
from quernstone.operators import chunking
from quernstone.operators import retrieval as R
from quernstone.plans import common as C
from quernstone.plans.registry import register
from quernstone.session import table
from quernstone.storage import Scratch


@register("chk1_char_window", f"WITH {C.CHUNKS_SQL} SELECT source, chunk_idx, chunk_id, length(text)::BIGINT AS n_chars, md5(text) AS sum FROM chunk_rows")
def chk1(spark, sf_dir):
    return C.chunks(spark, sf_dir).select("source", "chunk_idx", "chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("sum"))


@register("chk2_word_window", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, k, array_to_string(w[450 * k + 1 : 450 * k + 500], ' ') AS t FROM (SELECT *, unnest(range(0, CASE WHEN len(w) <= 500 THEN 1 ELSE ceil((len(w) - 500) / 450)::INT + 1 END)) AS k FROM w))
SELECT doc_id AS source, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_idx, length(t)::BIGINT AS n_chars, md5(t) AS sum FROM p WHERE t <> ''
""")
def chk2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    out = chunking.chunked(docs, chunking.word_windows(F.col("text")), most=None)
    return out.select("source", "chunk_idx", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("sum"))


_MARKDOWN = "'# ' || source || chr(10) || text || chr(10) || chr(10) || '## ' || lang || chr(10) || 'end' || chr(10) || 'Under' || chr(10) || '---' || chr(10) || 'x'"


@register("chk3_markdown_sections", f"""
WITH m AS (SELECT doc_id, {_MARKDOWN} AS md FROM documents),
l AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS n FROM m)),
h AS (SELECT *, regexp_extract(line, '^\\s*#{{1,6}}\\s*(.*)$', 1) AS atx, regexp_matches(line, '^\\s*#{{1,6}}[^#]') AS is_atx, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY n)) AS after FROM l),
g AS (SELECT *, CASE WHEN is_atx AND trim(atx) <> '' THEN trim(atx) WHEN trim(line) <> '' AND coalesce(regexp_matches(after, '^(=+|-{{3,}})$'), false) AND NOT regexp_matches(trim(line), '^(=+|-{{3,}})$') THEN trim(line) END AS name FROM h),
s AS (SELECT *, sum(CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM g),
b AS (SELECT doc_id, section, max(name) AS name, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS t FROM s GROUP BY doc_id, section)
SELECT doc_id AS id, section::BIGINT AS section, name, length(t)::BIGINT AS n_chars FROM b WHERE section > 0 AND t <> ''
""")
def chk3(spark, sf_dir):
    md = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n\n## "), "lang", F.lit("\nend\nUnder\n---\nx"))
    docs = table(spark, sf_dir, "documents").select("doc_id", md.alias("md"))
    return chunking.markdown_sections(docs, "doc_id", "md").select("id", "section", "name", F.length("text").cast("long").alias("n_chars"))


@register("chk10_titled_sections", """
WITH m AS (SELECT doc_id, chr(10) || 'intro' || chr(10) || '## ' || source || ' of ' || lang || chr(10) || text || chr(10) || '## Last One!' AS md FROM documents),
p AS (SELECT doc_id, unnest(string_split(md, chr(10) || '## ')) AS part, generate_subscripts(string_split(md, chr(10) || '## '), 1) - 1 AS place FROM m)
SELECT doc_id AS id, place::BIGINT AS place, trim(split_part(part, chr(10), 1)) AS title,
       left(regexp_replace(regexp_replace(lower(trim(split_part(part, chr(10), 1))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 64) AS slug,
       length(regexp_replace(regexp_replace(part, '^[^\\n]*\\n?', ''), '^\\s+|\\s+$', '', 'g'))::BIGINT AS n_chars
FROM p WHERE place > 0
""")
def chk10(spark, sf_dir):
    md = F.concat(F.lit("intro\n## "), "source", F.lit(" of "), "lang", F.lit("\n"), "text", F.lit("\n## Last One!"))
    out = chunking.titled_sections(table(spark, sf_dir, "documents").select("doc_id", md.alias("md")), "doc_id", "md")
    return out.select("id", "place", "title", "slug", F.length("body").cast("long").alias("n_chars"))


@register("flt11_parser_bypass", """
WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents)
SELECT doc_id, ((len(ls) <= 1 AND length(text) >= 10000) OR list_max(list_transform(ls, lambda x: length(x))) > 50000 OR length(text) // len(ls) > 2000) AS bypass FROM l
""")
def flt11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.bypasses_parser(F.col("text")).alias("bypass"))


@register("agg14_bm25_statistics", f"""
WITH {C.CHUNKS_SQL}, t AS (SELECT chunk_id, {C.TERMS.format('text')} AS toks FROM chunk_rows)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM t) GROUP BY ALL) GROUP BY term
""")
def agg14(spark, sf_dir):
    return R.term_statistics(C.chunks(spark, sf_dir))


_KEYWORD = f"{C.CHUNKS_SQL}, {C.QUERIES_SQL}, {C.BM25_SQL}"
_FUSED = f"{_KEYWORD}, {C.VECTORS_SQL}, {C.words_sql('words')}, {C.fused_sql('fused', 'words', 'near', 7)}"


@register("ret1_keyword_topk", f"""
WITH {_KEYWORD}
SELECT query_id, rank, chunk_id, bm25, 1.0 / (rank + 20.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 7
""")
def ret1(spark, sf_dir):
    return R.keyword_topk(C.chunks(spark, sf_dir), C.queries(spark, sf_dir), 7)


@register("ret1_phrases", f"""
WITH {C.CHUNKS_SQL}, pairs AS MATERIALIZED (
  SELECT item_id, generate_subscripts(w, 1) AS k, w FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
), queries AS MATERIALIZED (
  SELECT item_id AS query_id, string_agg(w[k] || '-' || w[k + 1], ' ' ORDER BY k) AS text FROM pairs WHERE k < len(w) GROUP BY item_id
), {C.BM25_SQL}
SELECT query_id, rank, chunk_id, bm25, 1.0 / (rank + 20.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 7
""")
def ret1_phrases(spark, sf_dir):
    """RET1 with hyphenated words: each two neighbouring words of an item are a phrase."""
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat(F.element_at(words, k), F.lit("-"), F.element_at(words, k + 1)))
    asked = C.queries(spark, sf_dir).where(F.size(words) > 1).select("query_id", F.array_join(pairs, " ").alias("text"))
    return R.keyword_topk(C.chunks(spark, sf_dir), asked, 7)


@register("ret2_vector_topk", f"WITH {C.VECTORS_SQL} SELECT query_id, rank, id, l2, 1.0 / (rank + 20.0) AS score FROM near WHERE rank <= 7")
def ret2(spark, sf_dir):
    return R.vector_topk(C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), 7)


def _scored(spark, sf_dir):
    return R.Keywords(C.chunks(spark, sf_dir), C.queries(spark, sf_dir))


def _hybrid(spark, sf_dir, k=7):
    return R.hybrid(_scored(spark, sf_dir), C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), k)


@register("ret3_rank_fusion", f"WITH {_FUSED} SELECT * FROM fused")
def ret3(spark, sf_dir):
    return _hybrid(spark, sf_dir).withColumnRenamed("chunk_id", "id")


@register("ret4_hybrid_search", f"WITH {_FUSED} SELECT query_id, rank, chunk_id, score, source, length(text)::BIGINT AS n_chars FROM fused JOIN chunk_rows ON id = chunk_id")
def ret4(spark, sf_dir):
    return R.hydrated(_hybrid(spark, sf_dir), C.chunks(spark, sf_dir), "chunk_id").select("query_id", "rank", "chunk_id", "score", "source", F.length("text").cast("long").alias("n_chars"))


@register("ret12_outline", f"""
WITH {_KEYWORD}, {C.VECTORS_SQL}, {C.words_sql('words')}, {C.fused_sql('fused', 'words', 'near', 14)}
SELECT query_id, rank, chunk_id || ' | ' || source || ' | ' || trim(split_part(text, chr(10), 1)) AS line FROM fused JOIN chunk_rows ON id = chunk_id WHERE rank <= 7
""")
def ret12(spark, sf_dir):
    """Search for max(2 top_k, 10), cut to top_k; chunks of prose have no name, so the
    first line is the title."""
    top_k = 7
    found = _hybrid(spark, sf_dir, max(2 * top_k, 10)).where(F.col("rank") <= top_k)
    found = R.hydrated(found, C.chunks(spark, sf_dir), "chunk_id")
    return found.select("query_id", "rank", F.concat_ws(" | ", "chunk_id", F.col("source").cast("string"), F.trim(F.split("text", "\n")[0])).alias("line"))


@register("ret13_section_ids", f"""
WITH {_KEYWORD}, {C.VECTORS_SQL}, {C.words_sql('words')}, {C.fused_sql('fused', 'words', 'near', 10)}
SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM fused GROUP BY query_id
""")
def ret13(spark, sf_dir):
    lists = _hybrid(spark, sf_dir, 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("x"))
    return lists.select("query_id", F.array_join(F.transform("x", lambda s: s["chunk_id"]), ",").alias("ids"))


def _in_files(k: int) -> str:
    """Hierarchical search as SQL up to its fusion; every benchmark item has a vector."""
    inside = "EXISTS (SELECT 1 FROM top_files t WHERE t.query_id = {0}.query_id AND t.source = regexp_replace({0}.{1}, '#[^#]*$', ''))"
    return f"""{_KEYWORD}, {C.VECTORS_SQL}, {C.SUMMARIES_SQL}, {C.DEFINES_SQL}, {C.words_sql('words', inside.format('bm25', 'chunk_id'))},
{C.near_sql('inside', 2 * k, inside.format('near', 'id'))}, {C.fused_sql('found', 'words', 'inside', k)}, {C.expanded_sql('hier', 'found', 10, 10)}"""


def _hierarchical(spark, sf_dir, k):
    chunks = C.defining(C.chunks(spark, sf_dir))
    return R.hierarchical(_scored(spark, sf_dir), C.vectors(spark, sf_dir), C.summaries(spark, sf_dir), C.queries(spark, sf_dir), C.vector_queries(spark, sf_dir), chunks, C.symbols(chunks), k, 10)


@register("ret6_hierarchical_search", f"WITH {_in_files(7)} SELECT query_id, rank, id AS chunk_id FROM hier")
def ret6(spark, sf_dir):
    return _hierarchical(spark, sf_dir, 7)


@register("ret5_summary_topk", f"WITH {C.VECTORS_SQL}, {C.SUMMARIES_SQL} SELECT query_id, rank, source, l2 FROM top_files")
def ret5(spark, sf_dir):
    return R.vector_topk(C.summaries(spark, sf_dir), C.vector_queries(spark, sf_dir), 5).select("query_id", "rank", F.col("id").alias("source"), "l2")


@register("flt3_vector_sources", f"""
WITH {C.VECTORS_SQL}, {C.SUMMARIES_SQL}, {C.near_sql('inside', 14, "EXISTS (SELECT 1 FROM top_files t WHERE t.query_id = near.query_id AND t.source = near.source)")}
SELECT query_id, rank, id FROM inside WHERE rank <= 14
""")
def flt3(spark, sf_dir):
    """The nearest 3k vectors, those of the query's files kept, at most k of them."""
    top = R.vector_topk(C.summaries(spark, sf_dir), C.vector_queries(spark, sf_dir), 5).select("query_id", F.col("id").alias("source"))
    return R.vector_topk(C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), 14, sources=top).select("query_id", "rank", "id")


_MASTER = "src1"
_OF_MASTER = f"source IN (SELECT doc_id FROM documents WHERE source = '{_MASTER}')"


@register("ret11_one_source_search", f"""
WITH RECURSIVE {_KEYWORD}, {C.VECTORS_SQL}, {C.words_sql('words', f"regexp_replace(chunk_id, '#[^#]*$', '') IN (SELECT doc_id::VARCHAR FROM documents WHERE source = '{_MASTER}')")},
{C.near_sql('inside', 30, f"source IN (SELECT doc_id::VARCHAR FROM documents WHERE source = '{_MASTER}')")}, {C.fused_sql('found', 'words', 'inside', 15)},
{C.reranked_sql('better', 'found', 15)}, {C.diversified_sql('picked', 'better', 5)}
SELECT query_id, rank, id AS chunk_id FROM picked UNION ALL
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, chunk_idx), chunk_id
FROM (SELECT * FROM chunk_rows WHERE {_OF_MASTER} ORDER BY source, chunk_idx LIMIT 5), queries WHERE query_id NOT IN (SELECT query_id FROM found)
""")
def ret11(spark, sf_dir):
    """Search in the documents of one source alone."""
    chunks = C.chunks(spark, sf_dir)
    master = table(spark, sf_dir, "documents").where(F.col("source") == _MASTER).select(F.col("doc_id").alias("source"))
    return R.master_search(_scored(spark, sf_dir), C.vectors(spark, sf_dir), C.queries(spark, sf_dir), C.vector_queries(spark, sf_dir), chunks, master, 5)


@register("ret15_query_union", f"""
WITH RECURSIVE {_in_files(30)}, {C.reranked_sql('first', 'hier', 7)}, {C.diversified_sql('picked', 'first', 7)}, {C.reranked_sql('extra', 'hier', 3)},
every AS (
  SELECT query_id, 0 AS ordinal, rank, id FROM picked UNION ALL SELECT query_id - 1, 1, rank, id FROM extra WHERE query_id - 1 IN (SELECT query_id FROM queries)
), firsts AS (SELECT query_id, id, min(ordinal * 1000000 + rank) AS k FROM every GROUP BY query_id, id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS place, id AS chunk_id FROM firsts
""")
def ret15(spark, sf_dir):
    """Context of a prompt: hierarchical search for the main query, reranked and
    diversified, then what a further query (the next item) adds by its best three."""
    queries, scratch = C.queries(spark, sf_dir), Scratch(spark, "prompt")
    found = scratch.save(_hierarchical(spark, sf_dir, 30), "found")
    better = scratch.save(R.rescored(found, C.chunks(spark, sf_dir), queries, 7), "better")
    extra = better.where(F.col("rank") <= 3).withColumn("query_id", F.col("query_id") - 1).join(queries, "query_id", "left_semi")
    return R.appended(R.diversified(better, 7), extra.withColumn("ordinal", F.lit(1)))


@register("ret16_semantic_cache", """
WITH c AS (SELECT vec_id AS id, embedding, make_timestamp(2024, 1, 1, 0, 0, 0) + to_hours(CAST(vec_id AS INTEGER)) AS created_at FROM embeddings),
l AS (SELECT * FROM c WHERE created_at >= make_timestamp(2024, 1, 3, 0, 0, 0) - to_seconds(86400)),
p AS (SELECT q.vec_id AS query_id, l.id, round(list_distance(q.embedding::DOUBLE[], l.embedding::DOUBLE[]), 9) AS d FROM embeddings q, l),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM p)
SELECT query_id, id, round(1 - d * d / 2, 9) AS similarity FROM b WHERE r = 1 AND round(1 - d * d / 2, 9) >= 0.9
""")
def ret16(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    cache = rows.select(F.col("vec_id").alias("id"), "embedding", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, CAST(vec_id AS INT), 0, 0)").alias("created_at"))
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    return R.cached_answer(cache, asked, F.expr("TIMESTAMP '2024-01-03 00:00:00'"), 86_400)


_PATTERNS = "SELECT e.vec_id, e.embedding FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality = 1"


def _patterns(spark, sf_dir):
    """(id, embedding): vectors of documents that are labelled good stand for approved patterns."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(good, "vec_id", "left_semi").select(F.col("vec_id").alias("id"), "embedding")


@register("ret17_pattern_topk", f"""
WITH p AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {C.L2.format('q.embedding', 'a.embedding')} AS l2 FROM embeddings q, ({_PATTERNS}) a WHERE q.vec_id IN (SELECT item_id FROM benchmark))
SELECT query_id, rank, id, l2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l2, id) AS rank FROM p) WHERE rank <= 3
""")
def ret17(spark, sf_dir):
    return R.vector_topk(_patterns(spark, sf_dir), C.vector_queries(spark, sf_dir), 3).select("query_id", "rank", "id", "l2")


@register("ret18_tool_topk", """
WITH p AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS dot FROM embeddings q, embeddings a WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND a.vec_id <> q.vec_id)
SELECT query_id, rank, id, dot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank FROM p) WHERE rank <= 5
UNION ALL
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY vec_id), vec_id, NULL FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5), benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings)
""")
def ret18(spark, sf_dir):
    """The tools nearest to a query; without a model, so without a vector, the first k."""
    tools = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = C.vector_queries(spark, sf_dir)
    best = R.vector_topk(tools, asked, 5, "dot", skip_self=True).select("query_id", "rank", "id", "dot")
    plain = C.queries(spark, sf_dir).select("query_id").join(asked, "query_id", "left_anti")
    head = tools.select("id").orderBy("id").limit(5).agg(F.array_sort(F.collect_list("id")))
    first = plain.select("query_id", F.posexplode(head.scalar()).alias("at", "id"))
    return best.unionByName(first.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), "id", F.lit(None).cast("double").alias("dot")))


@register("flt16_auto_approve", f"""
WITH p AS (SELECT a.vec_id, min({C.L2.format('a.embedding', 'b.embedding')}) AS d FROM embeddings a LEFT JOIN ({_PATTERNS}) b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark) GROUP BY a.vec_id),
t AS (SELECT p.vec_id, d, length(b.text) AS n FROM p JOIN benchmark b ON b.item_id = p.vec_id)
SELECT vec_id, d AS nearest, n <= 8000 AND CASE WHEN d IS NULL THEN n BETWEEN 100 AND 4000 ELSE d < 1.0 END AS approved FROM t
""")
def flt16(spark, sf_dir):
    best = R.vector_topk(_patterns(spark, sf_dir), C.vector_queries(spark, sf_dir), 1, skip_self=True)
    asked = C.queries(spark, sf_dir).join(C.vector_queries(spark, sf_dir), "query_id", "left_semi")
    found = asked.join(best.select("query_id", "l2"), "query_id", "left")
    return found.select(F.col("query_id").alias("vec_id"), F.col("l2").alias("nearest"), R.auto_approved(F.col("l2"), F.length("text")).alias("approved"))


@register("ret9_rerank", f"WITH {_FUSED}, {C.reranked_sql('better', 'fused', 5)} SELECT query_id, rank, id AS chunk_id, rerank_score FROM better")
def ret9(spark, sf_dir):
    """A lexical score stands in for the model."""
    return R.rescored(_hybrid(spark, sf_dir), C.chunks(spark, sf_dir), C.queries(spark, sf_dir), 5)


@register("ret10_diversify", f"WITH RECURSIVE {_KEYWORD}, {C.words_sql('words')}, {C.diversified_sql('picked', 'words', 7)} SELECT query_id, rank, id AS chunk_id FROM picked")
def ret10(spark, sf_dir):
    found = R.keyword_topk(C.chunks(spark, sf_dir), C.queries(spark, sf_dir), 21)
    return R.diversified(found, 7)


@register("ret8_symbol_expansion", f"WITH {_FUSED}, {C.DEFINES_SQL}, {C.expanded_sql('more', 'fused', 10, 10)} SELECT * FROM more_extra")
def ret8(spark, sf_dir):
    chunks = C.defining(C.chunks(spark, sf_dir))
    found = Scratch(spark, "expansion").save(_hybrid(spark, sf_dir), "found")
    return R.expanded(found, chunks, C.symbols(chunks), 10, 3, 10, 7)


@register("ret7_graph_walk", f"WITH {_FUSED}, {C.DEFINES_SQL}, {C.expanded_sql('more', 'fused', 7, 10)} SELECT query_id, rank, id AS chunk_id FROM more")
def ret7(spark, sf_dir):
    """Hybrid search with the definitions of what was found appended."""
    chunks = C.defining(C.chunks(spark, sf_dir))
    return R.graph_walk(_scored(spark, sf_dir), C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), chunks, C.symbols(chunks), 7, 10)


@register("jn3_ordered_lookup", f"""
WITH {C.CHUNKS_SQL}, ids AS (SELECT unnest(['3#0', '1#0', '999999#0', '3#0', '2#0']) AS id, generate_subscripts(['3#0', '1#0', '999999#0', '3#0', '2#0'], 1) - 1 AS pos)
SELECT pos::INT AS pos, chunk_id, source FROM ids JOIN chunk_rows ON id = chunk_id
""")
def jn3(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("3#0", "1#0", "999999#0", "3#0", "2#0")))).alias("pos", "chunk_id"))
    return C.chunks(spark, sf_dir).join(F.broadcast(ids), "chunk_id").select("pos", "chunk_id", "source")


@register("jn14_detail_expansion", f"""
WITH {C.CHUNKS_SQL}, {C.QUERIES_SQL}, {C.BM25_SQL}, f AS (
  SELECT query_id, rank, chunk_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm25) JOIN chunk_rows USING (chunk_id) WHERE rank <= 5
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM f
), t AS (SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_idx) AS part FROM chunk_rows)
SELECT query_id, rank, 0::BIGINT AS part, chunk_id FROM o
UNION ALL SELECT o.query_id, o.rank, t.part, t.chunk_id FROM o JOIN t USING (source) WHERE o.nth = 1 AND t.part <= 3
""")
def jn14(spark, sf_dir):
    web = C.chunks(spark, sf_dir).withColumn("source", F.concat(F.lit("https://d/"), F.col("source").cast("string")))
    found = R.keyword_topk(C.chunks(spark, sf_dir), C.queries(spark, sf_dir), 5)
    return R.with_details(found.join(web.select("chunk_id", "source"), "chunk_id").select("query_id", "rank", "chunk_id", "source"), web)


@register("ret14_reasoning", f"""
WITH {_FUSED}, f AS (SELECT query_id, rank, chunk_id, source FROM fused JOIN chunk_rows ON id = chunk_id WHERE rank <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM f),
t AS (SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_idx) AS part FROM chunk_rows)
SELECT query_id, rank, 0::BIGINT AS part, chunk_id FROM o UNION ALL SELECT o.query_id, o.rank, t.part, t.chunk_id FROM o JOIN t USING (source) WHERE o.nth = 1 AND t.part <= 3
""")
def ret14(spark, sf_dir):
    """Hybrid search cut to five, then the first three details of each source found."""
    chunks = C.chunks(spark, sf_dir)
    web = chunks.withColumn("source", F.concat(F.lit("https://d/"), F.col("source").cast("string")))
    found = _hybrid(spark, sf_dir).where(F.col("rank") <= 5).join(web.select("chunk_id", "source"), "chunk_id")
    return R.with_details(found.select("query_id", "rank", "chunk_id", "source"), web)


@register("str29_context_blocks", f"""
WITH {_KEYWORD}, {C.VECTORS_SQL}, {C.words_sql('words')}, {C.fused_sql('fused', 'words', 'near', 5)}, e AS (
  SELECT query_id, rank, '<source_file path="' || source || '" last_verified_date="2024-01-01">' || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</source_file>' AS x
  FROM fused JOIN chunk_rows ON id = chunk_id
), c AS (SELECT query_id, string_agg(x, chr(10) ORDER BY rank) AS context FROM e GROUP BY query_id)
SELECT query_id, md5(CASE WHEN length(context) <= {fixed.BUDGET_CHARS} THEN context ELSE left(context, {fixed.BUDGET_CHARS - len(fixed.TRUNCATION_SUFFIX)}) || '{fixed.TRUNCATION_SUFFIX}' END) AS context FROM c
""")
def str29(spark, sf_dir):
    """Found chunks as one text for each query."""
    found = R.hydrated(_hybrid(spark, sf_dir, 5), C.chunks(spark, sf_dir), "chunk_id")
    blocks = R.context_blocks(found.withColumn("last_updated", F.lit(1704067200).cast("long")).withColumn("source", F.col("source").cast("string")))
    return blocks.select("query_id", F.md5("context").alias("context"))


@register("mt1_vector_math", """
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings
""")
def mt1(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.transform(V.normalised("embedding"), lambda x: V.rounded(x, 6)).alias("unit"))


@register("mt3_mean_pooling", """
WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding[1] > 0 AS set_ FROM embeddings),
c AS (SELECT label, k, avg(CASE WHEN set_ THEN x END) AS x FROM (SELECT label, set_, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM m) GROUP BY label, k)
SELECT label, list(round(coalesce(x, 0.0), 6) ORDER BY k) AS mean FROM c GROUP BY label
""")
def mt3(spark, sf_dir):
    """The mean of each label's vectors over those that the mask (first component above 0)
    leaves; aggregated by component, so no label has to fit into a task."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("embedding")[0] > 0).alias("mask"), F.posexplode("embedding").alias("k", "x"))
    mean = rows.groupBy("label", "k").agg(F.coalesce(F.avg(F.when(F.col("mask"), F.col("x").cast("double"))), F.lit(0.0)).alias("x"))
    whole = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", V.rounded("x", 6).alias("x")))).alias("v"))
    return whole.select("label", F.transform("v", lambda p: p["x"]).alias("mean"))
