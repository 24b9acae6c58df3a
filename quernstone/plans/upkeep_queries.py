"""Queries over curation, upkeep of an index, and operational analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.functions import text as T
from quernstone.operators import analytics as A
from quernstone.operators import curation as K
from quernstone.plans import common as C
from quernstone.plans.registry import register
from quernstone.plans.text_queries import _quoted, _redacted_sql, keywords_sql
from quernstone.session import table

_LOW = f"""(strlen(trim(response)) < 20 OR lower(trim(response)) IN ({_quoted(fixed.LOW_VALUE_RESPONSES)}))"""


@register("flt4_low_value", f"""
WITH {C.TURNS_SQL}, t AS (SELECT pos, CASE pos % 5 WHEN 0 THEN ' Run 42 doc check ' WHEN 1 THEN 'run 7' ELSE query END AS query, CASE pos % 7 WHEN 0 THEN 'No Changes' WHEN 1 THEN 'existing or verified doc.' ELSE coalesce(response, '') END AS response FROM turns)
SELECT pos, regexp_matches(trim(query), '(?i)^run [0-9]+( doc check)?\\s*$') AS low_query, {_LOW} AS low_response FROM t
""")
def flt4(spark, sf_dir):
    """FLT4, FLT5, FLT6."""
    query = F.when(F.col("pos") % 5 == 0, " Run 42 doc check ").when(F.col("pos") % 5 == 1, "run 7").otherwise(F.col("query"))
    response = F.when(F.col("pos") % 7 == 0, "No Changes").when(F.col("pos") % 7 == 1, "existing or verified doc.").otherwise(F.coalesce("response", F.lit("")))
    return C.turns(spark, sf_dir).select("pos", T.low_value_query(query).alias("low_query"), T.low_value_response(response).alias("low_response"))


@register("flt7_relevance", f"""
WITH {C.TURNS_SQL}, k AS (SELECT pos, {keywords_sql('query')} AS kw, lower(coalesce(context, '')) AS ctx FROM turns),
h AS (SELECT pos, len(kw) AS n, len(list_filter(kw, lambda x: contains(ctx, x))) AS hits FROM k)
SELECT pos, n = 0 OR hits >= 2 OR (n <= 4 AND hits / n > 0.3) AS relevant FROM h
""")
def flt7(spark, sf_dir):
    return C.turns(spark, sf_dir).select("pos", T.is_relevant("query", F.coalesce("context", F.lit(""))).alias("relevant"))


@register("set2_training_rows", f"""
WITH {C.TURNS_SQL}, b AS (SELECT pos, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, regexp_replace(coalesce(context, ''), '^\\s+|\\s+$', '', 'g') AS context, regexp_replace(coalesce(response, ''), '^\\s+|\\s+$', '', 'g') AS response FROM turns),
k AS (SELECT * FROM b WHERE response <> '' AND (query <> '' OR context <> '') AND NOT regexp_matches(query, '(?i)^run [0-9]+( doc check)?\\s*$') AND NOT {_LOW}),
o AS (SELECT *, row_number() OVER (PARTITION BY query, context ORDER BY pos) AS n FROM k)
SELECT pos, md5({_redacted_sql('query')}) AS query, md5({_redacted_sql('context')}) AS context, md5({_redacted_sql('response')}) AS response FROM o WHERE n = 1
""")
def set2(spark, sf_dir):
    return K.training_rows(C.turns(spark, sf_dir), "pos").select("pos", F.md5("query").alias("query"), F.md5("context").alias("context"), F.md5("response").alias("response"))


@register("set1_instruction_merge", f"""
WITH {C.TURNS_SQL} SELECT query AS instruction, context AS input, response AS output FROM turns WHERE context IS NOT NULL AND response IS NOT NULL
UNION ALL SELECT text, lang, source FROM documents
""")
def set1(spark, sf_dir):
    one = C.turns(spark, sf_dir).select(F.col("query").alias("instruction"), F.col("context").alias("input"), F.col("response").alias("output"), "pos")
    two = table(spark, sf_dir, "documents").select(F.col("text").alias("instruction"), F.col("lang").alias("input"), F.col("source").alias("output"))
    three = table(spark, sf_dir, "benchmark").select(F.col("text").alias("instruction"))
    return K.alpaca_merge([one, two, three])


@register("set3_last_url", """
SELECT url, max(page_id) AS page_id FROM (SELECT page_id, trim(url) AS url FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) FROM pages) GROUP BY url
""")
def set3(spark, sf_dir):
    """The last page of each address, of pages and of the hosts they lie on."""
    rows = table(spark, sf_dir, "pages")
    hosts = rows.select("page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("url"))
    rows = rows.select("page_id", "url").unionByName(hosts).select("page_id", F.trim("url").alias("url"))
    return K.keep_one(rows, ["url"], ["page_id"], last=True).select("url", "page_id")


@register("set4_exact_duplicates", "SELECT min(doc_id) AS doc_id, md5(text) AS sum FROM documents GROUP BY md5(text)")
def set4(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sum"))
    return rows.groupBy("sum").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sum")


@register("set5_ordered_distinct", """
WITH e AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS place, event_type FROM e
""")
def set5(spark, sf_dir):
    firsts = C.events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    w = Window.partitionBy("user_id").orderBy("first_id")
    return firsts.select("user_id", F.row_number().over(w).cast("long").alias("place"), "event_type")


@register("set6_sorted_distinct", f"SELECT doc_id, list_sort(list_distinct({C.TOKENS.format('text')})) AS terms FROM documents")
def set6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(T.tokens("text"))).alias("terms"))


@register("set8_collision_suffix", "SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '_' || n END AS id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def set8(spark, sf_dir):
    n = F.col("n")
    placed = A.placed_in_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "n")
    return placed.select("doc_id", F.when(n == 1, F.col("source")).otherwise(F.concat("source", F.lit("_"), n.cast("string"))).alias("id"))


@register("top3_keep_last", "SELECT conv_id * 1000 + turn AS pos, role FROM conversations ORDER BY 1 DESC LIMIT 100")
def top3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "role")
    return K.keep_last_rows(rows, "pos", 100)


@register("top4_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('s' || doc_id), doc_id LIMIT 50")
def top4(spark, sf_dir):
    return K.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@register("top1_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def top1(spark, sf_dir):
    return C.events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")


@register("top2_cache_clear", "SELECT event_id, user_id FROM events WHERE false")
def top2_clear(spark, sf_dir):
    """No row is kept and none may be old: the cache is emptied."""
    rows = C.events(spark, sf_dir).select("event_id", "user_id", "ts")
    return K.pruned_cache(rows, 0, F.expr("TIMESTAMP '2024-03-01'"), "ts", "event_id").select("event_id", "user_id")


@register("top2_cache_prune", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 500")
def top2(spark, sf_dir):
    rows = C.events(spark, sf_dir).select("event_id", "user_id", "ts")
    return K.pruned_cache(rows, 500, F.expr("TIMESTAMP '2024-01-15'"), "ts", "event_id").select("event_id", "user_id")


@register("jn11_manifest_diff", """
WITH o AS (SELECT doc_id AS source, md5(quality::VARCHAR) AS h FROM labels), n AS (SELECT doc_id AS source, md5((n_chars % 2)::VARCHAR) AS h FROM documents UNION ALL SELECT vec_id, md5(label::VARCHAR) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))
SELECT coalesce(o.source, n.source)::VARCHAR AS source, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.source = n.source
""")
def jn11(spark, sf_dir):
    """Labels as the old manifest, documents and the vectors beyond them as the new one."""
    named = lambda t, key, value: table(spark, sf_dir, t).select(F.col(key).cast("string").alias("source"), F.md5(value.cast("string").cast("binary")).alias("content_hash"))
    docs = named("documents", "doc_id", F.col("n_chars") % 2)
    new = docs.unionByName(named("embeddings", "vec_id", F.col("label")).join(docs, "source", "left_anti"))
    return K.manifest_changes(named("labels", "doc_id", F.col("quality")), new)


@register("snk1_replace_by_source", """
SELECT doc_id, lang, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality::VARCHAR, 'new' FROM labels
""")
def snk1(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("lang"), F.lit("new").alias("version"))
    return K.upserted(table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("version", F.lit("old")), new, ["doc_id"])


@register("jn8_orphans", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def jn8(spark, sf_dir):
    """JN8, JN9."""
    return K.orphans(table(spark, sf_dir, "embeddings").select("vec_id", "label"), table(spark, sf_dir, "labels"), "vec_id", "doc_id")


@register("jn10_cascade", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def jn10(spark, sf_dir):
    return K.without_orphans(table(spark, sf_dir, "embeddings").select("vec_id", "label"), table(spark, sf_dir, "documents").where("lang <> 'en'"), "vec_id", "doc_id")


@register("jn12_index_check", """
SELECT doc_id, 'missing file' AS finding FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'not listed' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
""")
def jn12(spark, sf_dir):
    """JN12, JN13."""
    listed, files = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    gone = listed.join(files, "doc_id", "left_anti").withColumn("finding", F.lit("missing file"))
    return gone.unionByName(files.join(listed, "doc_id", "left_anti").withColumn("finding", F.lit("not listed")))


@register("jn15_new_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_NOW = 1_706_745_600


@register("flt9_web_ttl", f"SELECT event_id FROM events WHERE floor(epoch(ts)) < {_NOW} - 15 * 86400 AND event_id % 2 = 0")
def flt9(spark, sf_dir):
    web = F.when(F.col("event_id") % 2 == 0, "https://e/").otherwise("src/")
    rows = C.events(spark, sf_dir).select("event_id", web.alias("source"), F.unix_seconds("ts").alias("last_updated"))
    return K.outdated_web(rows, F.lit(_NOW), 15).select("event_id")


@register("flt10_freshness", f"SELECT event_type, max(floor(epoch(ts)))::BIGINT AS last_updated, max(floor(epoch(ts))) >= {_NOW} - 60 * 86400 AS fresh FROM events GROUP BY event_type")
def flt10(spark, sf_dir):
    """FLT10, AGG2."""
    last = C.events(spark, sf_dir).groupBy("event_type").agg(F.max(F.unix_seconds("ts")).alias("last_updated"))
    return last.withColumn("fresh", F.col("last_updated") >= _NOW - 60 * 86_400)


@register("agg13_staleness", f"SELECT count(*) AS total, count(*) FILTER (WHERE floor(epoch(ts)) < {_NOW} - 20 * 86400) AS stale, count(*) FILTER (WHERE event_type = 'view') AS views FROM events")
def agg13(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.unix_seconds("ts") < _NOW - 20 * 86_400).alias("stale"), F.count_if(F.col("event_type") == "view").alias("views"))


@register("top6_stalest", f"SELECT event_type, floor(({_NOW} - max(floor(epoch(ts)))) / 86400)::BIGINT AS age_days FROM events GROUP BY event_type ORDER BY age_days DESC")
def top6(spark, sf_dir):
    last = C.events(spark, sf_dir).groupBy("event_type").agg(F.max(F.unix_seconds("ts")).alias("t"))
    return last.select("event_type", F.floor((_NOW - F.col("t")) / 86_400).alias("age_days")).orderBy(F.desc("age_days"))


_MS = "floor(abs(value) * 100)::BIGINT"
_BOUND = "CASE " + " ".join(f"WHEN ms <= {b} THEN {b}" for b in fixed.HISTOGRAM_BOUNDS) + " END"
_HIST = f"h AS (SELECT event_type, {_BOUND}::BIGINT AS bound, count(*) AS n, sum(ms)::BIGINT AS total FROM (SELECT event_type, {_MS} AS ms FROM events) GROUP BY ALL)"


def _latency(spark, sf_dir):
    return C.events(spark, sf_dir).withColumn("ms", F.floor(F.abs("value") * 100))


@register("agg4_histogram", f"WITH {_HIST} SELECT * FROM h")
def agg4(spark, sf_dir):
    return A.histogram(_latency(spark, sf_dir), ["event_type"], "ms")


@register("agg5_bucket_percentile", f"""
WITH {_HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS al, sum(total) OVER (PARTITION BY event_type) AS sm, sum(n) OVER (PARTITION BY event_type ORDER BY bound NULLS LAST) AS seen FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seen) AS k FROM r WHERE seen >= ceil(al * 95 / 100))
SELECT event_type, al::BIGINT AS n, (sm // al)::BIGINT AS average, coalesce(bound, (sm // al)::BIGINT) AS percentile FROM f WHERE k = 1
""")
def agg5(spark, sf_dir):
    """AGG5, AGG6."""
    return A.bucket_percentile(A.histogram(_latency(spark, sf_dir), ["event_type"], "ms"), ["event_type"], 95)


@register("agg7_rates", "SELECT user_id, coalesce(count(*) FILTER (WHERE event_type = 'error') * 100.0 / nullif(count(*), 0), 0)::DOUBLE AS error_rate, coalesce(count(*) FILTER (WHERE event_type = 'click') * 100.0 / nullif(count(*) FILTER (WHERE event_type IN ('click', 'view')), 0), 0)::DOUBLE AS hit_rate FROM events GROUP BY user_id")
def agg7(spark, sf_dir):
    clicks = F.count_if(F.col("event_type") == "click")
    return C.events(spark, sf_dir).groupBy("user_id").agg(
        A.rate(F.count_if(F.col("event_type") == "error").cast("double"), F.count("*").cast("double")).alias("error_rate"),
        A.rate(clicks.cast("double"), F.count_if(F.col("event_type").isin("click", "view")).cast("double")).alias("hit_rate"),
    )


@register("agg8_exact_p95", "SELECT event_type, n, value AS percentile FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r FROM events) WHERE r - 1 = least(floor(n * 0.95), n - 1)")
def agg8(spark, sf_dir):
    return A.exact_percentile(C.events(spark, sf_dir), ["event_type"], "value")


@register("agg9_top_category", "SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY lang, source) WHERE r = 1")
def agg9(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "source")
    return counted.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@register("agg10_audit_score", "SELECT source, avg(quality) AS score, list(doc_id ORDER BY doc_id) FILTER (WHERE quality = 0) AS violations FROM labels JOIN documents USING (doc_id) GROUP BY source")
def agg10(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    failed = F.array_sort(F.collect_list(F.when(F.col("quality") == 0, F.col("doc_id"))))
    return rows.groupBy("source").agg(F.avg("quality").alias("score"), F.when(F.size(failed) > 0, failed).alias("violations"))


@register("agg1_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def agg1(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@register("agg11_ids_by_symbol", "SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label")
def agg11(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


@register("agg12_complexity", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(string_split(text, chr(10))) > 500 AS flagged FROM documents")
def agg12(spark, sf_dir):
    n = F.size(F.split("text", "\n")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_lines"), (n > 500).alias("flagged"))


@register("str11_secret_scan", f"""
WITH l AS (SELECT doc_id AS id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT id, line_no, left(regexp_replace(line, '"[^"]{{8,}}"', '"[REDACTED]"', 'g'), 80) AS snippet FROM l
WHERE NOT ({' OR '.join(f"contains(line, '{p}')" for p in fixed.SECRET_PASS)}) AND ({' OR '.join(f"regexp_matches(line, '{p}')" for p in fixed.SECRETS)})
""")
def str11(spark, sf_dir):
    """STR11, STR12."""
    return K.secret_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


_RUNS = """
c AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT c.*, e.ts, sum(new) OVER (PARTITION BY c.user_id ORDER BY e.ts, c.event_id) AS run FROM c JOIN events e USING (event_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS at_ FROM i)"""


@register("win1_loop_guard", f"WITH {_RUNS} SELECT event_id, at_ AS \"at\", at_ % 3 = 0 AS blocked FROM g")
def win1(spark, sf_dir):
    calls = C.events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return A.loop_guard(calls, ["user_id"], ["ts", "event_id"], ["event_type"], 3).select("event_id", "at", "blocked")


@register("win2_call_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 20 AS over_limit FROM events")
def win2(spark, sf_dir):
    return A.call_limit(C.events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 20).select("event_id", "over_limit")


@register("win3_convergence", """
WITH s AS (SELECT event_id, user_id, ts, least(abs(value) / 200, 1.0)::DOUBLE AS score FROM events),
b AS (SELECT *, max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, greatest(max(score) OVER w, 0.0) AS best, row_number() OVER w AS iteration FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, CASE WHEN score > coalesce(prior, 0.0) + 1e-6 THEN 1 ELSE 0 END AS better FROM b),
i AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - (island > 0)::INT AS stagnation FROM i)
SELECT event_id, best, stagnation::BIGINT AS stagnation, iteration, CASE WHEN best >= 0.95 THEN 'converged' WHEN stagnation >= 3 THEN 'stagnated' WHEN iteration >= 20 THEN 'halted' ELSE 'running' END AS status FROM t
""")
def win3(spark, sf_dir):
    """WIN3, WIN5."""
    scores = C.events(spark, sf_dir).select("event_id", "user_id", "ts", F.least(F.abs("value") / 200, F.lit(1.0)).alias("score"))
    return A.convergence(scores, ["user_id"], ["ts", "event_id"], "score").select("event_id", "best", "stagnation", "iteration", "status")


@register("win4_dead_ends", """
WITH c AS (SELECT event_id, user_id, ts, event_id % 3 AS tool, event_id % 2 AS args, event_type IN ('error', 'view', 'click') AS failed FROM events),
k AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, tool ORDER BY ts, event_id) AS cleared FROM c),
f AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, tool, cleared, args ORDER BY ts, event_id) AS failures FROM k)
SELECT event_id, failures::BIGINT AS failures, failed AND failures >= 2 AS dead_end FROM f
""")
def win4(spark, sf_dir):
    calls = C.events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_id") % 3).alias("tool"), (F.col("event_id") % 2).alias("args"), F.col("event_type").isin("error", "view", "click").alias("failed"))
    return A.dead_ends(calls, ["user_id"], ["ts", "event_id"], "tool", "args", "failed").select("event_id", "failures", "dead_end")


@register("win6_history_prefix", """
WITH r AS (SELECT conv_id, turn, left(text, 200) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, string_agg(x, chr(10) ORDER BY turn) AS prefix FROM r WHERE k <= 3 GROUP BY conv_id
""")
def win6(spark, sf_dir):
    return A.last_turns(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@register("flt1_allowed_roots", r"""
WITH p AS (SELECT page_id, (['/srv/a/', '/srv/ab/', 'research/master_research.md', url])[(page_id % 4 + 1)::INT] AS path FROM pages)
SELECT page_id, path = 'research/master_research.md' OR starts_with(path, '/srv/a/') OR path = '/srv/a' OR regexp_matches(path, '^https?://') AS allowed FROM p
""")
def flt1(spark, sf_dir):
    from quernstone.sources.readers import allowed

    path = F.element_at(F.array(F.lit("/srv/a/"), F.lit("/srv/ab/"), F.lit("research/master_research.md"), F.col("url")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", allowed(path, ["/srv/a"], web=True).alias("allowed"))


@register("flt2_source_filter", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def flt2(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")


@register("flt8_web_snippets", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE strlen(text) >= 10) WHERE r <= 6")
def flt8(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 10)
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 6").select("lang", "doc_id")


@register("src2_eligibility", f"""
WITH p AS (SELECT doc_id, (['a/b.PY', 'node_modules/x.js', 'a/tokenizer.json', 'a/c.exe', 'a/.env.md', 'docs/x.md'])[(doc_id % 6 + 1)::INT] AS path, doc_id * 5000 AS length FROM documents)
SELECT doc_id, length <= 2097152 AND (doc_id % 6) IN (0, 5) AS fine FROM p
""")
def src2(spark, sf_dir):
    from quernstone.sources.readers import may_ingest

    path = F.element_at(F.array(*map(F.lit, ("a/b.PY", "node_modules/x.js", "a/tokenizer.json", "a/c.exe", "a/.env.md", "docs/x.md"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", may_ingest(path, F.col("doc_id") * 5000).alias("fine"))


@register("sym4_plain_calls", r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '([A-Za-z_][0-9A-Za-z_]*)\s*\(', 1))) AS calls FROM pages")
def sym4(spark, sf_dir):
    from quernstone.operators.code import plain_calls

    return table(spark, sf_dir, "pages").select("page_id", plain_calls(F.col("html")).alias("calls"))
