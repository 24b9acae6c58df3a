"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.functions import text as T
from quernstone.functions import vector as V
from quernstone.plans import common as C
from quernstone.plans.registry import register
from quernstone.session import table


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@register("str_escapes", r"""
SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_')) AS like_sum,
       md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS xml_sum,
       md5(replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS attribute_sum,
       md5(replace(text, ']]>', ']]]]><![CDATA[>')) AS cdata_sum FROM documents
""")
def escapes(spark, sf_dir):
    """STR1, STR3, STR4."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.like_literal("text")).alias("like_sum"), F.md5(T.xml_text("text")).alias("xml_sum"), F.md5(T.xml_attribute("text")).alias("attribute_sum"), F.md5(T.cdata_guard("text")).alias("cdata_sum"))


@register("str2_phrase_query", f"""
WITH {C.QUERIES_SQL} SELECT query_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: '"' || replace(x, '"', '""') || '"'), ' OR ') AS phrase FROM queries
""")
def str2(spark, sf_dir):
    return C.queries(spark, sf_dir).select("query_id", T.phrase_query("text").alias("phrase"))


@register("str5_truncate", f"""
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS sum FROM (
  SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE left(text, {2000 - len(fixed.TRUNCATION_SUFFIX)}) || '{fixed.TRUNCATION_SUFFIX}' END AS t FROM documents)
""")
def str5(spark, sf_dir):
    out = T.truncated("text", 2000)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(out).cast("long").alias("n_chars"), F.md5(out).alias("sum"))


@register("str7_stub_summary", """
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1] AS s FROM documents),
p AS (SELECT doc_id, s, list_filter(list_transform(range(1, 118), lambda n: left(s, n)), lambda x: strlen(x) <= 117) AS cuts FROM l)
SELECT doc_id, CASE WHEN s IS NULL THEN '(no summary)' WHEN strlen(s) > 120 THEN list_max(list_transform(cuts, lambda x: lpad(length(x)::VARCHAR, 4, '0') || x))[5:] || '...' ELSE s END AS summary FROM p
""")
def str7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.stub_summary("text").alias("summary"))


@register("str8_json_summary", """
WITH p AS (SELECT doc_id, text, CASE WHEN strlen(text) > 500 THEN list_filter(list_transform(range(1, 498), lambda n: left(text, n)), lambda x: strlen(x) <= 497) END AS cuts FROM documents)
SELECT doc_id, md5(CASE WHEN strlen(text) > 500 THEN list_max(list_transform(cuts, lambda x: lpad(length(x)::VARCHAR, 4, '0') || x))[5:] || '...' ELSE text END) AS summary FROM p
""")
def str8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.json_summary("text")).alias("summary"))


@register("str21_context_snippet", """
WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS s FROM documents),
p AS (SELECT doc_id, s, list_filter(list_transform(range(1, 81), lambda n: left(s, n)), lambda x: strlen(x) <= 80) AS cuts FROM l)
SELECT doc_id, CASE WHEN strlen(s) > 80 THEN list_max(list_transform(cuts, lambda x: lpad(length(x)::VARCHAR, 4, '0') || x))[5:] || '...' ELSE s END AS snippet FROM p
""")
def str21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.context_snippet("text").alias("snippet"))


_BARE = r"regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"


def keywords_sql(column: str) -> str:
    kept = f"list_filter(regexp_split_to_array(lower({column}), '\\s+'), lambda x: strlen(x) > 2 AND NOT list_contains([{_quoted(fixed.STOPWORDS)}], {_BARE}))"
    return f"list_filter(list_transform({kept}, lambda x: {_BARE}), lambda x: x <> '')"


@register("str9_keywords", f"SELECT item_id, {keywords_sql('text')} AS keywords FROM benchmark")
def str9(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.keywords("text").alias("keywords"))


def _redacted_sql(column: str) -> str:
    for p in fixed.REDACT:
        column = f"regexp_replace({column}, '{p}', '{fixed.REDACTED}', 'g')"
    return column


_LEAK = r"'C:\Users\ann\x /home/bob/y sk-' || left(md5(text), 24) || ' AKIA' || upper(left(md5(text), 16)) || ' -----BEGIN RSA PRIVATE KEY-----'"


@register("str10_redaction", f"SELECT doc_id, {_redacted_sql(_LEAK)} AS leak, md5({_redacted_sql('text')}) AS sum FROM documents")
def str10(spark, sf_dir):
    sums = F.md5("text")
    leak = F.concat(F.lit("C:\\Users\\ann\\x /home/bob/y sk-"), F.left(sums, F.lit(24)), F.lit(" AKIA"), F.upper(F.left(sums, F.lit(16))), F.lit(" -----BEGIN RSA PRIVATE KEY-----"))
    return table(spark, sf_dir, "documents").select("doc_id", T.redacted(leak).alias("leak"), F.md5(T.redacted("text")).alias("sum"))


def _any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _domain_sql(c: str) -> str:
    rules = " ".join(f"WHEN {_any(f'lower({c})', parts)} THEN '{name}'" for name, parts in fixed.DOMAIN_RULES)
    return f"""CASE WHEN starts_with({c}, 'web/') THEN CASE WHEN lower(split_part({c}, '/', 2)) IN ('rust_std', 'react_docs') THEN lower(split_part({c}, '/', 2)) ELSE 'external_docs' END
    WHEN starts_with({c}, 'https://') THEN CASE WHEN contains(lower({c}), 'rust-lang.org') THEN 'rust_std' WHEN {_any(f'lower({c})', ('react.dev', 'reactjs.org'))} THEN 'react_docs' ELSE 'external_docs' END
    {rules} ELSE 'general' END"""


def _web_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(f'lower({c})', parts)} THEN '{name}'" for name, parts in fixed.WEB_RULES) + " ELSE 'external' END"


#: Literal sources that reach every branch of the classifiers.
SOURCES = (
    "web/rust_std/https://doc.rust-lang.org/std", "web/React_Docs/x", "web/other/x", "https://doc.rust-lang.org/book", "https://react.dev/learn", "https://example.org/a",
    "src/Payment/x.rs", "src/billing.rs", "src/db.rs", "src/store.rs", "src/route.rs", "src/session.rs", "src/client.rs", "src/spec.rs", "src/main.rs",
    "https://stackoverflow.com/q/1", "https://docs.python.org/3/", "https://github.com/a/b", "https://medium.com/@a/b", "https://blog.example.org/", "http://localhost:80/",
    "https://10.1.2.3/x", "https://172.16.0.1/", "https://172.32.0.1/", "https://192.168.1.1/", "https://169.254.1.1/", "https://100.64.0.1/", "https://100.128.0.1/",
    "https://[::1]/", "https://[fd00::1]/", "https://[fe80::1]/", "https://[2001:db8::1]/", "https://user@127.0.0.1/", "ftp://example.org/",
)
_SOURCES_SQL = "sources AS (SELECT unnest([" + _quoted(SOURCES) + "]) AS source UNION ALL SELECT url FROM pages UNION ALL SELECT DISTINCT source FROM documents)"


def _sources(spark, sf_dir):
    fixed_rows = spark.range(1).select(F.explode(F.array(*map(F.lit, SOURCES))).alias("source"))
    return fixed_rows.unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("source"))).unionByName(table(spark, sf_dir, "documents").select("source").distinct())


@register("str13_domain", f"WITH {_SOURCES_SQL} SELECT source, {_domain_sql('source')} AS domain FROM sources")
def str13(spark, sf_dir):
    return _sources(spark, sf_dir).select("source", T.domain_of("source").alias("domain"))


@register("str14_web_kind", f"WITH {_SOURCES_SQL} SELECT source, {_web_sql('source')} AS kind FROM sources")
def str14(spark, sf_dir):
    return _sources(spark, sf_dir).select("source", T.web_kind("source").alias("kind"))


@register("flt13_private_host", f"""
WITH {_SOURCES_SQL}, h AS (SELECT source, lower(regexp_extract(source, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\\[[^\\]]*\\]|[^/:?#]*)', 1)) AS host FROM sources),
o AS (SELECT *, CASE WHEN regexp_matches(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') THEN split_part(host, '.', 1)::INT END AS a, CASE WHEN regexp_matches(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') THEN split_part(host, '.', 2)::INT END AS b FROM h),
p AS (SELECT source, host = 'localhost' OR ends_with(host, '.localhost') OR coalesce(a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127), false)
  OR regexp_matches(host, '^\\[(::1|f[cd][0-9a-f]{{0,2}}:.*|fe[89ab][0-9a-f]?:.*)\\]$') AS private FROM o)
SELECT source, private, starts_with(lower(source), 'https://') AND NOT private AS may_fetch FROM p
""")
def flt13(spark, sf_dir):
    return _sources(spark, sf_dir).select("source", T.is_private_host("source").alias("private"), T.may_fetch("source").alias("may_fetch"))


@register("str22_chunk_number", r"""
WITH i AS (SELECT unnest(['a#0', 'a/b#12', 'a#b#3', 'a#detail0', 'a', 'a#']) AS id UNION ALL SELECT doc_id || '#' || (doc_id % 7) FROM documents)
SELECT id, TRY_CAST(regexp_extract(id, '#([^#]*)$', 1) AS INT) AS number, regexp_replace(id, '#[^#]*$', '') AS source FROM i
""")
def str22(spark, sf_dir):
    fixed_rows = spark.range(1).select(F.explode(F.array(*map(F.lit, ("a#0", "a/b#12", "a#b#3", "a#detail0", "a", "a#")))).alias("id"))
    ids = fixed_rows.unionByName(table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), (F.col("doc_id") % 7).cast("string")).alias("id")))
    return ids.select("id", T.chunk_number("id").alias("number"), T.chunk_source("id").alias("source"))


@register("str_names", r"""
SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 64) AS slug,
       trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9 -]+', ' ', 'g'), ' +', ' ', 'g')) AS query, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS graph_id, replace(url, '\', '/') AS path FROM pages
""")
def names(spark, sf_dir):
    """STR18, STR19, STR23, STR32."""
    return table(spark, sf_dir, "pages").select("page_id", T.slug("url").alias("slug"), T.name_query("url").alias("query"), T.graph_id("url").alias("graph_id"), T.display_path("url").alias("path"))


@register("str_meta", """
SELECT doc_id, length(text) // 4 AS estimate, chr(10) || chr(10) || '_meta: { "chunks_returned": ' || (doc_id % 7) || ', "tokens_estimated": ' || (length(text) // 4) || '}' AS meta, '{"t":"' || source || '"}' AS compact FROM documents
""")
def meta(spark, sf_dir):
    """STR26, STR27, STR28."""
    estimate = T.token_estimate("text")
    return table(spark, sf_dir, "documents").select("doc_id", estimate.alias("estimate"), T.meta_line("chunks_returned", F.col("doc_id") % 7, estimate).alias("meta"), T.compact("source").alias("compact"))


@register("str25_verdict", """
WITH a AS (SELECT conv_id * 1000 + turn AS id, (['[INGEST=TRUE]', '[ingest=false]', '', '[INGEST=TRUE] [INGEST=FALSE]'])[(turn % 4 + 1)::INT] || chr(10) || text AS answer FROM conversations),
t AS (SELECT id, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS r FROM a)
SELECT id, CASE WHEN NOT contains(upper(r), '[INGEST=FALSE]') AND NOT contains(upper(r), '[INGEST=TRUE]') THEN true ELSE contains(upper(r), '[INGEST=TRUE]') AND NOT contains(upper(r), '[INGEST=FALSE]') END AS ingest,
       coalesce(list_filter(list_transform(string_split(r, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(upper(x), '[INGEST='))[1], 'No reason given.') AS reason FROM t
""")
def str25(spark, sf_dir):
    marks = F.array(*map(F.lit, ("[INGEST=TRUE]", "[ingest=false]", "", "[INGEST=TRUE] [INGEST=FALSE]")))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.element_at(marks, (F.col("turn") % 4 + 1).cast("int")), F.lit("\n"), "text").alias("answer"))
    return rows.select("id", T.verdict("answer").alias("v")).select("id", "v.ingest", "v.reason")


@register("str15_front_matter", r"""
WITH s AS (SELECT doc_id, '---' || chr(10) || 'name: ' || source || ': x' || chr(10) || 'description: About ' || lang || chr(10) || 'tags: a, b ,' || lang || chr(10) || 'domain: d' || chr(10) || '---' || chr(10) || text AS body FROM documents)
SELECT doc_id, trim(regexp_extract(body, 'name:([^:\n]*)', 1)) AS name, trim(regexp_extract(body, 'description:([^:\n]*)', 1)) AS description, 'd' AS domain, NULL::VARCHAR AS category,
       list_transform(string_split(regexp_extract(body, 'tags:([^:\n]*)', 1), ','), lambda x: trim(x)) AS tags FROM s
""")
def str15(spark, sf_dir):
    body = F.concat(F.lit("---\nname: "), "source", F.lit(": x\ndescription: About "), "lang", F.lit("\ntags: a, b ,"), "lang", F.lit("\ndomain: d\n---\n"), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return rows.select("doc_id", *[c.alias(n) for n, c in T.front_matter("body").items()])


@register("str17_skill_validation", """
WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'name: a' || chr(10) || 'description: b' || chr(10) || '---' || chr(10) || '## Purpose' || chr(10) WHEN 1 THEN '---' || chr(10) || 'x: a' || chr(10) || '---' || chr(10) ELSE '' END || text AS body FROM documents)
SELECT doc_id, doc_id % 3 <> 1 AS valid, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS n_errors,
       (strlen(body) > 50000)::INT + (doc_id % 3 = 2)::INT + (NOT contains(body, '## Purpose'))::INT + (NOT contains(body, '## When to use'))::INT AS n_warnings FROM s
""")
def str17(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 3 == 0, "---\nname: a\ndescription: b\n---\n## Purpose\n").when(F.col("doc_id") % 3 == 1, "---\nx: a\n---\n").otherwise("")
    found = T.skill_findings(F.concat(lead, "text"))
    return table(spark, sf_dir, "documents").select("doc_id", found["valid"].alias("valid"), F.size(found["errors"]).alias("n_errors"), F.size(found["warnings"]).alias("n_warnings"))


@register("flt12_ui_lint", f"""
SELECT page_id, list_filter([{', '.join(f"CASE WHEN contains(html, '{s}') THEN 'Forbidden shadow: {s} (use shadow-sm at most per DESIGN_AXIOMS)' END" for s in fixed.FORBIDDEN_SHADOWS)},
  CASE WHEN len(regexp_extract_all(html, 'w-full')) >= 2 AND NOT (contains(html, 'flex-row') OR (contains(html, 'grid') AND (contains(html, 'grid-cols') OR contains(html, 'lg:grid')))) THEN 'Stacking red flag: multiple w-full without horizontal layout (add flex flex-row or grid with columns for desktop per DESIGN_AXIOMS)' END], lambda x: x IS NOT NULL) AS violations
FROM (SELECT page_id, html || (['<p class="shadow-md w-full"><b class="w-full shadow-xl">', '<p class="w-full flex-row w-full">', ''])[(page_id % 3 + 1)::INT] AS html FROM pages)
""")
def flt12(spark, sf_dir):
    tails = F.array(*map(F.lit, ('<p class="shadow-md w-full"><b class="w-full shadow-xl">', '<p class="w-full flex-row w-full">', "")))
    html = F.concat("html", F.element_at(tails, (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", T.ui_findings(html).alias("violations"))


@register("dt1_unix_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, floor((epoch(TIMESTAMP '2024-08-01') - floor(epoch(ts))) / 86400)::BIGINT AS age_days FROM events")
def dt1(spark, sf_dir):
    """DT1 and DT2, against a given day."""
    at = F.unix_seconds("ts")
    return C.events(spark, sf_dir).select("event_id", T.unix_day(at).alias("day"), F.floor((F.unix_seconds(F.expr("TIMESTAMP '2024-08-01'")) - at) / 86_400).alias("age_days"))


@register("mt4_backoff", "SELECT event_id, least(50 * pow(2, event_id % 12), 400)::BIGINT AS wait_ms FROM events")
def mt4(spark, sf_dir):
    """The wait before a repeat of each event, which stands for the attempt of its number."""
    return table(spark, sf_dir, "events").select("event_id", V.backoff_ms(F.col("event_id") % 12 + 1).alias("wait_ms"))


@register("js1_json_list", """
SELECT event_id, coalesce(TRY_CAST(CASE event_id % 3 WHEN 0 THEN '["a","b' || event_id || '"]' WHEN 1 THEN '[]' ELSE NULL END AS VARCHAR[]), []) AS items, (json_extract(props, '$.k'))::BIGINT AS k FROM (SELECT event_id, props FROM events)
""")
def js1(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a","b'), F.col("event_id").cast("string"), F.lit('"]'))).when(F.col("event_id") % 3 == 1, "[]").otherwise("not json")
    items = F.transform(T.json_list(raw), lambda x: F.when(F.col("event_id") % 3 == 0, F.when(x == "a", F.lit('"a"')).otherwise(F.concat(F.lit('"'), x, F.lit('"')))).otherwise(x))
    items = F.transform(items, lambda x: F.regexp_replace(x, '"', ""))
    return C.events(spark, sf_dir).select("event_id", items.alias("items"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("js2_canonical_hash", """
SELECT event_id, left(sha256('{"a":"' || event_type || '","b":"' || replace(replace(props, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '"}'), 16) AS args_hash FROM events
""")
def js2(spark, sf_dir):
    """Hash of a call's arguments in key order, whatever order they came in."""
    rows = C.events(spark, sf_dir)
    args = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.col("props"), F.col("event_type")))
    return rows.select("event_id", T.canonical_hash(args).alias("args_hash"))


@register("hs1_config_hash", "SELECT doc_id, sha256('chunk=' || n_chars || chr(10) || 'model=' || lang || chr(10) || 'overlap=' || source) AS config_hash FROM documents")
def hs1_config(spark, sf_dir):
    """A configuration for each document, its columns standing for the settings."""
    settings = {"overlap": F.col("source"), "chunk": F.col("n_chars").cast("string"), "model": F.col("lang")}
    return table(spark, sf_dir, "documents").select("doc_id", T.config_hash(settings).alias("config_hash"))


@register("hs1_content_hash", r"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_hash FROM documents")
def hs1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("content_hash"))


@register("hs2_list_checksum", "SELECT lang, sha256(string_agg(source, chr(10) ORDER BY source)) AS checksum FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def hs2(spark, sf_dir):
    names = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return names.select("lang", F.sha2(F.array_join("s", "\n"), 256).alias("checksum"))


@register("str24_html_markdown")
def str24(spark, sf_dir):
    """Main content of pages as Markdown; tests hold it against known pages."""
    from quernstone.sources.html import page_markdown

    return table(spark, sf_dir, "pages").select("page_id", page_markdown("url", "html").alias("markdown"))


@register("str16_first_words", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:100], ' ') AS words FROM documents")
def str16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.words("text"), 1, 100), " ").alias("words"))


@register("str16_skill_content", f"""
WITH w AS (SELECT doc_id, text, {C.WORDS.format('text')} AS w FROM documents)
SELECT doc_id, md5(CASE WHEN len(w) > {fixed.MAX_SKILL_WORDS} THEN array_to_string(w[1:{fixed.MAX_SKILL_WORDS}], ' ') || '{fixed.TRUNCATION_SUFFIX}' ELSE text END) AS sum FROM w
""")
def str16_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.skill_content("text")).alias("sum"))


@register("str6_token_budget", f"""
WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)
SELECT doc_id, md5(CASE WHEN n <= 195 THEN text ELSE regexp_extract(text, '^[\\x20\\x09-\\x0D]*([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+){{195}}') || '{fixed.TRUNCATION_SUFFIX}' END) AS sum FROM c
""")
def str6(spark, sf_dir):
    """Texts within 199 tokens, words being the tokens; the suffix has four of the 199."""
    from quernstone.functions.budget import truncated_tokens

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(truncated_tokens(199)("text")).alias("sum"))


@register("str6_tokenizer_budget")
def str6_tokenizer(spark, sf_dir):
    """Texts within 256 tokens of a public byte-level vocabulary, suffix included."""
    import public_tokenizers

    from quernstone.functions.budget import within_budget

    cut = within_budget(256, public_tokenizers.path("byte_bpe_50k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", cut("text").alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("sum"))


@register("str20_front_matter_repair", """
SELECT doc_id, '---' || chr(10) || 'name: ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'description: "use: ' || lang || '"' || chr(10) || 'tags: ["a: b", ' || lang || ', "#c"]' ELSE 'description: plain' || chr(10) || 'tags: [a, b]' END || chr(10) || '---' || chr(10) || 'body' AS content FROM documents
""")
def str20(spark, sf_dir):
    from quernstone.functions.front_matter import repaired_front_matter

    even = F.col("doc_id") % 2 == 0
    head = F.when(even, F.concat(F.lit("description: use: "), "lang", F.lit("\ntags: [a: b, "), "lang", F.lit(", #c]"))).otherwise("description: plain\ntags: [a, b]")
    content = F.concat(F.lit("---\nname: "), "source", F.lit("\n"), head, F.lit("\n---\nbody"))
    return table(spark, sf_dir, "documents").select("doc_id", repaired_front_matter(content).alias("content"))


@register("str27_meta_cost", """
SELECT doc_id, chr(10) || chr(10) || '_meta: { "chunks_returned": ' || doc_id || ', "tokens_estimated": ' || length(text) // 4 || ', "cost_avoided_usd": ' || printf('%.6f', (length(text) // 4)::DOUBLE / 1000000 * 3.0) || '}' AS line FROM documents
""")
def str27(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.meta_line("chunks_returned", "doc_id", T.token_estimate("text"), 3.0).alias("line"))


_COMMANDS = ("git push origin", "git commit -m 'fix it' --amend", "git log", "Cargo.EXE build", "cargo uninstall x", "npm Uninstall y", "rm -rf /", "grep -f x", "git status -F", "ls")


@register("flt14_commands", f"""
WITH c AS (SELECT event_id, ([{_quoted(_COMMANDS)}])[(event_id % {len(_COMMANDS)} + 1)::INT] AS command FROM events),
w AS (SELECT event_id, command, list_transform(string_split(command, ' '), lambda x: lower(x)) AS w FROM c),
p AS (SELECT *, lower(regexp_replace(string_split(command, ' ')[1], '[.]exe$', '')) AS program FROM w)
SELECT event_id, command, program IN ({_quoted(fixed.SHELL_PROGRAMS)}) AS allowed,
       NOT (program = 'git' AND (w[2] IN ('push', 'clean', 'rebase') OR list_has_any(w[2:], [{_quoted(fixed.BLOCKED_GIT_FLAGS)}]))) AND NOT (program IN ('cargo', 'npm') AND w[2] = 'uninstall') AS safe
FROM p
""")
def flt14(spark, sf_dir):
    from quernstone.functions import arguments as A

    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % len(_COMMANDS) + 1).cast("int"))
    words = A.argv("command")
    return C.events(spark, sf_dir).select("event_id", command.alias("command")).select("event_id", "command", A.program_allowed(words).alias("allowed"), A.arguments_safe(words).alias("safe"))


_CALLS = (
    ("security_audit", '{"path": "sub/x"}', ()), ("security_audit", '{"path": "../out"}', ("Path not under ALLOWED_ROOTS: ../out",)),
    ("refresh_file_index", '{"paths": ["/srv/a/b", "/etc", "c/../../d"]}', ("Path not under ALLOWED_ROOTS: /etc", "Path not under ALLOWED_ROOTS: c/../../d")),
    ("module_graph", '{"workspace_path": " "}', ()), ("module_graph", '{"workspace_path": "/srv/ab"}', ("workspace_path not under ALLOWED_ROOTS: /srv/ab",)),
    ("get_file_history", '{"other": 1}', ()), ("scan", '{"path": "/etc"}', ()), ("compile_rules", "not json", ()),
)


@register("flt15_tool_arguments", f"""
WITH c AS (SELECT * FROM (VALUES {', '.join(f"({k}, {_quoted([tool])}, [{_quoted(warnings)}]::VARCHAR[])" for k, (tool, _, warnings) in enumerate(_CALLS))}) t(k, tool, warnings))
SELECT event_id, tool, len(warnings) = 0 AS valid, warnings FROM events JOIN c ON event_id % {len(_CALLS)} = k
""")
def flt15(spark, sf_dir):
    from quernstone.functions import arguments as A

    nth = (F.col("event_id") % len(_CALLS) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in _CALLS]), nth)
    rows = C.events(spark, sf_dir).select("event_id", pick(0).alias("tool"), pick(1).alias("arguments"))
    warned = rows.withColumn("warnings", A.tool_warnings(F.col("tool"), F.col("arguments"), ["/srv/a"]))
    return warned.select("event_id", "tool", (F.size("warnings") == 0).alias("valid"), "warnings")


@register("ar1_arrays", f"""
WITH t AS (SELECT doc_id, {C.TOKENS.format('text')} AS w FROM documents)
SELECT doc_id, list_contains(w, 'the') AS has, list_has_any(w, ['und', 'de']) AS meets, w[1:3] AS first_, list_position(w, 'the')::BIGINT AS at_ FROM t
""")
def ar1(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("w"))
    the = F.array_position("w", "the")
    return words.select(
        "doc_id", F.array_contains("w", "the").alias("has"), F.arrays_overlap("w", F.array(F.lit("und"), F.lit("de"))).alias("meets"),
        F.slice("w", 1, 3).alias("first_"), F.when(the > 0, the).alias("at_"),
    )
