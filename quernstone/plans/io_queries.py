"""Queries over files, sinks and streams: tables are written in a format, then read, merged
or streamed by the engine, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import fixed
from quernstone.functions import text as T
from quernstone.plans import common as C
from quernstone.plans.registry import register
from quernstone.session import table
from quernstone.sources import index, readers, sinks, tree_source
from quernstone.storage import Scratch
from quernstone.streaming import incremental, loop_state


def _lines(df, path: str, mode: str = "error") -> str:
    df.write.mode(mode).text(path)
    return path


def _json(df):
    return df.select(F.to_json(F.struct("*")).alias("value"))


@register("src1_tree", "SELECT doc_id FROM documents")
def src1(spark, sf_dir):
    """Documents lie in text files of a tree; pages lie in folders that are skipped."""
    scratch = Scratch(spark, "tree")
    few = lambda df, path: df.write.option("maxRecordsPerFile", 50_000).text(scratch.path(path))
    few(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("value")), "root/a/b")
    few(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("value")), "root/node_modules/c")
    few(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("value")), "root/a/target")
    lines = readers.read_tree(spark, scratch.path("root")).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").select(F.col("line").cast("long").alias("doc_id"))


@register("src1_tree_source", "SELECT doc_id FROM documents")
def src1_source(spark, sf_dir):
    """The same tree through the data source, in two runs of a stream: it grows between."""
    scratch = Scratch(spark, "source")
    tree_source.register(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("value"))
    for k, kept in enumerate((F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)):
        docs.where(kept).select("value").write.option("maxRecordsPerFile", 50_000).text(scratch.path(f"root/a/b{k}"))
        docs.where(kept).select("value").write.text(scratch.path(f"root/node_modules/b{k}"))
        stream = spark.readStream.format("source_tree").option("path", scratch.path("root")).load()
        found = _streamed(spark, scratch, stream, "out", tree_source.SCHEMA)
    lines = found.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").select(F.col("line").cast("long").alias("doc_id"))


@register("src3_jsonl", f"SELECT doc_id::VARCHAR AS source, 0 AS chunk_idx, md5(text) AS sum FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> '' AND strlen(text) <= {fixed.MAX_FILE_BYTES} UNION ALL SELECT 'page' || page_id, k, md5(([url, 'x'])[k + 1]) FROM pages, range(2) t(k)")
def src3(spark, sf_dir):
    scratch = Scratch(spark, "jsonl")
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    _lines(_json(docs.where("lang = 'en'").select(key.alias("path"), "text")), scratch.path("in"))
    _lines(_json(docs.where("lang <> 'en'").select(key.alias("source"), F.col("text").alias("content"))), scratch.path("in"), "append")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), F.array("url", F.lit("x"), F.lit(" ")).alias("chunks"))
    _lines(_json(pages), scratch.path("in"), "append")
    _lines(spark.range(3).select(F.lit("not json").alias("value")), scratch.path("in"), "append")
    return readers.read_jsonl(spark, scratch.path("in")).select("source", "chunk_idx", F.md5("text").alias("sum"))


@register("src4_web_sources", "SELECT url, regexp_extract(url, '//([^/]+)', 1) AS domain FROM pages WHERE starts_with(url, 'https://')")
def src4(spark, sf_dir):
    """Each host's list is one file with a JSON array."""
    scratch = Scratch(spark, "web")
    host = F.regexp_extract("url", "//([^/]+)", 1)
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("url", host.alias("domain"))
    lists = pages.groupBy("domain").agg(F.to_json(F.collect_list(F.struct("url", "domain"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(scratch.path("in"))
    return readers.read_web_sources(spark, scratch.path("in"))


@register("src5_manifest_flatten", "SELECT source AS domain, 'https://h/' || doc_id AS url FROM documents WHERE lang = 'en' UNION ALL SELECT 'd' || doc_id, 'https://one/' || doc_id FROM documents")
def src5(spark, sf_dir):
    """A manifest a document: its own URL alone, and a list, with one that isn't https."""
    url = lambda host: F.concat(F.lit(host), F.col("doc_id").cast("string"))
    many = F.concat(F.lit('{"'), "source", F.lit('": ["'), F.when(F.col("lang") == "en", url("https://h/")).otherwise(url("http://h/")), F.lit('", "ftp://x"], "d'), F.col("doc_id").cast("string"), F.lit('": "'), url("https://one/"), F.lit('"}'))
    return readers.flat_manifest(table(spark, sf_dir, "documents").select(many.alias("doc")), "doc")


@register("src6_training_log", f"WITH {C.TURNS_SQL} SELECT md5(query) AS query, md5(context) AS context, md5(response) AS response, 'code' AS domain, pos AS ts FROM turns")
def src6(spark, sf_dir):
    scratch = Scratch(spark, "training")
    rows = C.turns(spark, sf_dir).select("query", "context", "response", F.lit("code").alias("domain"), F.col("pos").alias("ts"))
    _lines(_json(rows), scratch.path("log"))
    _lines(spark.range(3).select(F.lit("{broken").alias("value")), scratch.path("log"), "append")
    return readers.read_training(spark, scratch.path("log")).select(*[F.md5(c).alias(c) for c in ("query", "context", "response")], "domain", "ts")


@register("src7_design_tokens", "SELECT '\"' || p_name AS name, p_brand || '\"' AS value, p_type AS kind, p_size::VARCHAR AS size FROM part")
def src7(spark, sf_dir):
    """Quotes don't keep a comma from parting fields."""
    scratch = Scratch(spark, "tokens")
    line = F.concat(F.lit('"'), "p_name", F.lit(","), "p_brand", F.lit('",'), "p_type", F.lit(","), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(line.alias("value"))
    # every file has a head and a line with too few fields
    rows = rows.repartition(1).select(F.explode(F.when(F.monotonically_increasing_id() == 0, F.array(F.lit("name,value,kind,size"), F.lit("alone"), F.col("value"))).otherwise(F.array("value"))).alias("value"))
    return readers.read_design_csv(spark, _lines(rows, scratch.path("in")), ["name", "value", "kind", "size"], 4)


@register("src8_skills", "SELECT 'Skill of ' || item_id AS name, array_to_string(list_filter(regexp_split_to_array(split_part(text, ':', 1), '\\s+'), lambda x: x <> '')[1:100], ' ') AS description, 'en' AS domain, ['a', 't' || item_id] AS tags FROM (SELECT item_id, split_part(replace(text, chr(13), chr(10)), chr(10), 1) AS text FROM benchmark)")
def src8(spark, sf_dir):
    """Each benchmark item is a skill file; one lies too deep to count."""
    scratch = Scratch(spark, "skills")
    first = F.split(F.replace("text", F.lit("\r"), F.lit("\n")), "\n")[0]
    number = F.col("item_id").cast("string")
    body = F.concat(F.lit("---\nname: Skill of "), number, F.lit("\ndescription: "), first, F.lit("\ndomain: en\ntags: a, t"), number, F.lit("\n---\n"), "text")
    items = table(spark, sf_dir, "benchmark").select(body.alias("value"))
    for place, rows in (("root/one", items), ("root/one/two/three", items.limit(1))):
        rows.write.mode("append").option("maxRecordsPerFile", 1).text(scratch.path(place))
    _rename(spark, scratch.path("root"), ".txt", ".md")
    return readers.read_skills(spark, scratch.path("root")).select("name", "description", "domain", "tags")


def _rename(spark, root: str, old: str, new: str) -> None:
    """Gives the files of a folder another extension."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.listFiles(path, True)
    names = []
    while found.hasNext():
        names.append(found.next().getPath())
    for name in names:
        if name.getName().endswith(old):
            files.rename(name, jvm.org.apache.hadoop.fs.Path(name.getParent(), name.getName().removesuffix(old) + new))


@register("src9_cargo", "SELECT doc_id, unnest(['dep' || doc_id, lang, 'tool', 'os']) AS name, unnest([doc_id::VARCHAR, '2.' || doc_id, '9', '3']) AS version FROM documents")
def src9(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("[dependencies]\ndep"), number, F.lit(' = "'), number, F.lit('"\n'), F.col("lang"), F.lit(' = { version = "2.'), number, F.lit('" }\nlocal = { path = "x" }\n'),
        F.lit("[dev-dependencies]\ndep"), number, F.lit(' = "no"\ntool = "9"\n[target.x.dependencies]\nos = "3"\n'),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(readers.cargo_dependencies(text)).alias("name", "version"))


@register("src10_package", """
SELECT doc_id, 'p' || doc_id AS name, ['build', 'test'] AS scripts, list_sort(list_transform(range(doc_id % 30), lambda k: 'd' || k))[1:20] AS dependencies, (doc_id % 30)::BIGINT AS total FROM documents
""")
def src10(spark, sf_dir):
    names = F.when(F.col("doc_id") % 30 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 30 - 1), lambda k: F.concat(F.lit('"d'), k.cast("string"), F.lit('": "1"'))))
    text = F.concat(F.lit('{"name": "p'), F.col("doc_id").cast("string"), F.lit('", "scripts": {"test": "x", "build": "y"}, "dependencies": {'), F.array_join(names, ", "), F.lit("}}"))
    return table(spark, sf_dir, "documents").select("doc_id", readers.package_summary(text).alias("s")).select("doc_id", "s.*")


@register("snk1_index_write", """
WITH n AS (SELECT doc_id, quality FROM labels), old AS (SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n))
SELECT 'chunks' AS tbl, doc_id AS source, lang AS value FROM old UNION ALL SELECT 'chunks', doc_id, 'new' FROM n WHERE quality = 1
UNION ALL SELECT 'vectors', vec_id, floor(embedding[1]::DOUBLE * 1000000)::BIGINT::VARCHAR FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT 'vectors', doc_id, '9' FROM n WHERE quality = 1
UNION ALL SELECT 'symbols', doc_id, source FROM old UNION ALL SELECT 'symbols', doc_id, 'new' FROM n WHERE quality = 1
UNION ALL SELECT 'refs', doc_id, lang || source FROM old UNION ALL SELECT 'refs', doc_id, 'new' FROM n WHERE quality = 1
UNION ALL SELECT 'summaries', doc_id, 'of ' || source FROM old UNION ALL SELECT 'summaries', doc_id, 'new' FROM n WHERE quality = 1
""")
def snk1_index(spark, sf_dir):
    """Five tables of an index change as one: labelled sources are replaced (quality 1) or
    leave (quality 0)."""
    root = Scratch(spark, "index").path("index")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "source")
    one = lambda value: docs.select(F.col("doc_id").alias("source"), value.alias("value"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), F.floor(F.col("embedding")[0].cast("double") * 1_000_000).alias("value"))
    index.write_index(spark, root, {"chunks": one(F.col("lang")), "vectors": vectors, "symbols": one(F.col("source")), "refs": one(F.concat("lang", "source")), "summaries": one(F.concat(F.lit("of "), "source"))})
    new = labels.where("quality = 1").select("source", F.lit("new").alias("value"))
    changes = dict.fromkeys(("chunks", "symbols", "refs", "summaries"), new) | {"vectors": new.withColumn("value", F.lit(9).cast("long"))}
    index.write_index(spark, root, changes, gone=labels.where("quality = 0").select("source"))
    out = None
    for name in ("chunks", "vectors", "symbols", "refs", "summaries"):
        rows = index.read_index(spark, root, name).select(F.lit(name).alias("tbl"), "source", F.col("value").cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("snk1_versions", """
WITH n AS (SELECT doc_id, quality FROM labels)
SELECT v.version, 'chunks' AS tbl, doc_id AS source, CASE WHEN v.version > 1 AND doc_id IN (SELECT doc_id FROM n) THEN 'new' ELSE lang END AS value
FROM documents, (VALUES (1), (2), (3), (4)) v(version) WHERE v.version < 3 OR doc_id NOT IN (SELECT doc_id FROM n WHERE quality = 0)
UNION ALL SELECT v.version, 'refs', doc_id, source FROM documents, (VALUES (1), (2), (3), (4)) v(version)
WHERE v.version = 1 OR doc_id NOT IN (SELECT doc_id FROM n)
""")
def snk1_versions(spark, sf_dir):
    """Four versions of an index: all documents; labelled ones anew in one table, whose
    references go; those of quality 0 gone; and the same compacted. Each reads as it was."""
    root = Scratch(spark, "versions").path("index")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "source")
    one = lambda value: docs.select(F.col("doc_id").alias("source"), F.col(value).alias("value"))
    index.write_index(spark, root, {"chunks": one("lang"), "refs": one("source")})
    new = labels.join(one("lang").select("source"), "source", "left_semi").select("source", F.lit("new").alias("value"))
    index.write_index(spark, root, {"chunks": new})
    index.write_index(spark, root, {}, gone=labels.where("quality = 0").select("source"))
    index.compact(spark, root)
    out = None
    for version in index.versions(spark, root):
        for name in ("chunks", "refs"):
            rows = index.read_index(spark, root, name, version).select(F.lit(version).alias("version"), F.lit(name).alias("tbl"), "source", "value")
            out = rows if out is None else out.unionByName(rows)
    return out


@register("snk2_single_rows", """
SELECT 'chunk' AS tbl, doc_id AS id, lang AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'chunk', doc_id, 'new' FROM labels
UNION ALL SELECT 'vector', vec_id, 'old' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'vector', doc_id, 'new' FROM labels WHERE quality = 1
""")
def snk2(spark, sf_dir):
    """Labelled documents come in anew, those of quality 0 without an embedding."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("new").alias("value"), F.when(F.col("quality") == 1, F.array(F.lit(7.0).cast("float"))).alias("embedding"))
    chunks, vectors = sinks.upserted_chunks(chunks, vectors, rows)
    marked = vectors.select(F.lit("vector").alias("tbl"), "id", F.when(F.size("embedding") == 1, "new").otherwise("old").alias("value"))
    return chunks.select(F.lit("chunk").alias("tbl"), "id", "value").unionByName(marked)


@register("snk3_manifest", "SELECT doc_id::VARCHAR AS source, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_hash FROM documents")
def snk3(spark, sf_dir):
    """A manifest of another configuration counts as empty."""
    scratch = Scratch(spark, "manifest")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), T.content_hash("text").alias("content_hash"))
    sinks.save_manifest(rows, scratch.path("m"), "c1")
    return sinks.load_manifest(spark, scratch.path("m"), "c1").unionByName(sinks.load_manifest(spark, scratch.path("m"), "c2")).select("source", "content_hash")


@register("snk4_log", "SELECT conv_id, turn, role, md5(text) AS sum, k::BIGINT AS run FROM conversations, range(2) t(k)")
def snk4(spark, sf_dir):
    """ST3 as well: two runs append to a log, in files of a bounded size."""
    path = Scratch(spark, "log").path("log")
    for run in range(2):
        sinks.append_log(table(spark, sf_dir, "conversations").withColumn("run", F.lit(run).cast("long")), path, most_bytes=256 * 1024)
    back = spark.read.schema("conv_id long, turn long, role string, text string, run long").json(path)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("sum"), "run")


_REPORTS_SQL = """
WITH b AS (SELECT item_id AS id, text FROM benchmark), e AS (
  SELECT 'lessons' AS report, id, chr(10) || '## 2024-01-01: T' || id || chr(10) || chr(10) || '**Category:** general' || chr(10) || chr(10) || text || chr(10) AS entry FROM b
  UNION ALL SELECT 'rules', id, chr(10) || chr(10) || '## Rule (2024-01-01 00:00:00)' || chr(10) || chr(10) || text FROM b
  UNION ALL SELECT 'golden_set', id, chr(10) || chr(10) || '## PATTERN: T' || id || ' (2024-01-01 00:00:00)' || chr(10) || '```text' || chr(10) || text || chr(10) || '```' FROM b
  UNION ALL SELECT 'audit', id, '## T' || id || chr(10) || chr(10) || '```' || chr(10) || CASE WHEN strlen(h) > 400 THEN left(h, 400) || '...' ELSE h END || chr(10) || '```' || chr(10) || chr(10) || 'Status: [ ] Valid  [ ] Anti-Pattern' || chr(10) || chr(10) || '---' || chr(10) FROM (SELECT id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS h FROM b)
  UNION ALL SELECT 'skill_index', id, '| ' || replace(left(text, 80), '|', '/') || ' | s/' || id || '.md | T' || id || ' |  |' FROM b
  UNION ALL SELECT 'constitution', id, '## T' || id || chr(10) || chr(10) || text || chr(10) || '---' || chr(10) FROM b
)
SELECT report, md5('# ' || report || chr(10) || string_agg(entry || chr(10), '' ORDER BY id)) AS sum FROM e GROUP BY report
"""


@register("snk5_reports", _REPORTS_SQL)
def snk5(spark, sf_dir):
    """Reports for people, one text file each, read back whole."""
    scratch = Scratch(spark, "reports")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("title"))
    day, time = F.lit("2024-01-01"), F.lit("2024-01-01 00:00:00")
    title, text = F.col("title"), F.col("text")
    entries = {
        "lessons": sinks.lesson(day, title, F.lit(""), text), "rules": sinks.rule(time, text), "golden_set": sinks.golden_pattern(title, time, F.lit(None), text),
        "audit": sinks.audit_section(title, text), "skill_index": sinks.skill_row(text, F.concat(F.lit("s/"), F.col("id").cast("string"), F.lit(".md")), title, F.lit(None)),
        "constitution": sinks.constitution_part(title, text),
    }
    out = None
    for name, entry in entries.items():
        sinks.write_report(rows, scratch.path(name), "id", entry, f"# {name}")
        back = spark.read.text(scratch.path(name), wholetext=True).where("value <> ''").select(F.lit(name).alias("report"), F.md5("value").alias("sum"))
        out = back if out is None else out.unionByName(back)
    return out


@register("st1_incremental", "SELECT doc_id::VARCHAR AS source, md5(text) AS sum FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id::VARCHAR, md5('new') FROM labels WHERE quality = 1")
def st1(spark, sf_dir):
    """Two runs over a folder: all documents, then labelled ones anew or deleted."""
    scratch = Scratch(spark, "ingest")
    schema, args = "source string, text string, ts long", (scratch.path("table"), scratch.path("state"))
    key = F.col("doc_id").cast("string").alias("source")
    _lines(_json(table(spark, sf_dir, "documents").select(key, "text", F.lit(1).cast("long").alias("ts"))), scratch.path("in"))
    incremental.ingest_stream(spark, scratch.path("in"), schema, *args, config_hash="c1").awaitTermination()
    changed = table(spark, sf_dir, "labels").select(key, F.when(F.col("quality") == 1, "new").alias("text"), F.lit(2).cast("long").alias("ts"))
    _lines(_json(changed), scratch.path("in"), "append")
    incremental.ingest_stream(spark, scratch.path("in"), schema, *args, config_hash="c1").awaitTermination()
    return incremental.latest(spark, scratch.path("table"), config_hash="c1").select("source", F.md5("text").alias("sum"))


@register("st2_janitor", """
SELECT 'ingest' AS task, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'gone', doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'web', event_id FROM events WHERE floor(epoch(ts)) >= 1706745600 - 30 * 86400 + 86400 * 15
UNION ALL (SELECT 'training', conv_id * 1000 + turn FROM conversations ORDER BY conv_id * 1000 + turn DESC LIMIT 100000)
UNION ALL SELECT 'review', event_id FROM events WHERE floor(epoch(ts)) <= 1706745600 - 7 * 86400
""")
def st2(spark, sf_dir):
    """One round: documents against a manifest of the good ones, events as web rows and as
    lessons, conversations as training rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("source"))
    manifest = good.join(docs, "source", "left").select("source", T.content_hash("text").alias("content_hash"))
    at = F.unix_seconds("ts")
    events = C.events(spark, sf_dir)
    web = events.select(F.concat(F.lit("https://e/"), F.col("event_id").cast("string")).alias("source"), (at - 15 * 86_400).alias("last_updated"))
    training = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    lessons = events.select("event_id", at.alias("reviewed"))
    done = incremental.janitor_cycle(docs, manifest, web, training, lessons, F.lit(1_706_745_600).cast("long"))
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    keys = {"ingest": number, "gone": number, "web": number, "training": F.col("pos"), "review": F.col("event_id")}
    out = None
    for name, key in keys.items():
        rows = done[name].select(F.lit(name).alias("task"), key.alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _streamed(spark, scratch, stream, name: str, schema: str):
    """Runs all that a stream has into a table and reads it."""
    stream.writeStream.format("parquet").option("path", scratch.path(name)).option("checkpointLocation", scratch.path(f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(scratch.path(name))


@register("st4_loop_guard", """
WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS at_ FROM i)
SELECT user_id, epoch_us(ts) AS micros, event_type, at_ AS "at", at_ % 3 = 0 AS blocked FROM g
""")
def st4(spark, sf_dir):
    scratch = Scratch(spark, "guard")
    C.events(spark, sf_dir).select("user_id", "ts", "event_type").write.parquet(scratch.path("in"))
    calls = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(scratch.path("in"))
    found = _streamed(spark, scratch, incremental.guard_stream(calls, 3), "out", incremental.GUARD)
    return found.select("user_id", F.unix_micros("ts").alias("micros"), "event_type", "at", "blocked")


@register("st4_loop_state", """
WITH c AS (SELECT event_id, user_id, ts, event_id % 3 AS tool, event_id % 2 AS args, event_type IN ('error', 'view', 'click') AS failed, least(abs(value) / 200, 1.0)::DOUBLE AS score FROM events),
b AS (SELECT *, max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, greatest(max(score) OVER w, 0.0) AS best, row_number() OVER w AS iteration FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN score > coalesce(prior, 0.0) + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, tool ORDER BY ts, event_id) AS cleared FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - (island > 0)::INT AS stagnation, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, tool, cleared, args ORDER BY ts, event_id) AS failures FROM i),
s AS (SELECT *, CASE WHEN best >= 0.95 THEN 'converged' WHEN stagnation >= 3 THEN 'stagnated' WHEN iteration >= 20 THEN 'halted' ELSE 'running' END AS status FROM t)
SELECT event_id, iteration, best, stagnation::BIGINT AS stagnation, failures::BIGINT AS failures, failed AND failures >= 2 AS dead_end, status,
       min(CASE WHEN status <> 'running' THEN iteration END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS halted_at FROM s
""")
def st4_state(spark, sf_dir):
    """ST4 with WIN3 to WIN5: the whole state of a loop, over two runs of the stream."""
    scratch = Scratch(spark, "loops")
    at = F.unix_micros("ts")
    calls = C.events(spark, sf_dir).select(
        "user_id", "event_id", "ts", (F.col("event_id") % 3).cast("string").alias("tool"), (F.col("event_id") % 2).cast("string").alias("args"),
        F.col("event_type").isin("error", "view", "click").alias("failed"), F.least(F.abs("value") / 200, F.lit(1.0)).alias("score"),
    )
    # taken once: it is approximate, and both halves have to be cut at the same place
    half = F.lit(calls.agg(F.percentile_approx(at, 0.5)).first()[0])
    with loop_state.keyed_state(spark):
        for first in (True, False):
            calls.where(at <= half if first else at > half).write.mode("append").parquet(scratch.path("in"))
            stream = loop_state.loop_stream(spark.readStream.schema(loop_state.CALL).parquet(scratch.path("in")))
            found = _streamed(spark, scratch, stream, "out", loop_state.LOOP)
    return found.select("event_id", "iteration", "best", "stagnation", "failures", "dead_end", "status", "halted_at")


@register("st5_cache_stream", """
WITH n AS (SELECT max(ts) AS newest FROM events)
SELECT event_id AS id, user_id FROM events, n WHERE ts >= newest - INTERVAL 200 HOUR ORDER BY ts DESC, event_id DESC LIMIT 400
""")
def st5(spark, sf_dir):
    """ST5 as a stream: entries of three batches, the oldest leaving beyond a size and an age."""
    scratch = Scratch(spark, "cache")
    entries = C.events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
    for k in range(3):
        entries.where(F.pmod(F.col("id"), F.lit(3)) == k).write.mode("append").parquet(scratch.path("in"))
        stream = spark.readStream.schema("id long, user_id long, created_at timestamp").parquet(scratch.path("in"))
        loop_state.cache_stream(spark, stream, scratch.path("cache"), scratch.path("state"), 400, 200 * 3600).awaitTermination()
    return loop_state.cached(spark, scratch.path("cache")).select("id", "user_id")


@register("st6_inbox", "SELECT 't' || event_id AS id, event_type AS type, props AS payload, epoch_us(ts) AS micros, (event_id % 5)::INT AS priority FROM events")
def st6(spark, sf_dir):
    scratch = Scratch(spark, "inbox")
    tasks = C.events(spark, sf_dir).select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), (F.col("event_id") % 5).cast("int").alias("priority"))
    tasks.write.option("timestampFormat", "yyyy-MM-dd\'T\'HH:mm:ss.SSSSSSXXX").json(scratch.path("in"))
    found = _streamed(spark, scratch, incremental.inbox(spark, scratch.path("in")), "out", "id string, type string, payload string, created_at timestamp, priority int")
    return found.select("id", "type", "payload", F.unix_micros("created_at").alias("micros"), "priority")


@register("st7_log_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def st7(spark, sf_dir):
    """The first event of each user and type, over an earlier and a later part of the log."""
    scratch = Scratch(spark, "dedup")
    rows = C.events(spark, sf_dir).select("event_id", "user_id", "event_type")
    half = F.lit(rows.agg(F.percentile_approx("event_id", 0.5)).first()[0])
    for first in (True, False):
        rows.where(F.col("event_id") <= half if first else F.col("event_id") > half).write.mode("append").parquet(scratch.path("in"))
        stream = spark.readStream.schema("event_id long, user_id long, event_type string").parquet(scratch.path("in"))
        incremental.log_merge(spark, stream, scratch.path("out"), scratch.path("state"), ["user_id", "event_type"], "event_id").awaitTermination()
    return spark.read.parquet(scratch.path("out")).select("user_id", "event_type", "event_id")


@register("agg_windowed_counts", "SELECT date_trunc('hour', ts) AS start_, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def windowed(spark, sf_dir):
    """Counts by the hour of a stream; windows that the watermark hasn't passed stay open."""
    scratch = Scratch(spark, "windows")
    C.events(spark, sf_dir).select("ts", "event_type", "value").write.parquet(scratch.path("in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(scratch.path("in"))
    found = _streamed(spark, scratch, incremental.windowed_counts(stream), "out", "start timestamp, event_type string, n long, mean double")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start_"), "event_type", "n", F.round("mean", 6).alias("mean"))
