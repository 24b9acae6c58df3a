"""Queries over source code. Every document becomes one source file, in one of three
languages, with its words as comments; module trees come from documents and their source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import code as K
from quernstone.operators import graph as G
from quernstone.plans.registry import register
from quernstone.session import table
from quernstone.storage import Scratch

#: (extension, source, comment sign); @ is the document's number.
FILES = (
    ("py", "import os.path\nfrom lib.a import helper@\n\nclass C@:\n    def go@(self):\n        return helper@(os.getcwd())\n\ndef run@():\n    return C@().go@()\n", "# "),
    ("rs", "use crate::util::help@;\npub struct S@ { n: i32 }\nimpl S@ {\n    pub fn open@() -> S@ { help@(1) }\n}\npub fn start@() { S@::open@(); }\n", "// "),
    ("ts", "import { join@ } from 'path@';\nexport class V@ {\n  draw@(x: number) { return join@(x); }\n}\nexport const make@ = () => new V@();\nfunction f@() { return make@(); }\n", "// "),
)


def source_files(spark, sf_dir):
    """(doc_id, source, text)."""
    kind = (F.col("doc_id") % 3).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in FILES]), kind + 1)
    number = F.col("doc_id").cast("string")
    comment = F.concat(pick(2), F.regexp_replace("text", r"\s+", F.concat(F.lit("\n"), pick(2))), F.lit("\n"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("src/f"), number, F.lit("."), pick(0)).alias("source"),
        F.concat(F.replace(pick(1), F.lit("@"), number), comment).alias("text"),
    )


def _chunks(spark, sf_dir):
    files = source_files(spark, sf_dir).select("source", "text")
    symbols = files.select("source", K.code_symbols("text", K.extension(F.col("source"))).alias("s"))
    return K.chunk_files(files).join(symbols.select("source", "s.imports"), "source")


def _stored(spark, sf_dir):
    """The same, parsed once for all that a query looks up in it."""
    return Scratch(spark, "code").save(_chunks(spark, sf_dir), "chunks")


#: What the three kinds of file hold: (kind, chunk, type, name, defines, calls, text).
_EXPECTED = """
expected(kind, idx, type, name, defines, calls, text) AS (VALUES
  (0, 0, 'class', 'C@', ['C@'], ['getcwd', 'helper@'], 'class C@:|    def go@(self):|        return helper@(os.getcwd())'),
  (0, 1, 'function', 'go@', ['go@'], ['getcwd', 'helper@'], 'Class C@:|import os.path|from lib.a import helper@||def go@(self):|        return helper@(os.getcwd())'),
  (0, 2, 'function', 'run@', ['run@'], ['C@', 'go@'], 'import os.path|from lib.a import helper@||def run@():|    return C@().go@()'),
  (1, 0, 'type', 'S@', ['S@'], [], 'pub struct S@ { n: i32 }'),
  (1, 1, 'method', 'open@', ['S@::open@', 'open@'], ['help@'], 'impl S@ {|pub fn open@() -> S@ { help@(1) }|}'),
  (1, 2, 'function', 'start@', ['start@'], ['open@'], 'pub fn start@() { S@::open@(); }'),
  (2, 0, 'class', 'V@', ['V@'], ['join@'], 'export class V@ {|  draw@(x: number) { return join@(x); }|}'),
  (2, 1, 'method', 'draw@', ['draw@'], ['join@'], 'Class V@:||draw@(x: number) { return join@(x); }'),
  (2, 2, 'constant', 'make@', ['make@'], ['V@'], 'export const make@ = () => new V@();'),
  (2, 3, 'function', 'f@', ['f@'], ['make@'], 'function f@() { return make@(); }')
), code_chunks AS MATERIALIZED (
  SELECT doc_id, kind, source, source || '#' || idx AS chunk_id, idx, type, replace(name, '@', n) AS name, list_transform(defines, lambda x: replace(x, '@', n)) AS defines,
         list_transform(calls, lambda x: replace(x, '@', n)) AS calls, replace(replace(text, '@', n), '|', chr(10)) AS text
  FROM (SELECT doc_id, doc_id::VARCHAR AS n, doc_id % 3 AS k, 'src/f' || doc_id || '.' || (['py', 'rs', 'ts'])[(doc_id % 3 + 1)::INT] AS source FROM documents) JOIN expected ON kind = k
), asked AS MATERIALIZED (
  SELECT doc_id, source, (['C', 'open', 'make'])[(doc_id % 3 + 1)::INT] || doc_id AS symbol FROM documents
), related AS MATERIALIZED (
  SELECT symbol, 1 AS place, c.chunk_id FROM asked a JOIN code_chunks c ON c.doc_id = a.doc_id AND list_contains(c.defines, a.symbol)
  UNION ALL SELECT symbol, 2, c.chunk_id FROM asked a JOIN code_chunks c ON c.doc_id = a.doc_id AND list_contains(c.calls, a.symbol)
)"""


@register("chk7_chunk_files", f"WITH {_EXPECTED} SELECT chunk_id, source, type, name, defines, calls, md5(text) AS text FROM code_chunks")
def chk7(spark, sf_dir):
    """CHK4 to CHK9."""
    return _chunks(spark, sf_dir).select("chunk_id", "source", "type", "name", "defines", "calls", F.md5("text").alias("text"))


_SYMBOLS = """
symbols AS (
  SELECT 'src/f' || doc_id || '.' || (['py', 'rs', 'ts'])[(doc_id % 3 + 1)::INT] AS source,
         list_transform(([['C@', 'go@', 'run@'], ['S@', 'S@::open@', 'start@'], ['V@', 'f@', 'make@']])[(doc_id % 3 + 1)::INT], lambda x: replace(x, '@', doc_id::VARCHAR)) AS defines,
         list_transform(([['lib', 'os'], ['crate::util::help@', 'help@'], ['join@', 'path@']])[(doc_id % 3 + 1)::INT], lambda x: replace(x, '@', doc_id::VARCHAR)) AS imports
  FROM documents
)"""


def _symbols(spark, sf_dir):
    files = source_files(spark, sf_dir)
    return files.select("source", K.code_symbols("text", K.extension(F.col("source"))).alias("s")).select("source", "s.defines", "s.imports")


@register("sym5_symbols", f"WITH {_SYMBOLS} SELECT * FROM symbols")
def sym5(spark, sf_dir):
    """SYM1 to SYM3, SYM5."""
    return _symbols(spark, sf_dir)


@register("sym4_calls", """
SELECT 'src/f' || doc_id || '.' || (['py', 'rs', 'ts'])[(doc_id % 3 + 1)::INT] AS source,
       list_transform(([['C@', 'getcwd', 'go@', 'helper@'], ['help@', 'open@'], ['V@', 'join@', 'make@']])[(doc_id % 3 + 1)::INT], lambda x: replace(x, '@', doc_id::VARCHAR)) AS calls FROM documents
""")
def sym4_calls(spark, sf_dir):
    """Calls of whole files."""
    files = source_files(spark, sf_dir)
    return files.select("source", K.code_calls("text", K.extension(F.col("source"))).alias("calls"))


@register("sym6_outline", f"""
WITH {_SYMBOLS}, f AS (SELECT * FROM symbols ORDER BY source LIMIT 500), l AS (SELECT source, unnest(defines) AS symbol FROM f)
SELECT row_number() OVER (ORDER BY source, symbol) AS place, source || ': ' || symbol AS line FROM (SELECT * FROM l ORDER BY source, symbol LIMIT 2000)
""")
def sym6(spark, sf_dir):
    files = source_files(spark, sf_dir).select("source", "text")
    return K.outline(files, defines=K.code_symbols_here("text", K.extension(F.col("source")))["defines"])


def _names(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    head = F.element_at(F.array(*map(F.lit, ("C", "open", "make"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(head, number).alias("symbol"))


def _related(chunks, names):
    return K.related_code(K.symbol_index(chunks), K.reference_index(chunks), names)


@register("jn4_symbol_lookup", f"""
WITH {_EXPECTED}, d AS (SELECT unnest(defines) AS symbol, chunk_id FROM code_chunks)
SELECT symbol, chunk_id FROM (SELECT DISTINCT symbol FROM asked) JOIN d USING (symbol)
""")
def jn4(spark, sf_dir):
    """Where the index has a name defined."""
    return K.symbol_index(_chunks(spark, sf_dir)).join(_names(spark, sf_dir).distinct(), "symbol").select("symbol", "chunk_id")


@register("jn5_related_code", f"WITH {_EXPECTED} SELECT symbol, place, chunk_id, place = 1 AS is_definition FROM related")
def jn5(spark, sf_dir):
    """JN5, TOP5, GR4."""
    return _related(_stored(spark, sf_dir), _names(spark, sf_dir))


@register("jn6_callees", f"""
WITH {_EXPECTED}, c AS (SELECT chunk_id, unnest(calls) AS callee, generate_subscripts(calls, 1) AS k FROM code_chunks),
d AS (SELECT unnest(defines) AS callee, chunk_id AS callee_chunk FROM code_chunks)
SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k) AS place, callee, callee_chunk FROM c JOIN d USING (callee)
""")
def jn6(spark, sf_dir):
    """JN6, GR3, SET7."""
    # names alone: no text is moved, and no file is parsed for imports
    named = K.chunk_files(source_files(spark, sf_dir).select("source", "text")).select("chunk_id", "defines", "calls")
    chunks = Scratch(spark, "code").save(named, "chunks")
    return K.callees(chunks, K.symbol_index(chunks))


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_ATTRIBUTE = "replace(replace(replace(replace({0}, '&', '&amp;'), chr(34), '&quot;'), '<', '&lt;'), '>', '&gt;')"


@register("str30_related_text", f"""
WITH {_EXPECTED}, r AS (SELECT symbol, place, c.* FROM related JOIN code_chunks c USING (chunk_id)),
m AS (
  SELECT symbol, string_agg('<source_file path="' || source || '">' || chr(10) || {_XML.format('text')} || CASE WHEN len(calls) > 0 THEN chr(10) || 'Outgoing calls: ' || array_to_string(calls, ', ') ELSE '' END || chr(10) || '</source_file>', chr(10) || chr(10) ORDER BY place) AS main
  FROM r GROUP BY symbol
), k AS (SELECT symbol, callee, min(place * 1000 + k) AS first_ FROM (SELECT symbol, place, unnest(calls) AS callee, generate_subscripts(calls, 1) AS k FROM r) GROUP BY symbol, callee),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY first_) AS nth FROM k),
d AS (SELECT unnest(defines) AS callee, chunk_id FROM code_chunks),
x AS (
  SELECT n.symbol, string_agg('<source_file path="' || source || '" symbol="' || callee || '">' || chr(10) || {_XML.format('text')} || chr(10) || '</source_file>', chr(10) || chr(10) ORDER BY nth) AS context
  FROM n JOIN d USING (callee) JOIN code_chunks USING (chunk_id) WHERE nth <= 3 GROUP BY n.symbol
)
SELECT symbol, main || coalesce(chr(10) || chr(10) || '<callee_context>' || chr(10) || context || chr(10) || '</callee_context>', '') AS text FROM m LEFT JOIN x USING (symbol)
UNION ALL SELECT 'absent', 'No defining or importing chunks found.'
""")
def str30(spark, sf_dir):
    chunks = _stored(spark, sf_dir)
    names = _names(spark, sf_dir)
    asked = names.unionByName(spark.range(1).select(F.lit("absent").alias("symbol")))
    return K.related_text(_related(chunks, names), chunks, K.symbol_index(chunks), asked)


@register("str31_symbol_xml", f"""
WITH {_EXPECTED}, r AS (SELECT symbol, place, c.*, list_contains(defines, symbol) AS own FROM related JOIN code_chunks c USING (chunk_id)),
d AS (SELECT symbol, string_agg('<source path="' || source || '" rel="implementation">' || {_XML.format("regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g')")} || '</source>', '' ORDER BY place) AS definition FROM r WHERE own GROUP BY symbol),
s AS (SELECT symbol, place, source, left(split_part(text, chr(10), 1), 80) AS context, unnest(defines) AS other, generate_subscripts(defines, 1) AS k FROM r WHERE NOT own),
x AS (SELECT symbol, string_agg('<ref rel="consumer" path="graph://symbol/' || {_ATTRIBUTE.format('other')} || '" context="' || {_ATTRIBUTE.format('context')} || '">' || {_XML.format('other')} || ' (in ' || split_part(source, '/', 2) || ')</ref>', '' ORDER BY place, k) AS refs FROM s GROUP BY symbol)
SELECT symbol, '<symbol name="' || symbol || '"><definition>' || definition || '</definition><references>' || coalesce(refs, '') || '</references></symbol>' AS xml FROM d LEFT JOIN x USING (symbol)
UNION ALL SELECT 'absent', '<symbol name="absent"><definition>Not found in index.</definition><references/></symbol>'
""")
def str31(spark, sf_dir):
    chunks = _stored(spark, sf_dir)
    names = _names(spark, sf_dir)
    return K.symbol_xml(_related(chunks, names), chunks, names.unionByName(spark.range(1).select(F.lit("absent").alias("symbol"))))


def module_files(spark, sf_dir):
    """A module tree (source, text): a root that names each source as a module, a module a
    source that names its English documents, and each document, which uses the one before
    it in its source."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    use = F.coalesce(F.concat(F.lit("use crate::"), "source", F.lit("::d"), before.cast("string"), F.lit(";\n")), F.lit(""))
    leaves = docs.select(F.concat(F.lit("src/"), "source", F.lit("/"), name, F.lit(".rs")).alias("source"), F.concat(use, F.lit("fn f() {}\n")).alias("text"))
    line = F.when(F.col("lang") == "en", F.concat(F.lit("mod "), name, F.lit(";"))).otherwise(F.concat(F.lit("// mod "), name, F.lit(";")))
    middle = docs.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).select(F.concat(F.lit("src/"), "source", F.lit("/mod.rs")).alias("source"), "text")
    root = docs.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("pub mod "), "source", F.lit(";")))), "\n").alias("text")).select(F.lit("src/lib.rs").alias("source"), "text")
    return leaves.unionByName(middle).unionByName(root)


_EDGES = """
edges AS MATERIALIZED (
  SELECT 'lib' AS parent, source AS child, 'mod' AS kind FROM documents GROUP BY source
  UNION ALL SELECT source, source || '::d' || doc_id, 'mod' FROM documents WHERE lang = 'en'
  UNION ALL SELECT source || '::d' || doc_id, source || '::d' || before_, 'use' FROM (SELECT doc_id, source, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before_ FROM documents) WHERE before_ IS NOT NULL
)"""


@register("gr1_module_graph", f"WITH {_EDGES} SELECT * FROM edges")
def gr1(spark, sf_dir):
    return G.module_edges(module_files(spark, sf_dir))


@register("gr2_unreachable", "SELECT source || '::d' || doc_id AS node FROM documents WHERE lang <> 'en'")
def gr2(spark, sf_dir):
    """Modules that no chain of ``mod`` declarations leads to."""
    files = module_files(spark, sf_dir)
    nodes = files.select(G.module_of(F.col("source")).alias("node"))
    roots = nodes.where(F.col("node").isin("lib", "main") | F.col("node").startswith("bin::"))
    return G.unreachable(nodes, G.module_edges(files).where("kind = 'mod'"), roots)


@register("snk6_mermaid", f"""
WITH {_EDGES} SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS graph
FROM (SELECT DISTINCT '  ' || regexp_replace(parent, '[^A-Za-z0-9_]', '_', 'g') || CASE kind WHEN 'mod' THEN ' --> ' ELSE ' -.-> ' END || regexp_replace(child, '[^A-Za-z0-9_]', '_', 'g') AS line FROM edges)
""")
def snk6(spark, sf_dir):
    return G.mermaid(G.module_edges(module_files(spark, sf_dir)))


#: Files whose items come from a document: one for each of its first distinct words of four
#: letters or more, at most 1 + doc_id % 5 of them, in a form that goes by the word's place.
#: (extension, head, for each form: text, chunk text, type, name, defines, calls); @ is the
#: word and its place, ~ a line break. The third form of each language is broken.
_FORMS = (
    ("py", "import os~~", (
        ("def @(x):~    return '} {' + call_@(x)~", "import os~~def @(x):~    return '} {' + call_@(x)", "function", "@", ("@",), ("call_@",)),
        ("async def @():~    # no()~    await os.wait_@()~", "import os~~async def @():~    # no()~    await os.wait_@()", "function", "@", ("@",), ("wait_@",)),
        ("def @(x):~    return (lost_@(x) +~", "import os~~def @(x):~    return (lost_@(x) +", "function", "@", ("@",), ("lost_@",)),
    )),
    ("rs", "use std::io;~", (
        ("fn @(x: i32) { let s = r#\"}{\"#; call_@(x) }~", "fn @(x: i32) { let s = r#\"}{\"#; call_@(x) }", "function", "@", ("@",), ("call_@",)),
        ("pub struct @<'a, T: Into<Vec<u8>>> { /* } /* { */ */ x: &'a T }~", "pub struct @<'a, T: Into<Vec<u8>>> { /* } /* { */ */ x: &'a T }", "type", "@", ("@",), ()),
        ("fn @() {~    if x { lost_@(1);~", "fn @() {~    if x { lost_@(1);", "function", "@", ("@",), ("lost_@",)),
    )),
    ("tsx", "import { a } from 'b';~", (
        ("function @<T extends { a: string }>({ x }: P<T>) { return `}${call_@(`{`)}`; }~", "function @<T extends { a: string }>({ x }: P<T>) { return `}${call_@(`{`)}`; }", "function", "@", ("@",), ("call_@",)),
        ("export const @ = () => <p>it's {show_@(1)} }</p>;~", "export const @ = () => <p>it's {show_@(1)} }</p>;", "constant", "@", ("@",), ("show_@",)),
        ("function @() {~  if (/[{]/.test(x)) { lost_@();~", "function @() {~  if (/[{]/.test(x)) { lost_@();", "function", "@", ("@",), ("lost_@", "test")),
    )),
)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return f"[{', '.join(map(_sql_text, values))}]::VARCHAR[]"


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"
_WORDS_FILES = f"""
forms(k, form, text, type, calls) AS (VALUES
  {", ".join(f"({k}, {j}, {_sql_text(f[1])}, '{f[2]}', {_sql_list(f[5])})" for k, (_, _, forms) in enumerate(_FORMS) for j, f in enumerate(forms))}
), words AS (
  SELECT doc_id, doc_id % 3 AS k, 'gen/f' || doc_id || '.' || (['py', 'rs', 'tsx'])[(doc_id % 3 + 1)::INT] AS source, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place
  FROM (SELECT doc_id, (list_sort({_WORDS}))[1:1 + doc_id % 5] AS ws FROM documents)
), items AS MATERIALIZED (
  SELECT doc_id, source, place, word || '_' || place AS name, type, list_transform(calls, lambda x: replace(x, '@', word || '_' || place)) AS calls, replace(replace(text, '@', word || '_' || place), '~', chr(10)) AS text
  FROM words w JOIN forms f ON f.k = w.k AND f.form = (w.place + w.doc_id) % 3
)"""


def generated_files(spark, sf_dir):
    """(source, text): a file of each document's words; those without one have no file."""
    kind = (F.col("doc_id") % 3).cast("int")
    docs = table(spark, sf_dir, "documents")
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))), 1, (1 + F.col("doc_id") % 5).cast("int"))
    forms = F.array(*[F.array(*[F.lit(f[0]) for f in forms]) for _, _, forms in _FORMS])
    form = lambda place: F.element_at(F.element_at(forms, kind + 1), ((place + F.col("doc_id")) % 3 + 1).cast("int"))
    items = F.transform(words, lambda w, place: F.replace(form(place), F.lit("@"), F.concat(w, F.lit("_"), place.cast("string"))))
    head, ext = (F.element_at(F.array(*[F.lit(f[n]) for f in _FORMS]), kind + 1) for n in (1, 0))
    text = F.replace(F.concat(head, F.array_join(items, "~")), F.lit("~"), F.lit("\n"))
    return docs.where(F.size(words) > 0).select(F.concat(F.lit("gen/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("source"), text.alias("text"))


@register("chk9_broken_files", f"WITH {_WORDS_FILES} SELECT source || '#' || place AS chunk_id, source, type, name, [name] AS defines, list_sort(calls) AS calls, md5(text) AS text FROM items")
def chk9(spark, sf_dir):
    """CHK4 to CHK6 and CHK9 on files of the documents' own words, with raw strings, nested
    comments, templates, JSX, and items that are never closed among whole ones."""
    return K.chunk_files(generated_files(spark, sf_dir)).select("chunk_id", "source", "type", "name", "defines", "calls", F.md5("text").alias("text"))


@register("sym2_generated_symbols", f"WITH {_WORDS_FILES} SELECT source, list(name ORDER BY name) AS defines FROM items GROUP BY source")
def sym2(spark, sf_dir):
    """SYM1 to SYM3 on the same files."""
    files = generated_files(spark, sf_dir)
    return files.select("source", K.code_symbols("text", K.extension(F.col("source"))).alias("s")).select("source", "s.defines")


@register("sym4_generated_calls", f"WITH {_WORDS_FILES} SELECT source, list(DISTINCT c ORDER BY c) AS calls FROM (SELECT source, unnest(calls) AS c FROM items) GROUP BY source")
def sym4_generated(spark, sf_dir):
    """SYM4 on the same files; those without a call are left out."""
    files = generated_files(spark, sf_dir)
    return files.select("source", K.code_calls("text", K.extension(F.col("source"))).alias("calls")).where(F.size("calls") > 0)
