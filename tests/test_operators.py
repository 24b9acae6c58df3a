"""Operators on small rows, against plain Python."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quernstone.functions import arguments, budget, front_matter
from quernstone.functions import text as T
from quernstone.operators import analytics, chunking, code, curation, graph, retrieval
from quernstone.sources.html import html_to_markdown


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("length", [0, 1, 1023, 1024, 1025, 1920, 2000, 2816, 5000])
def test_char_windows(spark, length):
    text = "".join(random.Random(length).choice("abcé") for _ in range(length))
    expected, at = [], 0
    while text:
        expected.append(text[at : at + 1024])
        if at + 1024 > length:
            break
        at += 896
    assert one(spark, chunking.char_windows(F.col("t")), t=text) == [e for e in expected if e.strip()]


def test_blank_text_is_one_chunk(spark):
    assert one(spark, chunking.char_windows(F.col("t")), t="  \n ") == ["  \n "]


def test_small_windows_without_overlap(spark):
    assert one(spark, chunking.char_windows(F.col("t"), 2, 0), t="abcdef")[:3] == ["ab", "cd", "ef"]


def test_word_windows(spark):
    words = " ".join(f"w{k}" for k in range(20))
    found = one(spark, chunking.word_windows(F.col("t"), 10, 3), t=words)
    assert found[0] == " ".join(f"w{k}" for k in range(10)) and found[1].startswith("w7 ") and found[-1].endswith("w19")


def test_markdown_sections(spark):
    text = "lost\n# One\na\n\n## Two\nb\nUnder\n===\nc"
    rows = chunking.markdown_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert [(r["name"], r["text"]) for r in rows.orderBy("section").collect()] == [("One", "# One\na"), ("Two", "## Two\nb"), ("Under", "Under\n===\nc")]
    with_lead = chunking.markdown_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", leading=True)
    assert with_lead.where("section = 0").first()["text"] == "lost"


@pytest.mark.parametrize("text, most", [("é" * 100, 117), ("a" * 121, 117), ("aé" * 80, 117), ("", 117), ("€" * 50, 117)])
def test_cut_bytes(spark, text, most):
    expected = text.encode()[:most].decode(errors="ignore")
    assert one(spark, T.cut_bytes(F.col("t"), most), t=text) == expected


def test_truncated_includes_suffix(spark):
    found = one(spark, T.truncated(F.col("t"), 100), t="x" * 200)
    assert len(found) == 100 and found.endswith(T.fixed.TRUNCATION_SUFFIX)
    assert one(spark, T.truncated(F.col("t"), 0), t="x" * 200) == "x" * 200


def test_redaction(spark):
    text = r"D:\Users\ann\x /home/bob/y sk-abcdefghijklmnopqrstuv ghp_0123456789ab my_secret_key.txt"
    assert "[REDACTED]" in (found := one(spark, T.redacted("t"), t=text)) and "ann" not in found and "bob" not in found


def test_masked_before_cut(spark):
    line = "x" * 70 + ' key = "0123456789012345678901234567890"'
    assert "0123" not in one(spark, T.masked("t"), t=line)


def greedy(items, k, weight=0.5):
    """The choice as a loop that swaps the last candidate into the gap."""
    left = items[: 3 * k]
    n = len(left)
    left = [(c, s, i, 1 - 0.5 * p / n) for p, (c, s, i) in enumerate(left)]
    picked = []
    while left and len(picked) < k:
        values = [(1 - weight) * rel - weight * (0.95 if any(s == q[1] and abs(i - q[2]) <= 2 for q in picked) else 0.0) for _, s, i, rel in left]
        at = values.index(max(values))
        picked.append(left[at])
        left[at] = left[-1]
        left.pop()
    return [p[0] for p in picked]


@pytest.mark.parametrize("seed", range(6))
def test_diversified(spark, seed):
    rng = random.Random(seed)
    items = [(f"s{rng.randrange(3)}#{k}", None, k) for k in rng.sample(range(30), rng.randrange(1, 25))]
    items = [(c, c.split("#")[0], k) for c, _, k in items]
    rows = spark.createDataFrame([(1, r + 1, c) for r, (c, _, _) in enumerate(items)], "query_id int, rank long, chunk_id string")
    found = [r["chunk_id"] for r in retrieval.diversified(rows, 5).orderBy("rank").collect()]
    assert found == greedy(items, 5)


def test_rank_fusion_order(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, 1 / (r + 21)) for r, i in enumerate(ids)], "query_id int, id string, score double")
    found = retrieval.fused([leg(["a#0", "a#1", "b#0"]), leg(["b#0", "a#0", "c#0"])], 4)
    assert [r["id"] for r in found.orderBy("rank").collect()] == ["a#0", "b#0", "a#1", "c#0"]


def test_rerank_without_scores_keeps_order(spark):
    rows = spark.createDataFrame([(1, 1, "a", "official", None), (1, 2, "b", "blog", 0.9)], "query_id int, rank long, chunk_id string, source_type string, s double")
    assert [r["chunk_id"] for r in retrieval.reranked(rows, F.col("s"), 2).orderBy("rank").collect()] == ["a", "b"]


def test_loop_guard(spark):
    calls = [(1, k, t) for k, t in enumerate("aaaaaabaaaaa")]
    rows = analytics.loop_guard(spark.createDataFrame(calls, "u int, n int, t string"), ["u"], ["n"], ["t"], 5)
    assert [r["n"] for r in rows.where("blocked").orderBy("n").collect()] == [4, 11]


def test_convergence(spark):
    scores = [0.1, 0.3, 0.3, 0.2, 0.3, 0.96]
    rows = analytics.convergence(spark.createDataFrame([(1, k, s) for k, s in enumerate(scores)], "u int, n int, s double"), ["u"], ["n"], "s")
    assert [r["status"] for r in rows.orderBy("n").collect()] == ["running", "running", "running", "running", "stagnated", "converged"]


def test_dead_ends_cleared_by_success(spark):
    calls = [(0, "t", "a", True), (1, "t", "a", True), (2, "t", "b", False), (3, "t", "a", True)]
    rows = analytics.dead_ends(spark.createDataFrame([(1, *c) for c in calls], "u int, n int, tool string, args string, failed boolean"), ["u"], ["n"], "tool", "args", "failed")
    assert [r["dead_end"] for r in rows.orderBy("n").collect()] == [False, True, False, False]


def test_keep_one_and_upsert(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    assert sorted(r["n"] for r in curation.keep_one(rows, ["k"], ["n"]).collect()) == [1, 3]
    assert sorted(r["n"] for r in curation.keep_one(rows, ["k"], ["n"], last=True).collect()) == [2, 3]
    new = spark.createDataFrame([(9, "a")], "n int, k string")
    assert sorted(r["n"] for r in curation.upserted(rows, new, ["k"]).collect()) == [3, 9]


def test_python_chunks():
    source = "import os\n\nclass A:\n    @x\n    def go(self):\n        return os.path.join(f(1), g())\n\ndef run():\n    pass\n"
    found = code.python_chunks(source)
    assert [(c["type"], c["name"]) for c in found] == [("class", "A"), ("function", "go"), ("function", "run")]
    assert found[1]["text"].startswith("Class A:\nimport os") and found[1]["calls"] == ["f", "g", "join"]
    assert code.python_chunks("def broken(:")[0]["type"] == "raw" and code.python_chunks("x = 1")[0]["type"] == "script"
    assert code.python_symbols(source) == {"defines": ["A", "go", "run"], "imports": ["os"]}


def test_rust_chunks():
    source = 'use a::b::{C, D};\nstruct S { n: i32 }\nimpl<T> Tr for S {\n  fn go(&self) -> i32 { let x = "}"; self.f(g(1)) }\n}\npub fn run() { S::new(); }\nmod m { pub fn inner() {} }\n'
    found = code.rust_chunks(source)
    assert [(c["type"], c["defines"]) for c in found] == [("type", ["S"]), ("method", ["S::go", "go"]), ("function", ["run"])]
    assert found[1]["calls"] == ["f", "g"] and found[1]["text"].startswith("impl S {\n")
    symbols = code.rust_symbols(source)
    assert {"S", "S::go", "run", "m::inner"} <= set(symbols["defines"]) and {"a::b::C", "C", "a::b::D", "D"} <= set(symbols["imports"])


def test_ts_chunks():
    source = "import { join, split as s } from './path/x';\nexport class V extends B {\n  draw(x: number) { return join(x); }\n}\nfunction f() { g(); }\nexport const k = 1;\ninterface I { a: string }\n"
    found = code.ts_chunks(source)
    assert [(c["type"], c["name"]) for c in found] == [("class", "V"), ("method", "draw"), ("function", "f"), ("constant", "k"), ("interface", "I")]
    assert code.ts_symbols(source)["imports"] == ["join", "path", "split"]


def test_reachability(spark):
    deep = [(f"n{k}", f"n{k + 1}") for k in range(60)]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e"), ("c", "n0"), *deep], "parent string, child string")
    nodes = spark.createDataFrame([(n,) for n in [*"abcdef", *(f"n{k}" for k in range(61))]], "node string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted(r["node"] for r in graph.unreachable(nodes, edges, roots).collect()) == ["d", "e", "f"]


def test_html_to_markdown():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>A <b>bold</b> <a href='/x'>link</a></p><ul><li>one</li><li>two</li></ul><script>no()</script></article></body></html>"
    assert html_to_markdown(page) == "# Head\n\nA **bold** [link](/x)\n\n- one\n- two"
    assert html_to_markdown(None) == ""


CHUNKS = [("a#0", "a", "The fire-wall café stands, fire and wall apart"), ("b#0", "b", "fire wall"), ("b#1", "b", "wall fire of the CAFE\u0301"), ("c#0", "c", "nothing of it")]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, s, int(i[-1]), t) for i, s, t in CHUNKS]
    return spark.createDataFrame(rows, "chunk_id string, source string, chunk_idx int, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_words_are_phrases_without_accents(spark, chunks):
    found = retrieval.bm25(chunks, asked(spark, "fire-wall", "Cafe", "wall fire", "- -", "absent-word"))
    hits = {}
    for r in found.collect():
        hits.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert hits == {0: {"a#0", "b#0"}, 1: {"a#0", "b#1"}, 2: {"a#0", "b#0", "b#1"}}


def test_searches_by_source_and_fallback(spark, chunks):
    queries = asked(spark, "fire", "xyzzy")
    vectors = spark.createDataFrame([("a#0", [1.0, 0.0]), ("b#0", [0.0, 1.0]), ("c#0", [0.6, 0.8])], "id string, embedding array<double>")
    summaries = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<double>")
    vector = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    scored = retrieval.bm25(chunks, queries)
    named = chunks.withColumn("defines", F.when(F.col("chunk_id") == "a#0", F.array(F.lit("S"))).when(F.col("chunk_id") == "c#0", F.array(F.lit("S"))).otherwise(F.array().cast("array<string>")))
    symbols = named.select(F.explode("defines").alias("symbol"), "chunk_id")
    found = retrieval.hierarchical(scored, vectors, summaries, queries, vector, named, symbols, 3, 10)
    # the only summary keeps the search in file a, whose symbol leads to c
    assert [(r["query_id"], r["chunk_id"]) for r in found.orderBy("query_id", "rank").collect()] == [(0, "a#0"), (0, "c#0")]
    without = vector.where("query_id = 9")
    walked = retrieval.hierarchical(scored, vectors, summaries, queries, without, named, symbols, 3, 10)
    assert {r["chunk_id"] for r in walked.collect()} == {"a#0", "b#0", "b#1", "c#0"}
    numbered = chunks.withColumn("source", F.ascii("source").cast("long")).withColumn("chunk_id", F.concat(F.col("source").cast("string"), F.lit("#"), F.col("chunk_idx").cast("string")))
    master = spark.createDataFrame([(98,)], "source long")
    rows = retrieval.master_search(retrieval.bm25(numbered, queries), vectors, queries, vector, numbered, master, 2).collect()
    assert {r["chunk_id"] for r in rows if r["query_id"] == 0} == {"98#0", "98#1"}
    assert sorted((r["rank"], r["chunk_id"]) for r in rows if r["query_id"] == 1) == [(1, "98#0"), (2, "98#1")]


@pytest.mark.parametrize("nearest, length, fine", [(0.5, 50, True), (1.0, 500, False), (0.1, 8001, False), (None, 99, False), (None, 100, True), (None, 4000, True), (None, 4001, False)])
def test_auto_approval(spark, nearest, length, fine):
    assert one(spark, retrieval.auto_approved(F.col("d").cast("double"), F.col("n")), d=nearest, n=length) is fine


@pytest.mark.parametrize("command, allowed, safe", [
    ("git commit -m 'a --force b'", True, True), ("git commit --Amend", True, False), ("GIT.exe push", True, False), ("npm uninstall x", True, False), ("", False, True), ("'ls' -f", True, True), ("curl x", False, True),
])
def test_commands(spark, command, allowed, safe):
    words = arguments.argv("c")
    assert one(spark, F.struct(arguments.program_allowed(words).alias("a"), arguments.arguments_safe(words).alias("s")), c=command) == (allowed, safe)


@pytest.mark.parametrize("path, expected", [("x/../y", "/r/y"), ("/a//b/./c", "/a/b/c"), ("../..", "/"), (" ", "/r"), ("/", "/")])
def test_resolved_paths(spark, path, expected):
    assert one(spark, arguments.resolved(F.col("p"), "/r"), p=path) == expected


def test_token_budget():
    text = " ".join(f"w{k}" for k in range(40))
    assert budget.within_tokens(text, 44) == text
    cut = budget.within_tokens(text, 14)
    assert budget.count_words(cut.removesuffix(T.fixed.TRUNCATION_SUFFIX)) == 10 and cut.endswith(T.fixed.TRUNCATION_SUFFIX)
    assert budget.within_tokens("a b", 1) == T.fixed.TRUNCATION_SUFFIX and budget.within_tokens("", 5) == ""


@pytest.mark.parametrize("head, expected", [
    ("name: plain\n", None), ("name: a: b\n", 'name: "a: b"'), ("tags: [a: b: c, \"q\", d]\n", 'tags: ["a: b: c", "q", d]'), ("name: @x\n", 'name: "@x"'), ("name: {broken\n", None),
])
def test_front_matter_repair(head, expected):
    content = f"---\n{head}---\nbody"
    assert front_matter.repaired(content) == (content if expected is None else f"---\n{expected}\n---\nbody")
    assert front_matter.repaired("no head") == "no head" and front_matter.repaired("---\nopen: a: b") == "---\nopen: a: b"


@pytest.mark.parametrize("head, expected", [
    ("a: 'it''s'\nb: \"q \\\" q\" # note\nc: &x y\nd: *x\ne: http://h:80/p\nf: x #y\n", None),  # all of it reads
    ("a: |\n  b: c: d\n  @e\nf: ok\n", None),  # a block scalar holds anything
    ("a: |\n  b: c: d\n\nf: @ok\n", 'a: |\n  b: c: d\n\nf: "@ok"'),
    ("- a: b\n- @c\n- x: y: z\n", '- a: b\n- "@c"\n- x: "y: z"'),
    ("a: [x, [y, z], {k: v}, 'q, r', s: t]\n", 'a: [x, [y, z], {k: v}, \'q, r\', "s: t"]'),
    ("a: # gone\nb: %x\nc: #hash\n", 'a: # gone\nb: "%x"\nc: "#hash"'),
    ("a: #hash\n", None),  # reads, though as nothing
    ('a: "open: x\nb: say "hi": c\n', 'a: "\\"open: x"\nb: "say \\"hi\\": c"'),
    ("a: - x\nb: -1\nc: ends:\n", 'a: "- x"\nb: -1\nc: "ends:"'),
    ("a: @x\nb: [open, c\n", None), ("a: *not alias\n", 'a: "*not alias"'), ("a: C:\\x: y\n", 'a: "C:\\\\x: y"'),
])
def test_front_matter_by_yaml_rules(head, expected):
    content = f"---\n{head}---\nbody: @y: z"
    assert front_matter.repaired(content) == (content if expected is None else f"---\n{expected}\n---\nbody: @y: z")


def test_tokenizer_budget():
    """One character more has too many tokens; what fits stays."""
    tokens = budget.tokens_of(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word", " ", "ü", "\n", "🙂", "  ", "supercalifragilistic", ".", "1234"]) for _ in range(n)) for n in (0, 5, 60, 200, 900)] + ["a" * 5000, " " * 4000, "é" * 3000]
    for text in texts:
        for most in (3, 20, 33, 64):
            cut = tokens.within(text, most)
            if tokens.count(text) <= most:
                assert cut == text
                continue
            assert cut.endswith(T.fixed.TRUNCATION_SUFFIX)
            at = len(cut) - len(T.fixed.TRUNCATION_SUFFIX)
            assert text.startswith(cut[:at])
            if at:
                assert tokens.count(cut) <= most < tokens.count(text[: at + 1] + T.fixed.TRUNCATION_SUFFIX)


def test_symbol_xml_and_related_text(spark):
    rows = [("f#0", "d/f.py", "def a(): b()", ["a"], ["b"], ["m"]), ("g#0", "d/g.py", "a() & <x>", ["g", "h"], ["a"], ["a"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, text string, defines array<string>, calls array<string>, imports array<string>")
    names = spark.createDataFrame([("a",), ("zz",), (" ",)], "symbol string")
    related = code.related_code(code.symbol_index(chunks), code.reference_index(chunks), names)
    xml = {r["symbol"]: r["xml"] for r in code.symbol_xml(related, chunks, names).collect()}
    assert xml["a"] == (
        '<symbol name="a"><definition><source path="d/f.py" rel="implementation">def a(): b()</source></definition><references>'
        '<ref rel="dependency" path="graph://symbol/g" context="a() &amp; &lt;x&gt;">g (in g.py)</ref><ref rel="dependency" path="graph://symbol/h" context="a() &amp; &lt;x&gt;">h (in g.py)</ref></references></symbol>'
    )
    assert "Not found in index." in xml["zz"] and "Invalid symbol name." in xml[" "]
    text = {r["symbol"]: r["text"] for r in code.related_text(related, chunks, code.symbol_index(chunks), names).collect()}
    assert text["a"].startswith('<source_file path="d/f.py">\ndef a(): b()\nOutgoing calls: b\n</source_file>\n\n<source_file path="d/g.py">')
    assert text["a"].endswith('<callee_context>\n<source_file path="d/f.py" symbol="a">\ndef a(): b()\n</source_file>\n</callee_context>')
    assert text["zz"] == "No defining or importing chunks found."


def test_outline_stops(spark):
    rows = [(f"a/{k}.py", ["y", "x"]) for k in range(4)] + [("/".join("abcdefghi") + ".py", ["deep"])]
    files = spark.createDataFrame(rows, "source string, defines array<string>")
    assert [r["line"] for r in code.outline(files, 3, 5, 8).orderBy("place").collect()] == ["a/0.py: x", "a/0.py: y", "a/1.py: x", "a/1.py: y", "a/2.py: x"]


def test_places_in_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(50), k) for k in range(400)] + [(None, 1, 900), (None, 0, 901)]
    table = spark.createDataFrame(rows, "g string, v int, id int").repartition(3)
    expected = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            expected[r[2]] = place
    assert {r["id"]: r["place"] for r in analytics.placed_in_group(table, ["g"], ["v", "id"]).collect()} == expected
    found = {r["g"]: (r["n"], r["percentile"]) for r in analytics.exact_percentile(table, ["g"], "v", 0.5).collect()}
    for g in ("a", "b", None):
        values = sorted(r[1] for r in rows if r[0] == g)
        assert found[g] == (len(values), values[min(len(values) // 2, len(values) - 1)])


@pytest.mark.parametrize("n", [0, 1, 7, 60, 299, 300, 301, 5000])
def test_first_rows(spark, n):
    """Rows with nulls and ties, by two keys of both directions."""
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "c"]), k) for k in range(300)]
    table = spark.createDataFrame(rows, "v int, s string, id int").repartition(5)
    made = curation.first_rows(table, [(F.col("v"), True), (F.col("s"), False)], n)
    key = lambda v, s: (v is None, -(v or 0), s is not None, s or "")
    want = sorted(key(v, s) for v, s, _ in rows)[:n]
    got = made.collect()
    assert sorted(key(r["v"], r["s"]) for r in got) == want and len({r["id"] for r in got}) == len(want)
    if n == 60:  # unique keys: no row is sorted or moved
        unique = curation.first_rows(table, [(F.col("id"), True)], n)
        assert sorted(r["id"] for r in unique.collect()) == list(range(240, 300))
        assert "TakeOrdered" not in unique._jdf.queryExecution().toString() and "Limit" not in unique._jdf.queryExecution().toString()


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    from quernstone.plans import registry

    spark.createDataFrame([(1, [1.0, -1e-8, 0.0, 1e-8, -0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.queries()["mt1_vector_math"](spark, str(tmp_path)).first()
    assert list(map(str, found["unit"])) == ["1.0", "-0.0", "0.0", "0.0", "-0.0"]


def test_long_texts_are_encoded_as_far_as_the_budget(spark):
    import public_tokenizers

    from quernstone.functions.budget import Tokens

    tokens, lengths = Tokens(public_tokenizers.path("byte_bpe_50k.json")), []
    inner = tokens.tokenizer

    class Watched:
        def encode(self, text, add_special_tokens=False):
            lengths.append(len(text))
            return inner.encode(text, add_special_tokens=add_special_tokens)

    tokens.tokenizer = Watched()
    words = " ".join(f"word number {k}" for k in range(20_000))
    cut = tokens.within(words, 256)
    assert max(lengths) <= 8 * 256
    assert len(inner.encode(cut, add_special_tokens=False).ids) <= 256 and words.startswith(cut[:500])


def test_only_asked_symbols_are_moved(spark):
    """The symbols of all chunks are cut to those asked for before they are ranked."""
    chunks = spark.createDataFrame([(f"c#{k}", ["a", "b"] if k % 2 else [f"s{k}"]) for k in range(12)], "chunk_id string, defines array<string>")
    found = spark.createDataFrame([("q", 1, "c#1"), ("q", 2, "c#2")], "query_id string, rank long, chunk_id string")
    symbols = chunks.select(F.explode("defines").alias("symbol"), "chunk_id")
    more = retrieval.expanded(found, chunks, symbols, 2, 3, 4, 2)
    assert [(r["place"], r["chunk_id"]) for r in more.orderBy("place").collect()] == [(1, "c#11"), (2, "c#3"), (3, "c#5"), (4, "c#7")]
    assert "LeftSemi" in more._jdf.queryExecution().optimizedPlan().toString()
