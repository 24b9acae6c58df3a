"""Merkle manifest, fingerprints and phrases against brute force, and their odd cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import merkle, phrases, prints

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and blank texts, repeated rows and ids, columns that clash."""
    rows = [
        (None, "a", "en", 3, "one two"), (None, None, None, None, None), (1, "a", "en", 7, "x\ny\nz"), (1, "a", "en", 7, "x\ny\nz"), (1, "a", "en", 8, "x y"),
        (2, "", "de", 0, ""), (4, None, "en", 1, "\n"), (5, "ä", "und", 2, "ä\n🙂 b c d e f g"), (6, "b", None, 2, "  \t "), (-3, "b", "en", 2, "Same. same same"),
    ]
    path = str(tmp_path_factory.mktemp("odd"))
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("path", "top", "grp", "_turn", "_range", "turn", "mark", "print", "phrase", "n", "words"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, arity):
    """Root of a list of nodes, and each one's siblings by level."""
    at, paths, nodes = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(nodes) > 1:
        for k in range(len(leaves)):
            low = at[k] - at[k] % arity
            run = nodes[low : low + arity]
            paths[k].append(("".join(run[: at[k] - low]), "".join(run[at[k] - low + 1 :])))
            at[k] //= arity
        nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def expected_manifest(rows, arity=3):
    digest = lambda r, text: h("".join(map(shown, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    groups = collections.defaultdict(list)
    for r in rows:
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        text = r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, digest(r, r["text"]), digest(r, text), r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(groups[s])], arity) for s in names}
    root, upper = tree([subs[s][0] for s in names], arity)
    out = []
    for s, above in zip(names, upper, strict=True):
        for x, path in zip(sorted(groups[s]), subs[s][1], strict=True):
            acc = x[3]
            for left, right in path + above:
                acc = h(left + acc + right)
            out.append((x[4], x[2], subs[s][0], root, h("".join(a + b for a, b in path + above)), acc, acc == root))
    return out


def same_rows(frame, columns, expected):
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, frame.select(*columns).collect())) == sorted(map(key, expected))


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_documents(spark, sf_dir, documents):
    expected = expected_manifest(documents.collect())
    same_rows(merkle.op11_merkle(spark, sf_dir), MANIFEST, expected)
    assert {x[-1] for x in expected} == {True, False}


def test_manifest_of_odd_rows(spark, odd):
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    same_rows(merkle.op11_merkle(spark, odd), MANIFEST, expected_manifest(rows))


@pytest.mark.parametrize("sizes", [[1], [2, 1, 3], [27, 9, 28, 1, 80], [1] * 30, [300]])
def test_manifest_over_several_traversals(spark, sizes):
    """Blocks of nine nodes, so that groups and the tree above them take up to three."""
    rows = [(f"g{g:02}", k, h(f"{g}-{k}")) for g, n in enumerate(sizes) for k in range(n)]
    made = merkle.manifest(spark.createDataFrame(rows, "grp string, id long, digest string").repartition(5), merkle.Tree(levels=2)).collect()
    subs = {}
    for g, n in enumerate(sizes):
        subs[f"g{g:02}"] = tree([h(f"{g}-{k}") for k in range(n)], 3)
    root, upper = tree([subs[s][0] for s in sorted(subs)], 3)
    assert len(made) == len(rows)
    for r in made:
        whole = subs[r["grp"]][1][r["id"]] + upper[int(r["grp"][1:])]
        assert (r["subroot"], r["root"], [tuple(p) for p in r["path"]]) == (subs[r["grp"]][0], root, whole)


def test_many_equal_leaves(spark):
    rows = spark.range(500).select(F.lit("s").alias("grp"), F.lit(7).cast("long").alias("id"), F.lit(h("x")).alias("digest"))
    made = merkle.manifest(rows, merkle.Tree(levels=2)).collect()
    root, paths = tree([h("x")] * 500, 3)
    assert {r["root"] for r in made} == {root}
    assert sorted(str([tuple(p) for p in r["path"]]) for r in made) == sorted(map(str, paths))


def test_empty_tables(spark, empty):
    assert merkle.op11_merkle(spark, empty).collect() == []
    assert prints.op12_prints(spark, empty).collect() == []
    assert phrases.op13_phrases(spark, empty).collect() == []


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prints_agree(found, texts):
    """Whole results beside brute force; ``texts`` in order. Estimates are unbiased."""
    assert len(found) == len(texts)
    off, by_text = [], {}
    for r, text, after in zip(found, texts, texts[1:] + texts[:1], strict=True):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), h(changed))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"] and by_text.setdefault(changed, r["edited_fingerprint"]) == r["edited_fingerprint"]
        for near, other in ((r["near_edited"], changed), (r["near_next"], after)):
            assert 0 <= near <= 1
            off.append((near - similarity(text, other), len(shingle_set(text) | shingle_set(other))))
    return off


def test_prints_of_documents(spark, sf_dir, documents):
    docs = documents.orderBy("doc_id").collect()
    found = prints.op12_prints(spark, sf_dir).orderBy("doc_id").collect()
    off = np.array(prints_agree(found, [d["text"] for d in docs]))
    assert abs(off[:, 0].mean()) < 0.005 and off[:, 0].std() < 0.03
    assert abs(off[off[:, 1] > 200, 0]).max() < 0.12
    assert {len(r["fingerprint"]) for r in found} == {512}


def test_prints_of_odd_rows(spark, odd):
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["mark"]))
    made = prints.op12_prints(spark, odd).collect()
    edits = collections.Counter()
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(r["text"]) // 2
        edits[(r["doc_id"], len(r["text"]), h(r["text"][: len(r["text"]) - half] + after["text"][:half]))] += 1
    assert edits == collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in made)
    bare = [r for r in made if r["doc_id"] in (2, 4, 6)]
    assert {r["fingerprint"] for r in bare} == {""} and {r["near_edited"] for r in bare if r["doc_id"] in (2, 4)} == {1.0}


@pytest.mark.parametrize("n", [1, 2, 9])
def test_prints_with_fewer_rows_than_ranges(spark, n):
    texts = [f"text {k} of a few words and more {k * k}" for k in range(n)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    prints_agree(prints.with_next(docs).orderBy("doc_id").collect(), texts)


def test_prints_of_one_hot_row_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "w x y z 1 2 3")] * 300 + [("b", "quite another text here now"), (None, "x" * 3_000_000 + " end")], "doc_id string, text string")
    made = prints.with_next(docs.repartition(4)).collect()
    assert len(made) == 302
    assert sum(r["near_next"] == 1.0 for r in made) == 299
    assert max(r["n_chars"] for r in made) == 3_000_004


def test_densified_bins_agree_as_often_as_sets(spark):
    """Short texts: most bins are empty, and the estimate stays unbiased."""
    rng = np.random.default_rng(3)
    printer, shape, off = prints.Printer(), prints.Print(), []
    for _ in range(300):
        base = rng.integers(0, 10**9, 24).astype(str).tolist()
        cut = int(rng.integers(0, 20))
        a, b = " ".join(base), " ".join(base[:cut] + rng.integers(0, 10**9, 24 - cut).astype(str).tolist())
        x, y = printer.prints([a.encode(), b.encode()])
        off.append(prints.likeness([x], [y], shape)[0] - similarity(a, b))
    assert abs(np.mean(off)) < 0.02


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def expected_phrases(rows, least=10, keep=2000, longest=3):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    some = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in some.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = (lang, words[k : k + size])
                if part in some and 100 * a >= 50 * some[part]:
                    gone.add(part)
    out = collections.defaultdict(list)
    for (lang, words), a in some.items():
        if (lang, words) not in gone:
            cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang in out for rank, (s, a, p, left, right) in enumerate(sorted(out[lang])[:keep], 1)]


def test_phrases_of_documents(spark, sf_dir, documents):
    expected = expected_phrases([(r["lang"], r["text"]) for r in documents.collect()])
    assert len(expected) > 50
    same_rows(phrases.op13_phrases(spark, sf_dir), PHRASES, expected)


@pytest.mark.parametrize("mining", [phrases.Mining(longest=4, least=3, keep=40, shard=500, slice=64), phrases.Mining(longest=2, least=2, most_bits=1 << 19), phrases.Mining(longest=5, least=4, bits_each=1)])
def test_phrases_in_small_shards(spark, mining):
    """Shards of a few hundred tokens, texts read in slices, phrases of up to five words."""
    rng = np.random.default_rng(4)
    words = ["a", "B", "ß", "c1", "\x1c", "İ", "🙂", "the", "of"]
    rows = []
    for k in range(60):
        picks = rng.choice(words, int(rng.integers(0, 80)), p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.1, 0.05])
        ends = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?"], len(picks), p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.03, 0.02, 0.05])
        rows.append((["en", "de", None, "und"][k % 4], "".join(w + e for w, e in zip(picks, ends, strict=True))))
    rows += [("en", None), ("en", ""), ("de", " . \n"), ("en", "the of the of")] * 3
    made = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), mining)
    expected = expected_phrases(rows, mining.least, mining.keep, mining.longest)
    assert expected
    same_rows(made, PHRASES, expected)


def test_phrases_of_odd_rows(spark, odd):
    assert phrases.op13_phrases(spark, odd).collect() == []
    made = phrases.collocations(spark.read.parquet(f"{odd}/documents.parquet"), phrases.Mining(least=1))
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("lang", "text").collect()
    same_rows(made, PHRASES, expected_phrases(rows, least=1))


def test_suffix_array_orders_by_whole_prefix():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 4, 400).astype(np.int32)
    for words in (1, 2, 3, 5, 8):
        live = np.arange(len(ids) - words)
        made = phrases.suffix_array(ids, words, live)
        prefixes = [tuple(ids[k : k + words]) for k in made]
        assert prefixes == sorted(prefixes) and sorted(made) == live.tolist()
