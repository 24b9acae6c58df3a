"""Operators on documents, against brute force on small fixtures that hold nulls, empty
and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import lm, mixing, ngrams, packing, quality, shards, suffixes
from quernstone.llm.common import Scratch, connected, crc_of_id, numbered, placed_among_equals
from quernstone.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, size string, `index` int"


def fixture_rows(seed=0, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, texts = prose(60), []
    for k in range(n):
        texts.append(prose(rng.randint(3, 200)))
    for k in range(0, 8):
        base = texts[k].split()
        base[len(base) // 2] = "changed"
        texts.append(" ".join(base))  # near copies
        texts.append(texts[k])  # exact copies
        texts.append(f"{prose(10)}\n{passage} {prose(10)}")
    texts += [None, "", "   \n", "one two", "one two", "Le " * 90, "ab" * 300, "A B C D E", "a b c d e", prose(6000), "x <|endoftext|> y", "two  spaces   here\n\n end "]
    rows = [(k, t, "en", f"src{k % 5}" if k % 7 else None, len(t or ""), 3, "big", 1) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_connected(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, 501 + k) for k in range(100)] + [(7, 7)]
    found = connected(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    expected = components({x for e in edges for x in e}, edges)
    got = {r["id"]: r["component"] for r in found.collect()}
    assert got == {k: v for k, v in expected.items() if k in got} and set(expected) - set(got) <= {7}


def test_numbered(spark):
    values = random.Random(2).sample(range(10_000), 500) + [None, None]
    found = numbered(Scratch(spark, "t"), spark.createDataFrame([(v,) for v in values], "v long"), [F.col("v").asc_nulls_last()], "n")
    got = sorted((r["index"], r["v"]) for r in found.collect() if r["v"] is not None)
    assert [v for _, v in got] == sorted(v for v in values if v is not None) and [i for i, _ in got] == list(range(500))


def shingles_of(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def shingle_sets(rows):
    return {i: shingles_of(text) for i, text, *_ in rows}


def similar(s, t):
    return s and t and 100 * len(s & t) >= 80 * len(s | t)


def row_components(rows):
    """Component of every row, by its place; a null id is linked with nothing."""
    sets = [shingles_of(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if None not in (rows[a][0], rows[b][0]) and similar(sets[a], sets[b])]
    return sets, components(range(len(rows)), links)


ODD = [(None, "q w e r t y u i o p", "en", "src1", 0, 3, "big", 1), (None, "q w e r t y u i o p", "en", None, 0, 3, "big", 1), (None, None, None, None, None, None, None, None), (None, "xyz" * 100, "en", "src1", 0, 3, "big", 1)]
#: one id with two texts, each of which another row holds too
PAIRED = [(905, "aa bb cc dd ee ff gg", "en", "src1", 0, 3, "big", 1), (905, "hh ii jj kk ll mm nn", "en", "src1", 0, 3, "big", 1), (907, "hh ii jj kk ll mm nn", "en", "src1", 0, 3, "big", 1), (908, "aa bb cc dd ee ff gg", "en", "src1", 0, 3, "big", 1)]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows + ODD + PAIRED, SCHEMA).repartition(3)


def test_ngram_groups(docs, odd, rows, none):
    for table, given in ((docs, rows), (odd, rows + ODD + PAIRED)):
        sets, low = row_components(given)
        lowest = {}
        for k, c in low.items():
            if given[k][0] is not None:
                lowest[c] = min(lowest.get(c, given[k][0]), given[k][0])
        expected = Counter((r[0], len(s), lowest.get(low[k])) for k, (r, s) in enumerate(zip(given, sets, strict=True)))
        assert Counter(map(tuple, ngrams.similar_groups(table).collect())) == expected
    assert ngrams.similar_groups(none).count() == 0


def test_one_of_each(docs, odd, rows, none):
    for table, given in ((docs, rows), (odd, rows + ODD + PAIRED)):
        sets, low = row_components(given)
        kept = ngrams.one_of_each(table)
        got = [tuple(r) for r in kept.collect()]
        assert kept.columns == table.columns
        places = defaultdict(list)
        for k, r in enumerate(given):
            places[r[:2]].append(k)
        groups = Counter(low[places[r[:2]][0]] for r in got if r[0] is not None and shingles_of(r[1]))
        assert groups == Counter({low[k]: 1 for k, r in enumerate(given) if r[0] is not None and sets[k]})
        alone = Counter(r[:2] for k, r in enumerate(given) if r[0] is None or not sets[k])
        assert Counter(r[:2] for r in got if r[0] is None or not shingles_of(r[1])) == alone
    texts = {r[1] for r in got if r[0] in (905, 907, 908)}
    assert texts == {PAIRED[0][1], PAIRED[1][1]}
    assert ngrams.one_of_each(none).count() == 0


@pytest.mark.parametrize("block", [2, 6])
def test_ngram_blocks_are_tiled(odd, block):
    whole = Counter(map(tuple, ngrams.similar_groups(odd).collect()))
    assert Counter(map(tuple, ngrams.similar_groups(odd, ngrams.Join(block=block)).collect())) == whole


def test_template_families_are_dealt_by_key(spark):
    """Documents with a third in common chain into one set that is larger than a block."""
    rng = random.Random(4)
    common = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(300):
        own = [f"w{rng.randrange(5000)}" for _ in range(70)]
        rows.append((k, " ".join(common + own)))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join(common + own[:-2])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    _, low = row_components(rows)
    lowest = {k: rows[c][0] for k, c in low.items()}
    for join in (ngrams.Join(), ngrams.Join(block=40)):
        assert {r["doc_id"]: r["component_id"] for r in ngrams.similar_groups(table, join).collect()} == {rows[k][0]: c for k, c in lowest.items()}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(len(base) * rng.uniform(0.7, 1))], rng.integers(0, 2**63, 3).astype(np.uint64)]))]
    ids = range(len(sets))
    close = [(a, b) for a in ids for b in ids if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert components(ids, close) == components(ids, ngrams.links_in(sets, ngrams.Join()))
    cuts = rng.integers(0, 2, len(sets))
    across = [(a, b) for a, b in close if cuts[a] != cuts[b]]
    assert components(ids, across) == components(ids, ngrams.links_in(sets, ngrams.Join(), cuts))


def removed(rows):
    """By id and text."""
    seen, out = set(), {}
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    for i, text, *_ in sorted({r[:2] for r in rows}, key=order):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i, text] = (i, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest(), None if text is None else left.decode(errors="ignore"))
    return out


LONG = " ".join(f"word{k}" for k in range(60))
REPEATING = [(None, LONG, "en", "s", 0, 1, "x", 1), (None, f"{LONG} and more", "en", "s", 0, 1, "x", 1), (910, LONG[50:], "en", "s", 0, 1, "x", 1), (911, f"a {LONG}", "en", "s", 0, 1, "x", 1), (911, f"b {LONG}", "en", "s", 0, 1, "x", 1)]


def test_suffix_removal(spark, docs, rows, none, monkeypatch):
    whole = rows + ODD + REPEATING
    every = spark.createDataFrame(whole, SCHEMA).repartition(3)
    names = "sum copy spans _copy _spans _of _id _doc index_ digest".split()
    wide = every.withColumns({c: F.lit("x") for c in names})
    # frequent grams dealt by window, without and with a sample that finds them
    for table, given, hot in ((docs, rows, False), (every, whole, False), (every, whole, True)):
        if hot:
            monkeypatch.setattr(suffixes, "Counter", lambda grams: dict.fromkeys(grams, 10**9))
        expected = removed(given)
        got = suffixes.removal_report(table).collect()
        assert Counter(map(tuple, got)) == Counter(expected[r[:2]][:5] for r in given)
    assert sum(r[2] for r in expected.values()) > 2000
    kept = suffixes.without_repeats(wide)
    assert kept.columns == wide.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], expected[r[:2]][5]) for r in whole)
    assert suffixes.removal_report(none).count() == 0 and suffixes.without_repeats(none).count() == 0


def test_suffix_steps(monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 64)
    data = ("abc " * 100 + "xyz" * 50).encode()
    whole = [a.tolist() for a in suffixes.anchors(data)]
    monkeypatch.setattr(suffixes, "STEP", 1 << 19)
    assert [a.tolist() for a in suffixes.anchors(data)] == whole


def test_multikey_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 99, (400, 100)).astype(np.uint8)
    rows[200:] = rows[:200]
    rows[100:150, 30:] = rows[0, 30:]
    order, shared = suffixes.multikey_order(rows)
    strings = [rows[k].tobytes() for k in order]
    assert strings == sorted(strings)
    assert all(strings[k][:s] == strings[k - 1][:s] and (s == 100 or strings[k][s] != strings[k - 1][s]) for k, s in enumerate(shared.tolist()) if k)


def test_text_without_repeats(docs):
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[0]["text"] == {r["doc_id"]: r for r in docs.collect()}[0]["text"]
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in rows.values())


#: Names that operators use inside.
INNER = "_id _ID _sum _of _copy _copies _copied spans copy copies_ size_ target source_size _source _salt _rowsalt _size _target _score q_chars q_words _row _row2 component low class node sum key id first n".split()


def test_names_inside_operators_are_no_clash(spark, docs, rows):
    """Whatever the further columns are called, the stages carry them along."""
    wide = docs.select("*", *[F.lit(7).alias(n) for n in INNER if n.lower() not in {c.lower() for c in docs.columns} and n != "_ID"])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for plain, stage in (
        (quality.keep_good(docs, labels), quality.keep_good(wide, labels)), (ngrams.one_of_each(docs), ngrams.one_of_each(wide)),
        (suffixes.without_repeats(docs), suffixes.without_repeats(wide)), (mixing.mixed(docs), mixing.mixed(wide)),
    ):
        assert stage.columns == wide.columns
        got = stage.collect()
        assert all(r["_sum"] == 7 and r["key"] == 7 for r in got)
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in plain.collect())
    assert Counter(map(tuple, ngrams.similar_groups(wide).collect())) == Counter(map(tuple, ngrams.similar_groups(docs).collect()))
    assert packing.pack_documents(wide).count() == packing.pack_documents(docs).count()


def test_rows_without_ids(spark, odd, rows, tokenizer, tmp_path):
    """Null ids stay null, and none is lost, in every operator on documents."""
    given = rows + ODD + PAIRED
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    ids = Counter(r[0] for r in given)
    assert Counter(r["doc_id"] for r in quality.score_documents(odd, labels).collect()) == ids
    assert not any(r["held_out"] for r in quality.score_documents(odd, labels).where("doc_id IS NULL").collect())
    big = 2**60 + 1  # would be rounded as a float
    table = odd.withColumn("doc_id", F.col("doc_id") + big)
    ids = Counter(None if r[0] is None else r[0] + big for r in given)
    assert Counter(r["doc_id"] for r in lm.score_documents(table, crc_of_id("doc_id") % 7 == 2).collect()) == ids
    assert Counter(r["doc_id"] for r in ngrams.similar_groups(table).collect()) == ids
    assert Counter(r["doc_id"] for r in suffixes.removal_report(table).collect()) == ids
    assert Counter(r["doc_id"] for r in mixing.plan_mix(table).collect()) == ids
    assert Counter(r["doc_id"] for r in packing.pack_documents(table).where("start = 0").collect()) == ids
    table.write.parquet(str(tmp_path / "docs"))
    layout = shards.Layout(tokens=64, places=100)
    assert shards.write_shards(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "s"), layout)
    assert Counter(r["doc_id"] for r in shards.read_shards(spark, str(tmp_path / "s"), layout).where("piece = 0").collect()) == ids


def test_shards_retry_a_changed_scan(spark, docs, tmp_path, monkeypatch):
    """A scan that is parted otherwise than when it was measured is measured again."""
    docs.write.parquet(str(tmp_path / "docs"))
    table, once, ranges = spark.read.parquet(str(tmp_path / "docs")), [], shards._ranges

    def wrong(*args):
        found = ranges(*args)
        if not once:
            once.append(1)
            found.rows = found.rows + 1
        return found

    monkeypatch.setattr(shards, "_ranges", wrong)
    assert shards.write_shards(table, str(tmp_path / "s"))
    assert shards.read_shards(spark, str(tmp_path / "s")).where("piece = 0").count() == docs.count() and once


LONG_RUNS = [(1, " " * 1_500_000), (2, "a" + "\r\n" * 800_000), (3, "w" * 2_000_000), (4, "\n" * 1_200_000 + "end"), (5, "x y " * 300_000)]


def test_texts_of_megabytes(spark, tmp_path):
    """Long runs of blanks and line breaks and one long word go through all operators."""
    table = spark.createDataFrame([(i, t, "s") for i, t in LONG_RUNS], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, quality int")
    n = len(LONG_RUNS)
    assert packing.pack_documents(table).where("start = 0").count() == n
    table.write.parquet(str(tmp_path / "docs"))
    assert shards.write_shards(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "s"))
    assert shards.read_shards(spark, str(tmp_path / "s")).where("piece = 0").count() == n
    report = {r["doc_id"]: r for r in suffixes.removal_report(table).collect()}
    assert report[1]["n_removed"] == 1_500_000 - 1 and report[1]["n_bytes"] == 1_500_000
    assert {r["doc_id"]: r["n_shingles"] for r in ngrams.similar_groups(table).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}
    assert quality.score_documents(table, labels).count() == n and mixing.plan_mix(table).count() == n
    assert lm.score_documents(table, F.lit(False)).count() == n


def test_mixing(docs, rows, none):
    size = {i: len((t or "").replace("\n", " ").split()) for i, t, *_ in rows}
    per = defaultdict(int)
    for i, _, _, source, *_ in rows:
        per[source] += size[i]
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [s for s in per if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target = 1.5 * sum(per.values()), {}
    while len(target) < len(per):
        rest = [s for s in per if s not in target]
        level = (budget - sum(target.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * per[s]]
        target |= {s: 2.0 * per[s] for s in over} if over else {s: level * weight[s] for s in rest}
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        rate = target[r["source"]] / per[r["source"]]
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["copies"] <= 2
    again = sorted(map(tuple, mixing.plan_mix(docs).select("doc_id", "copies").collect()))
    assert again == sorted((r["doc_id"], r["copies"]) for r in got)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.plan_mix(none).count() == 0


def test_mixing_with_many_sources(docs, monkeypatch):
    few = sorted((r["doc_id"], r["copies"]) for r in mixing.plan_mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.plan_mix(docs).collect()) == few


def test_mixing_reaches_targets_without_ids(spark):
    """Rows without an id, with one id, and equal ones: each makes a draw of its own."""
    for rows in (
        [(None, f"word number {k} of this text", "s") for k in range(500)], [(7, f"word number {k} of this text", "s") for k in range(500)],
        [(None, "one two three four five", "s")] * 500, [(k, "one two three four five", "s") for k in range(500)],
    ):
        # the second source is large and stops early, so the first one's rate is a fraction
        rows = rows + [(10_000 + k, "a b c d e f g", "t") for k in range(300)]
        table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        made = mixing.plan_mix(table).where("source = 's'").collect()
        taken, target = sum(r["size"] * r["copies"] for r in made), made[0]["target"]
        assert len(made) == 500 and abs(taken - target) < 0.05 * target
        assert len({r["copies"] for r in made}) == 2 or target == 2 * made[0]["source_size"]
        whole = mixing.mixed(table).where("source = 's'").count()
        assert whole == sum(r["copies"] for r in made)


def test_places_among_equals(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x", k) for k in range(70)] + [(1, None, k) for k in range(30)] + [(k, "y", k) for k in range(50)], "a long, _part string, k long").repartition(6)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    made = placed_among_equals(Scratch(spark, "places"), rows, ["a", "_part"], "at", "counts").collect()
    by = defaultdict(list)
    for r in made:
        by[r["a"], r["_part"]].append(r["at"])
    assert len(made) == 150 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_start_run_is_bounded(spark):
    shape = lm.Shape(start_docs=100, start_bytes=20_000)
    tables = [[(None, f"text {k} of many") for k in range(3000)], [(1, f"text {k} of many") for k in range(3000)], [(k, "the same text") for k in range(3000)], [(k, "w " * (k % 700)) for k in range(1400)], [(0, None)]]
    for rows, least in zip(tables, (20, 20, 0, 1, 0), strict=True):
        texts = [r["text"] for r in lm.start_texts(spark.createDataFrame(rows, "doc_id long, text string"), shape).collect()]
        assert least <= len(texts) <= 130 and len(set(texts)) == len(texts)
        assert sum(len(t) for t in texts) <= 30_000


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "  ", "a", " a b", "a  b", "a \n b", "end ", "tab\tand nbsp x", "don't we'll I'm", "x <|endoftext|> y", "é è ß 12,5 %%%", "\x1c a \x1d b", "日本 語 text", "a\r\n b"]


def test_encoder(tokenizer, rows):
    encoder = Encoder()
    for text in TEXTS + [r[1] or "" for r in rows]:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.raw(text), "<u4").tolist() == expected


def test_packing(docs, rows, none, tokenizer):
    found = [r.asDict() for r in packing.pack_documents(docs).collect()]
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    times = Counter(r[0] for r in rows)
    for i, text, *_ in {r[:2] for r in rows}:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)] if len(ids) > 2048 else [0]
        expected = [(k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(expected * times[i])
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.choice([300, 1100, 2048]), 400)
    bins, offsets, left = packing.best_fit(lengths, 2048)
    loads = np.bincount(bins, lengths)
    assert (loads + left == 2048).all() and (left >= 0).all()
    bound = packing.lower_bound(lengths, 2048)
    assert -(-lengths.sum() // 2048) <= bound <= len(left)
    assert packing.lower_bound(np.full(10, 1025), 2048) == 10


def test_packing_exchanges(spark, docs):
    pieces = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(np.random.default_rng(0).integers(1, 2048, 3000))], packing.PIECES)
    found = packing.pack(Scratch(spark, "t"), pieces, part=200).collect()
    loads = Counter()
    for r in found:
        loads[r["sequence_id"]] += r["length"]
    assert len(found) == 3000 and max(loads.values()) <= 2048
    one = packing.best_fit(np.array([r["length"] for r in found]), 2048)[2]
    assert len(loads) <= len(one) + 3


def test_quality(spark, none):
    rng = random.Random(0)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "to", "of"]) + rng.choice(["", ",", ""]) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for k in range(300):
        good = k % 4 != 0
        text = prose(rng.randint(10, 80))
        if not good:
            text = text.upper().replace(" ", "!! ") if k % 8 else " | ".join(text.split())
        rows.append((k, text, "en", "s", len(text), 1, "x", 1))
        labels.append((k, int(good), 0))
    rows += [(1000, None, None, None, None, None, None, None), (1001, "", "en", "s", 0, 1, "x", 1), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.score_documents(docs, known).collect()}
    assert len(found) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    out = [i for i in range(300) if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == labels[i][1] for i in out) / len(out) > 0.95
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if found[r[0]]["predicted"])
    unlabelled = quality.score_documents(docs, known.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in unlabelled] == [0.5]
    assert quality.score_documents(none, known).count() == 0


def counted(text):
    """The statistics, in plain Python."""
    import regex

    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    chars = max(len(text), 1)
    of = lambda pattern: len(regex.findall(pattern, text))
    per = lambda n: n / max(len(words), 1)
    runs = regex.split(r"[ \t\n\x0b\f\r]+", text)
    repeats = sum(bool(a) and a == b for a, b in zip(runs, runs[1:], strict=False))
    symbols = sum(not regex.match(r"[\p{L}\p{N} \t\n\x0b\f\r.,;:!?'\"()\-|]", c) for c in text)
    return {
        "q_chars": len(text), "q_words": len(words), "q_word_chars": per(len(text)), "q_upper": of(r"\p{Lu}") / chars, "q_digits": of("[0-9]") / chars, "q_symbols": per(symbols),
        "q_bars": per(of(r"\|")), "q_marks": per(of("[!?]")), "q_stops": per(of("[.,;:]")), "q_lines": per(of("\n")), "q_repeats": per(repeats),
    }


def test_statistics_and_compiled_column(spark, docs, rows):
    """Statistics against plain Python, and the column against a sum over the rules."""
    columns = [c.alias(n) for n, c in quality.statistics(F.col("text")).items()]
    texts = [r[1] for r in rows] + ["a a a b b", "ÀÉ 12 § §§ x|y|z !?", "one one\none", "end\n\n"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    x = []
    for r in table.select("doc_id", *columns).orderBy("doc_id").collect():
        expected = counted(texts[r["doc_id"]] or "")
        for name in quality.NAMES:
            assert math.isclose(r[name], expected[name], rel_tol=1e-12), (name, texts[r["doc_id"]])
        x.append([expected[n] for n in quality.NAMES])
    rng = np.random.default_rng(0)
    data = np.array(x)
    ensemble = quality.fit_rules(data, (data[:, 1] > np.median(data[:, 1])) ^ (rng.random(len(data)) < 0.1))
    assert len(ensemble.rules) > 1
    for r in quality.scored(table, ensemble, "score").collect():
        stats = counted(texts[r["doc_id"]] or "")
        fires = [w.weight for w in ensemble.rules if all((stats[n] > b) == above for n, above, b in w.terms)]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(ensemble.intercept + sum(fires)))), rel_tol=1e-9)


def test_scores_of_the_language_model(spark, docs, rows, monkeypatch):
    """A text's score is the sum of its tokens' log probabilities, each computed anew from
    the weights: class by softmax, then word within the class."""
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("x", train(*a, **k)))
    shape = lm.Shape(own=20, endings=8, sent=60, per_root=1.0)
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    counts = Counter(w for r in rows if not held[r[0]] for w in lm.words_of(r[1]))
    got = {r["doc_id"]: r for r in lm.score_documents(docs, crc_of_id("doc_id") % 7 == 2, shape).collect()}
    _, fitted = kept["x"]
    model, inner, classes = fitted.model, fitted.model.inner, fitted.classes()
    r1, r2, q, b, rin, qin, bin_ = (p.astype("f8") for p in model.parts)

    def token(u, v, word, fine_v):
        fine = classes[word]
        w = int(inner.coarse[fine])
        x = (r1[u] + r2[v]) @ q.T + b
        log = x[w] - x.max() - np.log(np.exp(x - x.max()).sum())
        slot = inner.slot[fine]
        if slot >= 0:
            k = w - inner.first
            one, end = inner.bounds[k], inner.bounds[k + 1]
            y = rin[fine_v] @ qin[one:end].T + bin_[one:end]
            log += y[slot - one] - y.max() - np.log(np.exp(y - y.max()).sum())
        if inner.rest[fine]:
            log += math.log((counts[word] + 1) / fitted.sums[w])
        return log / math.log(10)

    for r in rows[::5]:
        words, total = lm.words_of(r[1]), 0.0
        fine = [classes[w] for w in words]
        coarse = [int(inner.coarse[f]) for f in fine]
        for k, word in enumerate(words):
            v = coarse[k - 1] if k else 0
            u = coarse[k - 2] if k > 1 and v else 0
            total += token(u, v, word, fine[k - 1] if k else 0)
        assert math.isclose(got[r[0]]["score"], total, rel_tol=1e-4, abs_tol=1e-3), r[0]


def test_language_model(docs, rows, none):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t, *_ in rows}
    counts = Counter(w for i, *_ in rows if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    for shape in (lm.Shape(), lm.Shape(own=20, endings=8, sent=60)):
        got = lm.score_documents(docs, crc_of_id("doc_id") % 7 == 2, shape).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["doc_id"]
            assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(words[i]), n)
            assert r["n_known"] == sum(w in counts for w in words[i])
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]), rel_tol=1e-9)
            assert r["score"] < 0
    assert lm.score_documents(none, crc_of_id("doc_id") % 7 == 2).count() == 0


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    shares = rng.random(40)
    model = lm.Model(shares / shares.sum(), lm.Shape(own=30, endings=10, dim=8))
    for _ in range(50):
        model.learn(*(rng.integers(0, 40, 64) for _ in range(3)), rng)
    a, c, z = model.tables()
    for u, v in ((0, 1), (5, 39), (12, 12)):
        assert math.isclose((10.0 ** (a[u] + c[v] - z[u, v]).astype("f8")).sum(), 1, rel_tol=1e-4)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(shards.feistel(np.arange(n), n, 42).tolist()) == list(range(n))


def test_shards(spark, docs, rows, none, tokenizer, tmp_path):
    layout = shards.Layout(tokens=32, places=50)
    docs.write.parquet(str(tmp_path / "docs"))
    assert shards.write_shards(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "s"), layout)
    found = shards.read_shards(spark, str(tmp_path / "s"), layout).collect()
    n = len(found)
    assert sorted(r["slot"] for r in found) == list(range(n))
    expected = Counter()
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 32):
            expected[i, k // 32, np.array(ids[k : k + 32], "<u2").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in found) == expected
    later = shards.read_shards(spark, str(tmp_path / "s"), layout, start=n - 60)
    assert sorted(r["slot"] for r in later.collect()) == list(range(n - 60, n))
    assert shards.write_shards(none, str(tmp_path / "none"), layout) is False


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\r\n" * 700_000 + "b", "\n" * 1_100_000, "x" * 2_000_000, "é " * 100_000])
def test_encoder_on_very_long_runs(tokenizer, text):
    assert np.frombuffer(Encoder().raw(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
