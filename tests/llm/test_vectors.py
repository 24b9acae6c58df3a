"""Operators on vectors and pages, against brute force."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.llm import common, search, vectors, warc


def vector_rows(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, 60, 2):
        x[k + 1] = x[k] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.uniform(0, 0.5)
    x[100:110] = x[99]
    x = x.astype("f4")
    rows = [(k, [float(v) for v in x[k]], int(k // 2 % 3)) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [nan] * dim, 1), (n + 3, [inf] + [1.0] * (dim - 1), 1), (n + 4, [1.0, 2.0], 1), (n + 5, rows[0][1], None)]
    rows += [(None, rows[4][1], rows[4][2]), (None, rows[4][1], rows[4][2])]
    rows += [(n + 6, [None] + [1.0] * (dim - 1), 1), (n + 7, [], 1), rows[99]]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, label int").repartition(3)


def good(row):
    return row[1] and all(v is not None and np.isfinite(v) for v in row[1]) and any(row[1])


def test_near_groups(spark, table):
    rows = vector_rows()
    usable = [(k, np.array(r[1], "f8")) for k, r in enumerate(rows) if good(r) and None not in (r[0], r[2])]
    links = {k: set() for k in range(len(rows))}
    for a, x in usable:
        for b, y in usable:
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a].add(b)
    low = {k: rows[k][0] for k in links}
    key = lambda r: tuple(map(str, r))
    for _ in range(len(rows)):
        low = {k: min([low[k], *(low[j] for j in links[k])]) if links[k] else low[k] for k in links}
    expected = sorted(((rows[k][0], len(links[k]), low[k], rows[k][0] == low[k]) for k in links), key=key)
    wide = table.withColumns({c: F.lit(1) for c in ("node", "key", "n", "low", "id", "kind", "_label", "_links")})
    for source, near in ((wide, vectors.Near()), (table, vectors.Near(block=7))):
        assert sorted(map(tuple, vectors.near_groups(source, near).collect()), key=key) == expected
    assert vectors.near_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [1, 7, 40, 1000])
def test_whole_blocks(cut):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 25)
    rows = pd.DataFrame([(0, 2**62 + k, 0, 0, r) for k, n in enumerate(sizes) for r in range(n)], columns=["kind", "gid", "i", "j", "r"])
    found = list(common.whole_blocks((rows.iloc[k : k + cut] for k in range(0, len(rows), cut)), 20))
    assert pd.concat(found)["r"].tolist() == rows["r"].tolist()
    for part in found:
        assert all(len(g) == sizes[gid - 2**62] for gid, g in part.groupby("gid"))
        assert part["gid"].nunique() == part["_block"].nunique() and (len(part) <= 20 or part["gid"].nunique() == 1)


@pytest.mark.parametrize("cosine", [0.0, 0.7])
def test_large_sets_are_dealt_by_bucket_or_cut(spark, cosine):
    """Vectors that share a direction chain into one set; its blocks stay small and each
    link counts once."""
    rng = np.random.default_rng(1)
    n, dim, near = 1500, 32, vectors.Near(block=100)
    x = rng.normal(size=(n, dim)) / math.sqrt(dim)
    x = math.sqrt(1 - cosine) * x + math.sqrt(cosine) * np.eye(dim)[0]
    x[1::10] = x[::10] + rng.normal(size=(n // 10, dim)) * 0.15 / math.sqrt(dim)
    x[2:400:10] = x[3] + rng.normal(size=(40, dim)) * 0.2 / math.sqrt(dim)
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x.astype("f4"))]
    got = {r["vec_id"]: r for r in vectors.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), near).collect()}
    unit = vectors._unit(x.astype("f4").astype("f8"))
    near_by = unit @ unit.T >= 0.93
    assert [got[k]["n_links"] for k in range(n)] == (near_by.sum(axis=1) - 1).tolist()
    low = vectors._lowest(n, *np.nonzero(near_by))
    assert [got[k]["component_id"] for k in range(n)] == low.tolist()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = vectors.Near()
    codes, factor = vectors.codes_of(unit, near)
    assert codes.shape == (400, 16)
    estimate, spread = vectors.upper_bounds(unit, codes, factor, near)
    true = unit @ unit.T
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - true)[off].mean()) < 2e-3 and (estimate + spread >= true - 1e-6).mean() > 0.9999


def test_search(spark, table):
    rows = list({r[0]: r for r in vector_rows() if r[0] is not None}.values())
    usable = [(r[0], np.array(r[1], "f8")) for r in rows if good(r) and len(r[1]) == 16]
    for settings in (search.Search(), search.Search(cell_rows=40, cut_rows=20, leaf=8, sure=0.9999)):
        got = {}
        for r in search.nearest(table, settings).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = total = 0
        asked = [(i, x) for i, x in usable if i % 20 == 0]
        assert set(got) == {i for i, _ in asked}
        for i, x in asked:
            best = sorted(((-float(x @ y), j) for j, y in usable if j != i))[:20]
            found = sorted(got[i])
            assert [r for r, _, _ in found] == list(range(1, 21))
            assert all(abs(s - float(x @ dict(usable)[j])) < 1e-9 for _, j, s in found)
            hits += len({j for _, j in best} & {j for _, j, _ in found})
            total += 20
        assert hits / total >= 0.95
    assert search.nearest(table.limit(0)).count() == 0


def test_recall_on_a_larger_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")
    got = {}
    for r in search.nearest(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = ids[np.argsort(-score, axis=1, kind="stable")[:, :20]]
    hits = sum(len(set(b.tolist()) & got[int(ids[q])]) for q, b in zip(asked, best, strict=True))
    assert hits / best.size >= 0.95


def test_searches_in_slices(spark, table):
    """Queries of a cell that are dealt over several tasks find the same."""
    whole = sorted(map(tuple, search.nearest(table).collect()))
    assert sorted(map(tuple, search.nearest(table, search.Search(slice_rows=3)).collect())) == whole


def test_chi_square():
    rng = np.random.default_rng(0)
    draws = (rng.normal(size=(200_000, 8)) ** 2).sum(axis=1)
    for x in (2.0, 7.0, 15.0):
        assert abs(float(search.chi_square(np.array([x]), 8)[0]) - (draws <= x).mean()) < 5e-3


PAGES = [(k, f"https://e/{k}\r\nX: y", f"<p>{'text ' * (k % 9)}{k % 11}</p>" * (1 + k % 3)) for k in range(120)] + [
    (200, None, None), (201, "u", ""), (202, "u", "x" * 99), (203, "u", "x" * 99), (204, "u", "x" * 100), (205, "u", "x" * 100), (206, "u", "é\r\n\r\nWARC/1.1\r\n" * 50000),
    (None, "u", "x" * 100), (7, "again", "other"), (None, "u", "n" * 200), (None, "v", "n" * 200), (None, None, None),
    # ids that occur with two payloads, each of which others hold too
    (301, "u", "A" * 150), (302, "u", "B" * 150), (309, "u", "A" * 150), (309, "u", "B" * 150), (301, "u", "A" * 150), (309, "w", "A" * 150),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


class Blind:
    """No file system that executors could open themselves."""

    class fs:
        class FileSystem:
            @staticmethod
            def from_uri(uri):
                raise ValueError(uri)


def test_archive_round_trip(spark, pages, tmp_path, monkeypatch):
    layout = warc.Layout(frame_bytes=2000, bundle_bytes=3000)
    path = str(tmp_path / "a")
    warc.write_archive(pages, path, layout)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 100 and html in first and first[html] != i
        expected.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None, None if again else data))
    found = warc.read_archive(spark, path).collect()
    key = lambda r: tuple(map(str, r))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    # the index leads to every record, by byte range and by whole bundles
    index = warc.read_index(spark, path)
    assert index.count() == len(PAGES)
    wanted = index.where("page_id IN (3, 50, 206, 309) OR page_id IS NULL")
    asked = [e for e in expected if e[0] in ("3", "50", "206", "309", "None")]
    for ranged in (True, False):
        if not ranged:
            monkeypatch.setattr(warc, "pyarrow", Blind)
        got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.fetch(spark, path, wanted).collect()]
        assert sorted(got, key=key) == sorted(asked, key=key)


def whole_records(data, frames):
    """Records found by parsing all frames from their beginning."""
    import zstandard

    n = 0
    for start, packed, plain in frames[:-1]:
        text, at = zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain), 0
        while at < len(text):
            *_, at = warc.decode_record(text, at)
            n += 1
    return n


def test_bundles_are_seekable(spark, pages, tmp_path):
    import zstandard

    path = tmp_path / "b"
    warc.write_archive(pages, str(path), warc.Layout(frame_bytes=2000, bundle_bytes=3000))
    for file in path.glob("part-*"):
        data = file.read_bytes()
        if not data:
            continue
        frames = warc.frames_of(data)
        assert len(warc.entries_of(data, frames)) == whole_records(data, frames)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == sum(f[2] for f in frames) and whole.startswith(b"WARC/1.1\r\n")


def test_empty_archive(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), str(tmp_path / "c"))
    assert warc.read_archive(spark, str(tmp_path / "c")).count() == 0


def test_every_length_has_an_index(spark):
    """Lengths of comparable share: each query answers from the vectors of its own length."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=3 if k % 9 < 5 else 2).tolist()) for k in range(180)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for settings in (search.Search(k=5), search.Search(k=5, cell_rows=40, cut_rows=30, leaf=8, sure=0.9999)):
        got = {}
        for r in search.nearest(table, settings).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(got) == set(range(0, 180, 20))
        hits = 0
        for i, found in got.items():
            same = [(-float(np.dot(rows[i][1], x)), j) for j, x in rows if j != i and len(x) == len(rows[i][1])]
            hits += len(found & {j for _, j in sorted(same)[:5]})
        assert hits >= 0.95 * 45


def test_every_record_has_an_identifier(spark, pages, tmp_path):
    import re

    path = tmp_path / "d"
    warc.write_archive(pages.unionByName(pages), str(path))
    index = warc.read_index(spark, str(path)).collect()
    names = {r["record_id"] for r in index}
    assert len(index) == 2 * len(PAGES) == len(names)
    # each identifier leads to the record that states it, and revisits refer to a response
    kinds, refers = {}, set()
    for r in index:
        data = warc.zstandard.ZstdDecompressor().decompress((path / r["bundle"].rpartition("/")[2]).read_bytes()[r["start"] : r["start"] + r["packed"]], max_output_size=r["plain"])
        headers, *_ = warc.decode_record(data, r["offset"])
        assert headers["WARC-Record-ID"] == r["record_id"]
        kinds[r["record_id"]] = headers["WARC-Type"]
        refers |= {headers["WARC-Refers-To"]} if "WARC-Refers-To" in headers else set()
        assert ("WARC-Refers-To" in headers) == bool(re.match("revisit", headers["WARC-Type"]))
    assert refers and {kinds[x] for x in refers} == {"response"}
