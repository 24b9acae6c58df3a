"""Readers, sinks and streaming jobs on files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.sources import index, readers, sinks
from quernstone.streaming import incremental


def test_tree(spark, tmp_path):
    for name, text in {"a/x.py": "x = 1", "node_modules/y.js": "no", "a/tokenizer.json": "{}", "b/z.md": "# z", "b/skip.bin": "no", "b/.h.md": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = readers.read_tree(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in rows) == ["# z", "x = 1"]


def test_jsonl(spark, tmp_path):
    lines = [{"path": "a", "text": "one"}, {"source": "b", "content": "two"}, {"path": "c", "chunks": ["x", " ", "y"]}, {"path": "d", "text": " "}]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    rows = readers.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert sorted((r["source"], r["chunk_idx"], r["text"]) for r in rows.collect()) == [("a", 0, "one"), ("b", 0, "two"), ("c", 0, "x"), ("c", 2, "y")]


def test_cargo_and_package(spark):
    cargo = '[dependencies]\na = "1"\nb = { version = "2" }\nc = { path = "x" }\n[dev-dependencies]\na = "9"\n[target.x.dependencies]\nd = "3"\n'
    package = json.dumps({"name": "n", "scripts": {"t": "x", "b": "y"}, "dependencies": {f"d{k:02}": "1" for k in range(25)}})
    row = spark.createDataFrame([(cargo, package)], "c string, p string").select(readers.cargo_dependencies("c").alias("deps"), readers.package_summary(F.col("p")).alias("s")).first()
    assert row["deps"] == {"a": "1", "b": "2", "d": "3"}
    assert row["s"]["scripts"] == ["b", "t"] and row["s"]["total"] == 25 and len(row["s"]["dependencies"]) == 20


def test_skills(spark, tmp_path):
    (tmp_path / "one.md").write_text("---\nname: First: x\ndescription: Does things\ntags: [\"a\", \"b\"]\n---\nbody")
    (tmp_path / "two.md").write_text("# Second\nA line\n")
    rows = {r["id"]: r for r in readers.read_skills(spark, str(tmp_path)).collect()}
    assert rows["one"]["name"] == "First" and rows["one"]["tags"] == ["a", "b"] and rows["one"]["domain"] is None
    assert rows["two"]["name"] == "Second" and rows["two"]["description"] == "A line"


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h1")], "source string, content_hash string")
    sinks.save_manifest(rows, str(tmp_path / "m"), "c1")
    assert sinks.load_manifest(spark, str(tmp_path / "m"), "c1").count() == 1
    assert sinks.load_manifest(spark, str(tmp_path / "m"), "c2").count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, n int")
    sinks.replace_sources(old, spark.createDataFrame([("a", 9)], "source string, n int"), str(tmp_path / "t"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [3, 9]
    for _ in range(2):
        sinks.append_log(old, str(tmp_path / "log"), 2)
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_incremental_ingest(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    schema = "source string, text string, ts long"

    def put(name, rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        incremental.ingest_stream(spark, str(folder), schema, target, str(tmp_path / "cp")).awaitTermination(60)

    put("1.json", [{"source": "a", "text": "old", "ts": 1}, {"source": "b", "text": "b", "ts": 1}])
    put("2.json", [{"source": "a", "text": "new", "ts": 2}, {"source": "a", "text": "mid", "ts": 1}])
    assert {r["source"]: r["text"] for r in incremental.latest(spark, target).collect()} == {"a": "new", "b": "b"}


def test_guard_stream(spark, tmp_path):
    folder = tmp_path / "calls"
    rows = [{"user_id": 1, "ts": f"2024-01-01T00:00:{k:02}", "event_type": t} for k, t in enumerate("aaabaaa")]
    folder.mkdir()
    (folder / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").json(str(folder))
    query = incremental.guard_stream(stream, 3).writeStream.format("memory").queryName("guarded").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = spark.sql("SELECT * FROM guarded ORDER BY ts").collect()
    assert [r["at"] for r in found] == [1, 2, 3, 1, 1, 2, 3] and [r["blocked"] for r in found] == [False, False, True, False, False, False, True]


def test_windowed_counts(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    (folder / "x.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T0{h}:00:00", "event_type": "v", "value": 1.0}) for h in (0, 0, 3)))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(folder))
    query = incremental.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert [r["n"] for r in spark.sql("SELECT * FROM counted").collect()] == [2]


def test_index_tables_change_together(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = lambda *x: spark.createDataFrame(list(x), "source string, n int")
    assert index.read_index(spark, root, "chunks") is None
    index.write_index(spark, root, {"chunks": rows(("a", 1), ("b", 2)), "refs": rows(("b", 3))})
    # a table that can't be written leaves the whole version out of force
    broken = rows(("a", 9)).withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        index.write_index(spark, root, {"chunks": rows(("a", 9)), "refs": broken})
    assert sorted(map(tuple, index.read_index(spark, root, "chunks").collect())) == [("a", 1), ("b", 2)]
    index.write_index(spark, root, {"chunks": rows(("a", 9)), "refs": rows(("a", 8))}, gone=spark.createDataFrame([("b",)], "source string"))
    assert [tuple(index.read_index(spark, root, n).first()) for n in ("chunks", "refs")] == [("a", 9), ("a", 8)]
    assert index.read_index(spark, root, "refs").count() == 1 and index.current_version(spark, root) == 2


def test_tables_not_named_stay(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = lambda *x: spark.createDataFrame(list(x), "source string, n int")
    read = lambda name, version=None: sorted(map(tuple, index.read_index(spark, root, name, version).collect()), key=str)
    index.write_index(spark, root, {"chunks": rows(("a", 1), ("b", 2), ("c", 3)), "refs": rows(("a", 4), ("b", 5), ("b", 6)), "bare": rows(("z", 0))})
    index.write_index(spark, root, {"chunks": rows(("a", 7), ("a", 8), (None, 9))})
    assert read("refs") == [("b", 5), ("b", 6)] and read("bare") == [("z", 0)]
    assert read("chunks") == sorted([("a", 7), ("a", 8), ("b", 2), ("c", 3), (None, 9)], key=str)
    index.write_index(spark, root, {}, gone=rows(("b", 0), ("none", 0)).select("source"))
    assert read("refs") == [] and read("refs", 1) == [("a", 4), ("b", 5), ("b", 6)]
    # a source that went comes back, and a table that is new has a column more
    index.write_index(spark, root, {"refs": rows(("b", 1)).withColumn("more", F.lit("x")), "late": rows(("a", 1))})
    assert read("refs") == [("b", 1, "x")] and read("late") == [("a", 1)]
    whole = {name: read(name) for name in ("chunks", "refs", "bare", "late")}
    assert index.compact(spark, root) == 5
    assert whole == {name: read(name) for name in whole}
    assert index.sweep(spark, root) > 0 and index.versions(spark, root) == [5] and index.sweep(spark, root) == 0
    assert read("refs") == [("b", 1, "x")]


def test_one_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = lambda n: spark.createDataFrame([("a", n)], "source string, n int")
    index.write_index(spark, root, {"t": rows(1)})
    index.write_index(spark, root, {"t": rows(2)}, base=1)
    with pytest.raises(index.Conflict):
        index.write_index(spark, root, {"t": rows(3)}, base=1)
    assert [r["n"] for r in index.read_index(spark, root, "t").collect()] == [2]
    assert [r["n"] for r in index.read_index(spark, root, "t", 1).collect()] == [1]


def test_a_small_change_writes_little(spark, tmp_path):
    root = tmp_path / "index"
    size = lambda: sum(f.stat().st_size for f in root.rglob("*.parquet"))
    text = F.sha2(F.col("id").cast("string").cast("binary"), 512)
    index.write_index(spark, str(root), {"t": spark.range(20_000).select(F.col("id").cast("string").alias("source"), text.alias("text"))})
    before = size()
    index.write_index(spark, str(root), {"t": spark.range(200).select(F.col("id").cast("string").alias("source"), text.alias("text"))})
    assert size() - before < 0.04 * before
    assert index.read_index(spark, str(root), "t").count() == 20_000


def test_log_files_are_bounded(spark, tmp_path):
    rows = spark.range(2000).select("id", F.lit("x" * 100).alias("text"))
    sinks.append_log(rows, str(tmp_path / "log"), most_bytes=64 * 1024)
    sizes = [f.stat().st_size for f in (tmp_path / "log").glob("part-*")]
    assert len(sizes) == 4 and max(sizes) < 70 * 1024 and spark.read.json(str(tmp_path / "log")).count() == 2000


def test_design_csv_is_cut_at_every_comma(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b,c\n"x,y",1\nalone\n1,2,3,4\n,e,\n')
    rows = readers.read_design_csv(spark, str(tmp_path), ["a", "b", "c"]).collect()
    assert sorted((r["a"] or "", r["b"], r["c"] or "") for r in rows) == sorted([('"x', 'y"', "1"), ("1", "2", "3"), ("", "e", "")])


def test_skills_lie_at_most_one_folder_down(spark, tmp_path):
    for place in ("a.md", "d/b.mdc", "d/e/c.md", "x.txt"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text("# T\nline\n")
    assert sorted(r["id"] for r in readers.read_skills(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_changed_sources(spark):
    from quernstone.functions import text as T

    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "source string, text string")
    manifest = rows.where("source <> 'c'").withColumn("text", F.when(F.col("source") == "b", "old").otherwise(F.col("text"))).select("source", T.content_hash("text").alias("content_hash"))
    fresh, gone = incremental.changed_sources(rows, manifest.unionByName(spark.createDataFrame([("z", "h")], "source string, content_hash string")))
    assert sorted(r["source"] for r in fresh.collect()) == ["b", "c"] and [r["source"] for r in gone.collect()] == ["z"]
