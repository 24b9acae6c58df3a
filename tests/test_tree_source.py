"""Trees of files as a data source."""

import os

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from quernstone.sources import readers, tree_source


@pytest.fixture
def tree(tmp_path):
    for k in range(30):
        folder = tmp_path / f"a{k % 5}" / f"b{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.py").write_text(f"x = {k}\n" + "#" * k)
    for name in ("node_modules/deep/x.js", "a0/target/y.rs", "a1/.z.md", "a1/tokenizer.json", "a2/x.bin"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("no")
    (tmp_path / "top.md").write_text("# top")
    os.symlink(tmp_path / "a0", tmp_path / "link")
    return tmp_path


def test_same_as_read_tree(spark, tree):
    tree_source.register(spark)
    os.unlink(tree / "link")  # Spark's own readers follow it
    whole = {(r["source"].removeprefix("file:"), r["length"], r["text"]) for r in readers.read_tree(spark, str(tree)).collect()}
    for parts in (1, 4, 200):
        made = spark.read.format("source_tree").option("path", str(tree)).option("parts", parts).load()
        rows = [(r["source"], r["length"], r["text"]) for r in made.collect()]
        assert len(rows) == len(set(rows)) == 31 and set(rows) == whole


def test_skipped_folders_are_not_listed(tree, monkeypatch):
    seen = []
    plain = tree_source.listed

    def noting(files, folder):
        seen.append(os.path.relpath(folder, tree))
        return plain(files, folder)

    monkeypatch.setattr(tree_source, "listed", noting)
    files = pyarrow.fs.LocalFileSystem()
    found = list(tree_source.walked(files, [str(tree)]))
    assert len(found) == 31 and len(seen) == 21 and not [s for s in seen if "node_modules" in s or "target" in s or "link" in s]
    seen.clear()
    shares = tree_source.dealt(files, str(tree), 5)
    assert seen == ["."] and sum(len(s.folders) for s in shares) == 5 and sum(len(s.files) for s in shares) == 1


def test_pushed_filters(spark, tree):
    tree_source.register(spark)
    made = spark.read.format("source_tree").option("path", str(tree)).load()
    small = made.where((F.col("length") < 10) & F.col("source").startswith(f"{tree}/a1/"))
    assert {os.path.basename(r["source"]) for r in small.collect()} == {"f1.py"}
    one = made.where(F.col("source") == f"{tree}/a2/b2/f2.py").collect()
    assert [r["text"] for r in one] == ["x = 2\n##"]


def test_stream_takes_what_has_changed(spark, tree, tmp_path_factory):
    tree_source.register(spark)
    out = tmp_path_factory.mktemp("out")

    def run():
        stream = spark.readStream.format("source_tree").option("path", str(tree)).load()
        stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.parquet(str(out / "rows"))

    assert run().count() == 31
    (tree / "a0" / "b0" / "new.rs").write_text("fn f() {}")
    rows = run()
    assert rows.count() == 32 and rows.where("source LIKE '%new.rs'").count() == 1
