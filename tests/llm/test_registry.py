"""The training-data queries that have SQL, against DuckDB, on the smallest tables and on
rows that have nulls, repeats and ties."""

import duckdb
import pytest

from quernstone.llm import registry

TABLES = "documents embeddings pages".split()


def plain(value):
    return f"{value:.8g}" if isinstance(value, float) else str(value)


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if not folder.startswith('/root') else ''}'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in names]
    expected = sorted(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())
    found = registry.queries()[name](spark, folder)
    assert sorted(found.columns) == names
    assert sorted(tuple(map(plain, r)) for r in found.select(*names).collect()) == expected
    return expected


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    assert compared(spark, sf_dir, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    e = lambda k: [1.0 if j == k else 0.1 for j in range(8)]
    vectors = [(None, e(0), 1), (1, e(0), 1), (2, e(0), None), (3, None, 1), (4, [0.0] * 8, 1), (5, e(0), 1), (6, e(1), 1), (7, e(0), 2), (8, [*e(0)[:7], 0.15], 1), (None, e(0), 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    page = "<p>" + "x" * 120 + "</p>"
    pages = [(None, "u", page), (None, "u", page), (4, None, page), (3, "u", page), (5, "u", None), (6, "u", ""), (None, None, "y" * 100), (7, "u", "short"), (7, "v", "short")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    docs = [(1, "a b c d e f", "s1"), (None, "a b c", None), (2, None, "s1"), (3, "", None), (4, "x\ty\nz", "s2"), (1, "a b c d e f", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op1_vectors", "op4_warc", "op7_mixing"])
def test_odd_rows(spark, odd, name):
    assert compared(spark, odd, name)
