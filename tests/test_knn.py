"""Exact nearest neighbours by pivots, against all pairs."""

import numpy as np
import pytest

from quernstone.operators import retrieval as R
from quernstone.operators import knn


def expected(rows, queries, k, dot, within, skip_self):
    out = []
    for q, a in queries:
        if a is None or not a or None in a:
            continue
        found = []
        for i, b in rows:
            if b is None or len(b) != len(a) or not b or None in b or (skip_self and i == q):
                continue
            a_, b_ = np.array(a, "f8"), np.array(b, "f8")
            value = round(float(a_ @ b_), 9) if dot else round(float(np.sqrt(((a_ - b_) ** 2).sum())), 9)
            if within is None or value <= within:
                found.append((-value if dot else value, i, value))
        out += [(q, i, v) for _, i, v in sorted(found)[:k]]
    return sorted(out)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(k, (centres[k % 12] + rng.normal(size=6) * 0.4).tolist()) for k in range(500)]
    rows += [(500 + k, rows[3][1]) for k in range(60)]  # one vector many times
    rows += [(600 + k, rng.normal(size=3).tolist()) for k in range(40)] + [(700, [0.0] * 6), (701, None), (702, []), (703, [1.0, None, 2.0])]
    return rows


@pytest.mark.parametrize("dot, within, skip_self", [(False, None, False), (True, None, True), (False, 1.0, True)])
@pytest.mark.parametrize("pivots", [knn.Pivots(), knn.Pivots(cell_rows=25, cut_rows=30, slice_rows=40, step_bytes=4000)])
def test_same_as_all_pairs(spark, table, dot, within, skip_self, pivots):
    schema = "{} long, embedding array<double>"
    rows, queries = spark.createDataFrame(table, schema.format("id")).repartition(3), spark.createDataFrame(table, schema.format("query_id")).repartition(3)
    made = knn.nearest(rows, queries, 4, "dot" if dot else "l2", within, skip_self, pivots).collect()
    got = sorted((r["query_id"], r["id"], r["dot" if dot else "l2"]) for r in made)
    want = expected(table, table, 4, dot, within, skip_self)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-9)


def test_far_cells_are_not_visited(spark, table, monkeypatch):
    """Well-separated clusters: queries are sent to few cells beside their own."""
    sent = []
    plain = knn.Scratch.save

    def counting(self, df, name):
        out = plain(self, df, name)
        if name == "visits":
            sent.append(out.count())
        return out

    monkeypatch.setattr(knn.Scratch, "save", counting)
    some = [r for r in table if r[1] and len(r[1]) == 6 and None not in r[1] and any(r[1])]
    schema = "{} long, embedding array<double>"
    knn.nearest(spark.createDataFrame(some, schema.format("id")), spark.createDataFrame(some, schema.format("query_id")), 3, pivots=knn.Pivots(cell_rows=12)).collect()
    assert sent[0] < 0.2 * len(some) * (len(some) // 12)


def test_empty_sides(spark, table):
    schema = "{} long, embedding array<double>"
    none, some = spark.createDataFrame([], schema.format("id")), spark.createDataFrame(table, schema.format("query_id"))
    assert knn.nearest(none, some, 3).collect() == []
    assert knn.nearest(some.withColumnRenamed("query_id", "id"), none.withColumnRenamed("id", "query_id"), 3).collect() == []
    strings = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "id string, embedding array<float>")
    got = knn.nearest(strings, strings.withColumnRenamed("id", "query_id"), 1).collect()
    assert sorted(tuple(r) for r in got) == [("a", "a", 0.0), ("b", "a", 0.0)]


@pytest.mark.parametrize("measure", ["l2", "dot"])
def test_few_queries_take_close_rows_alone(spark, measure):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, None]), ("c", None), ("d", []), ("e", [1.0, 0.0]), ("f", [3.0, 0.0, 0.0]), ("g", [0.5, 0.0]), ("h", [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    found = R.vector_topk(vectors, queries, 3, measure)
    assert "MapInPandas" in found._jdf.queryExecution().toString()
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect())
    assert got == [(1, 1, "a"), (1, 2, "e"), (1, 3, "g"), (2, 1, "f")]
