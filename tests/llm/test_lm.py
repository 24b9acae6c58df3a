import zlib

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import lm


def test_words_of_one_ending_have_vectors_of_their_own(spark):
    """Neither contexts nor targets of these pairs differ by ending: only vectors of their own tell which belong together."""
    n = 8

    def text(i, j):
        return f"x{i}aa y{j}bb " * 20

    train = [(k, text(k % n, k % n)) for k in range(400)]
    asked = [(1000 + i, text(i, i)) for i in range(n)] + [(2000 + i, text(i, (i + 1) % n)) for i in range(n)]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string")
    got = lm.score_documents(docs, F.col("doc_id") >= 1000, lm.Shape(own=1, endings=2)).where("held_out").collect()

    def mean(kind, column):
        rows = [r for r in got if r["doc_id"] // 1000 == kind]
        return sum(r[column] / r["n_tokens"] for r in rows) / len(rows)

    assert mean(1, "score") > mean(2, "score") + 0.1
    assert mean(1, "score") > mean(1, "base_score") + 0.1


def test_second_level_grows_and_is_normalised(spark):
    for n in (400, 6400):
        docs = spark.createDataFrame([(k, f"w{k} w{k}") for k in range(n)], "doc_id long, text string")
        _, fitted = lm.train(lm.Scratch(spark, "lm"), docs, lm.Shape(own=4, endings=3, start_epochs=1))
        inner, m = fitted.model.inner, 4 + 3
        assert len(inner.coarse) - m == int(np.ceil(4 * (n + 1) ** 0.5))
        for k in range(3):
            members = np.flatnonzero((inner.coarse == 4 + k) & (inner.slot >= 0))
            assert len(members) == inner.bounds[k + 1] - inner.bounds[k]
            total = (10 ** fitted.model.within(np.full(len(members), m + 1), members)).sum()
            assert np.isclose(total, 1, rtol=1e-4)


def test_encoded_tokens_are_the_words():
    texts = ["", None, " ", "a", "A\x0bB\x0cC\rD\nE\tF g", "\x1ca\x1db\x85c\xa0d\u2003e", "ÀÉ ß İ \x00 x\x00y", "  lead", "trail  ", "\n", "a" * 50] * 2
    classes = lm.Classes({lm.END: 0, b"a": 1}, 2, 7)
    for most in (1, 8, 1 << 20):
        got = []
        for t in lm.encoded(texts, most):
            assert len(set(t.words)) == len(t.words) and t.stops[-1] == len(t.ids)
            assert classes.of(t).tolist() == [{lm.END: 0, b"a": 1}.get(w, 2 + zlib.crc32(w[-2:]) % 7) for w in t.words]
            got += [[t.words[k] for k in ids] for ids in np.split(t.ids, t.stops[:-1])]
        assert got == [lm.words_of(x) for x in texts]
    assert list(lm.encoded([])) == []


class Asked(lm.Classes):
    """Counts how often it is asked for a word."""

    asked = 0

    def __getitem__(self, word):
        self.asked += 1
        return super().__getitem__(word)

    def get(self, word, *other):
        self.asked += 1
        return super().get(word, *other)


def test_training_looks_up_distinct_words_alone():
    """Looking up every token was about a quarter of the training's CPU time."""
    shape = lm.Shape(own=2, endings=2, dim=4, noise=4)
    model = lm.Model(np.full(4, 0.25), shape, lm.Inner(4, 2, np.zeros(0, np.int32)), np.ones(2))
    classes = Asked({lm.END: 0, b"w0": 1}, 2, 2)
    texts = [" ".join(f"w{(i + k) % 30}" for k in range(500)) for i in range(200)]
    lm._batches(model, classes, 0, texts, np.random.default_rng(0))
    assert model.trained == 200 * 501
    assert classes.asked <= 31


def test_step_sums_the_gradients_of_a_row():
    rng = np.random.default_rng(0)
    for width in ((), (1,), (7,), (32,)):
        at = rng.integers(0, 9, 300)
        grad, into, seen = rng.normal(size=(300, *width)).astype("f4"), rng.normal(size=(12, *width)).astype("f4"), np.full(12, 0.5, "f4")
        total = np.zeros((12, *width))
        np.add.at(total, at, grad)
        squares = (total**2).reshape(12, -1).mean(axis=1)
        expected = into + 0.1 * total / np.sqrt(0.5 + squares + 1e-8).reshape(12, *[1] * len(width))
        lm._gather(into, seen, at, grad, 0.1)
        assert np.allclose(into, expected, rtol=1e-4, atol=1e-5) and np.allclose(seen, 0.5 + squares, rtol=1e-4)
