"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows, every path from a
root becomes a rule, a lasso-penalised logistic fit keeps few of them, and the kept
rules are compiled into one Spark column expression.

Statistics are computed for the sample and, in one pass with the score, for every
document. The pass counts its rows before the score and before any filter
(``DataFrame.observe``): the count has to see every row, so the plan can neither compute
a statistic once a rule nor move the filter below.

Defined cases: a null text counts as empty and gets a score like any other; labels that
are null or for unknown documents are ignored; without usable labels every score is 0.5,
with one class alone the smoothed share of that class; repeated rows are scored each, and
a document with several labels counts once for each in training; a null id has no label
and isn't held out; an empty table gives an empty result; ``keep_good`` carries further
columns along.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import WORD, crc_of_id, free_name, free_names, hash_share, share_below


@dataclass(frozen=True)
class Fit:
    #: at most so many labelled rows, those with the smallest id hashes, reach the driver
    sample: int = 20_000
    trees: int = 24
    depth: int = 3
    bins: int = 32
    shrink: float = 0.4
    least_leaf: int = 3
    penalty: float = 5e-4
    steps: int = 800


@dataclass(frozen=True)
class Rule:
    #: (statistic, whether it lies above, bound)
    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class Ensemble:
    intercept: float = 0.0
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def score(self, names: dict[str, str] | None = None) -> Column:
        """The ensemble as a column over the columns of ``statistics``, or over those that
        ``names`` gives for them."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            fires = F.lit(True)
            for name, above, bound in rule.terms:
                at = F.col(names[name] if names else name)
                fires = fires & (at > F.lit(bound) if above else at <= F.lit(bound))
            total = total + F.when(fires, F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all by built-in functions."""
    text = F.coalesce(text, F.lit(""))

    def left(dropped: str) -> Column:
        return F.length(F.regexp_replace(text, dropped, "")).cast("double")

    chars, words = F.length(text).cast("double"), F.regexp_count(text, F.lit(WORD)).cast("double")
    per_char = lambda n: n / F.greatest(chars, F.lit(1.0))
    per_word = lambda n: n / F.greatest(words, F.lit(1.0))
    return {
        "q_chars": chars,
        "q_words": words,
        "q_word_chars": per_word(chars),
        "q_upper": per_char(left(r"[^\p{Lu}]+")),
        "q_digits": per_char(left(r"[^0-9]+")),
        "q_symbols": per_word(left(r"[\p{L}\p{N}\s.,;:!?'\"()\-|]+")),
        "q_bars": per_word(left(r"[^|]+")),
        "q_marks": per_word(left(r"[^!?]+")),
        "q_stops": per_word(left(r"[^.,;:]+")),
        "q_lines": per_word(left(r"[^\n]+")),
        "q_repeats": per_word(F.regexp_count(text, F.lit(r"(?<!\S)(\S+)(?=\s\1(?!\S))")).cast("double")),
    }


NAMES = ("q_chars", "q_words", "q_word_chars", "q_upper", "q_digits", "q_symbols", "q_bars", "q_marks", "q_stops", "q_lines", "q_repeats")


def _tree(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hess: np.ndarray, fit: Fit):
    """Node paths (terms, rows) of one regression tree and its prediction."""
    out = np.zeros(len(x))
    paths = []

    def grow(rows: np.ndarray, terms: tuple, depth: int) -> None:
        if terms:
            paths.append((terms, rows))
        g, h = residual[rows].sum(), hess[rows].sum()
        out[rows] = g / (h + 1.0)
        if depth == fit.depth or len(rows) < 2 * fit.least_leaf:
            return
        best = (1e-6, None, None)
        for j, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            b = binned[rows, j]
            gs = np.bincount(b, residual[rows], len(bounds) + 1).cumsum()[:-1]
            hs = np.bincount(b, hess[rows], len(bounds) + 1).cumsum()[:-1]
            ns = np.bincount(b, minlength=len(bounds) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < fit.least_leaf) | (len(rows) - ns < fit.least_leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        _, j, k = best
        if j is None:
            return
        low = binned[rows, j] <= k
        bound = float(cuts[j][k])
        grow(rows[low], (*terms, (NAMES[j], False, bound)), depth + 1)
        grow(rows[~low], (*terms, (NAMES[j], True, bound)), depth + 1)

    grow(np.arange(len(x)), (), 0)
    return paths, out


def _lasso(m: np.ndarray, y: np.ndarray, fit: Fit) -> tuple[float, np.ndarray]:
    """Logistic loss with an L1 penalty, by accelerated proximal steps."""
    n, p = m.shape
    design = np.hstack([m, np.ones((n, 1))])
    step = 4.0 * n / (np.linalg.norm(design, 2) ** 2 + 1e-9)
    w, v, t = np.zeros(p + 1), np.zeros(p + 1), 1.0
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = v[-1] = np.log(share / (1 - share))
    for _ in range(fit.steps):
        grad = design.T @ (1 / (1 + np.exp(-(design @ v))) - y) / n
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * fit.penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / later * (new - w)
        w, t = new, later
    return float(w[-1]), w[:-1]


def fit_rules(x: np.ndarray, y: np.ndarray, fit: Fit = Fit()) -> Ensemble:
    """Rules from rows of statistics (columns as ``NAMES``) and labels 0/1."""
    if not len(y):
        return Ensemble()
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return Ensemble(float(np.log(share / (1 - share))))
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > fit.bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, fit.bins + 1)))
        cuts.append((values[:-1] + values[1:]) / 2)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log(share / (1 - share)))
    found: dict[bytes, tuple] = {}
    for _ in range(fit.trees):
        p = 1 / (1 + np.exp(-margin))
        paths, out = _tree(x, binned, cuts, y - p, p * (1 - p), fit)
        margin += fit.shrink * out
        for terms, rows in paths:
            mask = np.zeros(len(y), bool)
            mask[rows] = True
            found.setdefault(np.packbits(mask).tobytes(), (terms, mask))
    if not found:
        return Ensemble(float(np.log(share / (1 - share))))
    terms, masks = zip(*found.values(), strict=True)
    intercept, weights = _lasso(np.stack(masks, axis=1).astype(float), y, fit)
    return Ensemble(intercept, tuple(Rule(t, float(w)) for t, w in zip(terms, weights, strict=True) if w))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Ensemble:
    """Fits on at most ``fit.sample`` labelled rows of ``docs`` (doc_id, text) that aren't
    held out. Statistics are computed for these alone."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).where("_y IS NOT NULL")
    known = known.where(crc_of_id("_id") % 5 != 0)
    pairs = docs.select("doc_id").join(known, F.col("doc_id") == F.col("_id"))
    share = share_below(pairs.count(), fit.sample)
    if share is not None:
        known = known.where(hash_share("_id") < share)
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"))
    rows = rows.select("_y", *[c.alias(n) for n, c in statistics(F.col("text")).items()]).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(len(rows), len(NAMES) + 1)
    return fit_rules(data[:, 1:], data[:, 0], fit)


def scored(docs: DataFrame, ensemble: Ensemble, score: str) -> DataFrame:
    """``docs`` with a column ``score``; each statistic that a rule uses is computed once
    a row."""
    used = {t[0] for r in ensemble.rules for t in r.terms}
    names = dict(zip(NAMES, free_names(docs.columns, *NAMES), strict=True))
    wide = docs.select("*", *[c.alias(names[n]) for n, c in statistics(F.col("text")).items() if n in used])
    tag = uuid.uuid4().hex
    wide = wide.observe(f"documents-{tag}", F.count(F.lit(1)).alias("rows"))
    wide = wide.select(*docs.columns, ensemble.score(names).alias(score))
    return wide.observe(f"scores-{tag}", F.count(F.lit(1)).alias("rows"))


def score_documents(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    out = scored(docs, train(docs, labels, fit), "score")
    return out.select("doc_id", F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    score = free_name(docs.columns, "_score")
    return scored(docs, train(docs.select("doc_id", "text"), labels, fit), score).where(F.col(score) >= 0.3).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
