"""Slots for models: what embeds texts, scores pairs and cuts texts into chunks.

A model is handed over as a function that loads it. Spark workers call it once each and
keep the model; texts reach it in small batches. Offline, a hashing embedder and a lexical
scorer fill the slots: deterministic stand-ins that make every path run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that a model gets at once, and tokens that it reads of each.
BATCH = 16
TOKENS = 512

_BREAKS = regex.compile(r"[^\p{L}\p{N}]+")


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """A row for each text. Raises where the model can't answer."""


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> Sequence[float]:
        """A number for each (query, text). Raises where the model can't answer."""


class Unavailable(Exception):
    """The model isn't there."""


def terms_of(text: str) -> list[str]:
    return [t for t in _BREAKS.split(text.lower()) if t]


def slot_of(term: str, dim: int) -> tuple[int, int]:
    """The bucket and sign of a term."""
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:8], 16) % dim, -1 if digest[8] >= "8" else 1


class HashingEmbedder:
    """Terms hashed into signed buckets, summed over the first ``TOKENS`` terms of a text
    and brought to length one; a text without terms is the zero vector."""

    def __init__(self, dim: int = 64, most_terms: int = TOKENS):
        self.dim, self.most_terms = dim, most_terms
        self._slots: dict[str, tuple[int, int]] = {}

    def _slot(self, term: str) -> tuple[int, int]:
        if term not in self._slots:
            if len(self._slots) >= 200_000:
                self._slots.clear()
            self._slots[term] = slot_of(term, self.dim)
        return self._slots[term]

    def tokens(self, text: str) -> np.ndarray:
        """The vectors of a text's terms, one a row: what pooling starts from."""
        slots = [self._slot(t) for t in terms_of(text)[: self.most_terms]]
        out = np.zeros((len(slots), self.dim))
        if slots:
            at, sign = zip(*slots, strict=True)
            out[np.arange(len(slots)), list(at)] = sign
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.array([self.tokens(t).sum(axis=0) for t in texts]).reshape(len(texts), self.dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


class LexicalReranker:
    """Share of the query's distinct terms that a text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            asked = set(terms_of(query))
            out.append(len(asked & set(terms_of(text))) / max(len(asked), 1))
        return out


_LOADED: dict = {}


def loaded(load: Callable):
    """The model of ``load``, loaded once by each Python process that asks; None if that
    fails, which is not tried again."""
    key = (load.__module__, load.__qualname__)
    if key not in _LOADED:
        try:
            _LOADED[key] = load()
        except Exception:  # whatever a model raises: its absence has a defined result
            _LOADED[key] = None
    return _LOADED[key]


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the rows whose mask is set; zero where none is."""
    kept = vectors[mask > 0]
    return kept.mean(axis=0) if len(kept) else np.zeros(vectors.shape[1])


def _encoded(model: Embedder | None, texts: list[str | None], dim: int, batch: int) -> list:
    """Vectors of texts; None for null texts, without a model, where the model fails and
    where its vectors have another length."""
    out: list = [None] * len(texts)
    some = [k for k, t in enumerate(texts) if t is not None] if model is not None else []
    for at in range(0, len(some), batch):
        part = some[at : at + batch]
        try:
            made = np.asarray(model.encode([texts[k] for k in part]), dtype="f8")
        except Exception:  # noqa: S112  the batch has no vectors; keyword search still finds its texts
            continue
        if made.shape == (len(part), dim):
            for k, row in zip(part, made, strict=True):
                out[k] = row
    return out


def embedded(rows: DataFrame, text: str, load: Callable[[], Embedder], dim: int, out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``rows`` with the vectors of a text column, null where there is none."""

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load)
        for part in parts:
            yield pd.Series(_encoded(model, [None if pd.isna(t) else t for t in part], dim, batch), index=part.index, dtype=object)

    # a filter on the vectors stays above them; below, it would compute them a second time
    return rows.withColumn(out, vectors.asNondeterministic()(F.col(text)))


def scored_pairs(found: DataFrame, load: Callable[[], Reranker], query: str, text: str, by: str, id_col: str, out: str) -> DataFrame:
    """``found`` with a model score for each candidate of a query. A query whose pairs the
    model can't score, or doesn't score one by one, has no scores at all. Candidates of a
    query are few (they are a ranked list), so they go to the model together."""
    lists = found.groupBy(by).agg(F.first(query).alias("_query"), F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(text).alias("text"))).alias("_rows"))

    @F.pandas_udf("array<double>")
    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(load)
        for asked, texts in parts:
            made: list = []
            for question, some in zip(asked, texts, strict=True):
                try:
                    got = None if model is None else [float(x) for x in model.score([(question or "", t or "") for t in some])]
                except Exception:  # the query keeps its order
                    got = None
                made.append(got if got is not None and len(got) == len(some) and all(map(np.isfinite, got)) else None)
            yield pd.Series(made, dtype=object)

    texts = F.transform("_rows", lambda r: r["text"])
    ids = F.transform("_rows", lambda r: r["id"])
    scored = lists.select(by, ids.alias("_ids"), scores("_query", texts).alias("_scores"))
    flat = scored.select(by, F.posexplode("_ids").alias("_at", id_col), "_scores")
    return found.join(flat.select(by, id_col, F.get("_scores", F.col("_at")).alias(out)), [by, id_col])


#: Chunkers by name: each takes the text column and gives an array of chunks.
CHUNKERS: dict[str, Callable[[Column], Column]] = {}


def chunker(name: str):
    """Registers a chunker under a name."""

    def add(make: Callable[[Column], Column]):
        CHUNKERS[name] = make
        return make

    return add


def chunks_by(kind: Column, text: Column, otherwise: str) -> Column:
    """The chunks of a text by the chunker that ``kind`` names, or else by ``otherwise``."""
    if otherwise not in CHUNKERS:
        raise KeyError(f"no chunker {otherwise!r}; there are {', '.join(sorted(CHUNKERS))}")
    out = CHUNKERS[otherwise](text)
    for name, make in CHUNKERS.items():
        if name != otherwise:
            out = F.when(kind == name, make(text)).otherwise(out)
    return out
