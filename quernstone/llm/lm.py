"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Words are counted over all training documents. The most frequent words are classes of
their own, all others share a class by their ending; a word's probability is that of its
class in context times its smoothed share of the class. The class model is log-bilinear
in the two preceding classes: score = (R1[u] + R2[v]) . Q[w] + b[w]. A short run on a
bounded sample gives the common starting point; then every partition of the training
documents trains on all its tokens and the weights are averaged by tokens. As the score
splits into a part of (u, w) and one of (v, w), one matrix product gives the exact
normaliser of every context, so scoring is table look-up.

Below the shared classes stands a second level, whose words grow with the root of the
vocabulary: each has a vector as context and one as target, and its probability within
the class is an exact softmax over the class's words of this level and the rest of it.

Defined cases: a null text is empty and has the end token alone; an empty training set
leaves all counts 0; repeated rows are scored each, and counted each; a null id isn't held
out; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import product, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, crc_of_id, hash_share, share_below, single_threaded

#: White space never occurs in a word, so this can't be one.
END = b"\n"


@dataclass(frozen=True)
class Shape:
    own: int = 1024
    endings: int = 512
    #: words of the second level, as a multiple of the vocabulary's square root
    per_root: float = 4.0
    dim: int = 32
    noise: int = 32
    batch: int = 2048
    rate: float = 0.1
    #: words whose counts are sent to every executor; the rest are joined
    sent: int = 150_000
    #: documents of the starting run, and bytes of their texts together
    start_docs: int = 1500
    start_bytes: int = 16 << 20
    start_epochs: int = 3
    seed: int = 11


def words_of(text: str | None) -> list[bytes]:
    """The tokens of a text: words with A-Z lowered, then the end token."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


#: a byte that no UTF-8 text has; it stands for the end token while words are told apart
_CLOSE = b"\xff"


class Tokens(NamedTuple):
    """Tokens of several texts, those of ``words_of``: distinct words, what each ends with
    (an index into ``_ending_classes``), the word of each token, where each text stops."""

    words: list[bytes]
    tails: np.ndarray
    ids: np.ndarray
    stops: np.ndarray


def encoded(texts, most: int = 2 << 20):
    """``Tokens`` of whole texts of about ``most`` bytes together. Arrow tells words apart,
    so only the distinct ones become Python objects and are looked up."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= most:
            yield _encoded(held)
            held, size = [], 0
    if held:
        yield _encoded(held)


def _encoded(texts: list[bytes]) -> Tokens:
    data = np.frombuffer((b" " + _CLOSE + b" ").join([b"", *texts, b""]).lower(), np.uint8)
    # the first and the last byte are blanks
    inside = (data - np.uint8(9) > 4) & (data != 32)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    _, offsets, data = found.dictionary.buffers()
    cuts, data = np.frombuffer(offsets, np.int32)[: len(found.dictionary) + 1], data.to_pybytes()
    at = cuts.tolist()
    words = [data[i:j] for i, j in zip(at, at[1:])]
    last = np.frombuffer(data, np.uint8)[cuts[1:] - 1].astype(np.int64)
    before = np.frombuffer(data, np.uint8)[np.maximum(cuts[1:] - 2, 0)].astype(np.int64)
    ids, end = found.indices.to_numpy(), 0
    # what stands for the first end token is the first word, as nothing precedes the first text
    words[end] = END
    return Tokens(words, np.where(np.diff(cuts) > 1, before * 256 + last, 65536 + last), ids[1:], np.flatnonzero(ids[1:] == end) + 1)


@lru_cache(maxsize=4)
def _ending_classes(n: int) -> np.ndarray:
    """Class among ``n`` by the last two bytes, and behind these by a single one."""
    tails = [*(bytes(x) for x in product(range(256), repeat=2)), *(bytes([x]) for x in range(256))]
    return np.array([zlib.crc32(x) % n for x in tails], np.int64)


def count_words(docs: DataFrame, most: int = 600_000) -> DataFrame:
    """(word, n) over all texts; each task sums what it reads before anything moves."""

    def rows(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in encoded(batch["text"]):
                held.update(dict(zip(t.words, np.bincount(t.ids, minlength=len(t.words)).tolist(), strict=True)))
                if len(held) > most:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes(dict):
    """Fine class of each word; others than the given ones go by their ending."""

    def __init__(self, own: dict[bytes, int], first: int, endings: int):
        super().__init__(own)
        self.first, self.endings = first, endings

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-2:]) % self.endings

    def of(self, tokens: Tokens) -> np.ndarray:
        """The same of each distinct word of ``tokens``."""
        found = np.fromiter(map(self.get, tokens.words, repeat(-1)), np.int32, len(tokens.words))
        return np.where(found < 0, self.first + _ending_classes(self.endings)[tokens.tails], found).astype(np.int32)


def _contexts(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two before, one before, token) of token runs that each close with ``end``; what
    lies before a text counts as end."""
    v = np.empty_like(ids)
    v[0], v[1:] = end, ids[:-1]
    u = np.empty_like(ids)
    u[:2], u[2:] = end, ids[:-2]
    u[v == end] = end
    return u, v, ids


def _gather(into: np.ndarray, seen: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An Adagrad step on the rows ``at``, gradients of one row summed first."""
    # numbers of 16 bits are sorted much faster
    order = np.argsort(at.astype(np.min_scalar_type(len(seen))), kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rows = ordered[starts]
    total = _summed(grad.take(order, axis=0), starts)
    now = seen[rows] + _squares(total)
    seen[rows] = now
    scale = rate / np.sqrt(now + 1e-8)
    total *= scale[:, None] if total.ndim > 1 else scale
    into[rows] = into.take(rows, axis=0) + total


def _summed(grad: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``. Two numbers of 32 bits are added
    as one complex number, which halves the steps and gives the same bits."""
    if grad.ndim > 1 and grad.shape[1] % 2 == 0 and grad.dtype == np.float32:
        return np.add.reduceat(grad.view(np.complex64), starts, axis=0).view(np.float32)
    return np.add.reduceat(grad, starts, axis=0)


def _squares(total: np.ndarray) -> np.ndarray:
    """What Adagrad sees of each row: the mean square, or the square of a number."""
    return np.einsum("ij,ij->i", total, total) / total.dtype.type(total.shape[1]) if total.ndim > 1 else total * total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Inner:
    """Places of the second level. Fine classes are the ``m`` classes, then its words, of
    which ``of`` has the classes. Each shared class has a run of slots: the rest of the
    class, then its words of this level, most frequent first."""

    def __init__(self, m: int, first: int, of: np.ndarray):
        self.coarse = np.concatenate([np.arange(m), of]).astype(np.int32)
        order = np.argsort(np.concatenate([np.arange(first, m), of]), kind="stable")
        self.slot = np.full(m + len(of), -1, np.int32)
        self.slot[first + order] = np.arange(len(order))
        self.bounds = np.append(self.slot[first:m], len(order)) if m > first else np.zeros(1, np.int32)
        self.rest = np.zeros(m + len(of), bool)
        self.rest[first:m] = True
        self.first = first

    def runs(self, w: np.ndarray):
        """(first slot, end, places in ``w``) of each shared class with more than its rest."""
        at = np.flatnonzero(self.slot[w] >= 0)
        # numbers of 16 bits are sorted much faster
        k = (self.coarse[w[at]] - self.first).astype(np.min_scalar_type(len(self.bounds)))
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        cuts = np.flatnonzero(np.diff(k)) + 1
        for start, stop in zip(np.append(0, cuts), np.append(cuts, len(k)), strict=True):
            if start < stop:
                one, end = self.bounds[k[start]], self.bounds[k[start] + 1]
                if end - one > 1:
                    yield one, end, at[start:stop]


class Model:
    """R1, R2, Q and b, then R, Q and b of the second level if there is one, with what
    Adagrad has seen."""

    def __init__(self, shares: np.ndarray, shape: Shape, inner: Inner | None = None, weights: np.ndarray | None = None):
        m, rng = len(shares), np.random.default_rng(shape.seed)
        self.shape, self.shares = shape, shares
        self.parts = [rng.normal(0, 0.1, (m, shape.dim)).astype("f4") for _ in range(3)]
        self.parts.append(np.log(shares).astype("f4"))
        self.seen = [np.full(m, 1e-2, "f4") for _ in range(4)]
        self.cumulated = np.cumsum(shares)
        self.prior = np.log(shape.noise * shares).astype("f4")
        self.trained = 0
        self.inner = inner
        if inner:
            sizes = np.diff(inner.bounds)
            logs = np.log(weights) - np.log(np.repeat(np.add.reduceat(weights, inner.bounds[:-1]), sizes))
            self.parts += [np.zeros((len(inner.slot), shape.dim), "f4"), rng.normal(0, 0.1, (len(weights), shape.dim)).astype("f4"), logs.astype("f4")]
            self.seen += [np.full(n, 1e-2, "f4") for n in (len(inner.slot), len(weights), len(weights))]

    def _within(self, v: np.ndarray, w: np.ndarray):
        """(first slot, end, places, contexts, target's place in the run and its log share,
        all shares by place in the run). Runs are short and contexts many, so contexts lie
        along the rows, where sums and maxima are fast."""
        r, q, b = self.parts[4:]
        for one, end, at in self.inner.runs(w):
            h = r.take(v[at], axis=0)
            x = q[one:end] @ h.T
            x += b[one:end, None]
            x -= x.max(axis=0)
            true = self.inner.slot[w[at]] - one
            log = x[true, np.arange(len(at))]
            np.exp(x, out=x)
            total = x.sum(axis=0)
            x /= total
            yield one, end, at, h, true, log - np.log(total), x

    def learn_within(self, v: np.ndarray, w: np.ndarray) -> None:
        """One exact step on the second level; ``v`` and ``w`` are fine classes."""
        r, q, b = self.parts[4:]
        rate, places, backs = self.shape.rate, [], []
        for one, end, at, h, true, _, shares in self._within(v, w):
            grad = np.negative(shares, out=shares)
            grad[true, np.arange(len(at))] += 1
            places.append(at)
            backs.append(grad.T @ q[one:end])
            total, bias = grad @ h, grad.sum(axis=1)
            self.seen[5][one:end] += _squares(total)
            self.seen[6][one:end] += bias * bias
            q[one:end] += total * (rate / np.sqrt(self.seen[5][one:end] + 1e-8))[:, None]
            b[one:end] += bias * (rate / np.sqrt(self.seen[6][one:end] + 1e-8))
        if places:
            _gather(r, self.seen[4], v[np.concatenate(places)], np.concatenate(backs), rate)

    def within(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 of each target's probability within its class, the rest taken as one."""
        out = np.zeros(len(w))
        for _, _, at, _, _, log, _ in self._within(v, w):
            out[at] = log / math.log(10)
        return out

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        """One noise-contrastive step; the batch shares its noise."""
        r1, r2, q, b = self.parts[:4]
        k = self.shape.noise
        noise = np.minimum(np.searchsorted(self.cumulated, rng.random(k) * self.cumulated[-1]), len(b) - 1)
        odds = b - self.prior
        h = r1.take(u, axis=0)
        h += r2.take(v, axis=0)
        qw, qn = q.take(w, axis=0), q[noise]
        true = 1 - _sigmoid(np.einsum("ij,ij->i", h, qw) + odds[w])
        false = h @ qn.T
        false += odds[noise]
        false = _sigmoid(false)
        qw *= true[:, None]
        back = np.subtract(qw, false @ qn, out=qw)
        forth = true[:, None] * h
        rate = self.shape.rate
        _gather(r1, self.seen[0], u, back, rate)
        _gather(r2, self.seen[1], v, back, rate)
        at = np.concatenate([w, noise])
        _gather(q, self.seen[2], at, np.concatenate([forth, -(false.T @ h)]), rate)
        _gather(b, self.seen[3], at, np.concatenate([true, -false.sum(axis=0)]), rate)
        self.trained += len(w)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 parts: of (u, w), of (v, w) with the bias, and the normaliser of (u, v)."""
        r1, r2, q, b = (p.astype("f8") for p in self.parts[:4])
        a, c = r1 @ q.T, r2 @ q.T + b
        top_a, top_c = a.max(axis=1, keepdims=True), c.max(axis=1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(c - top_c).T) + top_a + top_c.T
        return tuple((x / math.log(10)).astype("f4") for x in (a, c, z))


def _batches(model: Model, classes: Classes, end: int, texts, rng: np.random.Generator) -> None:
    """Trains on all tokens of ``texts``, in blocks."""
    held, number = [], 0

    def step() -> None:
        fine = np.concatenate(held)
        u, v, w = _contexts(model.inner.coarse[fine], end)
        size = model.shape.batch
        for at in range(0, len(w), size):
            model.learn(u[at : at + size], v[at : at + size], w[at : at + size], rng)
        _, v, w = _contexts(fine, end)
        model.learn_within(v, w)

    for t in encoded(texts):
        for text in np.split(classes.of(t)[t.ids], t.stops[:-1]):
            held.append(text)
            number += len(text)
            if number >= 32 * model.shape.batch:
                step()
                held, number = [], 0
    if held:
        step()


WEIGHTS = "part int, row int, weights binary, tokens long, task int"
#: partitions whose weights are averaged together first
GROUP = 1024
#: rows of weights that are averaged together
BLOCK = 128


def _weights(model: Model) -> pd.DataFrame:
    out, task = [], TaskContext.get().partitionId()
    for k, (part, seen) in enumerate(zip(model.parts, model.seen, strict=True)):
        values = np.concatenate([part.reshape(len(seen), -1), seen[:, None]], axis=1).astype("<f4")
        out += [(k, at, values[at : at + BLOCK].tobytes(), model.trained, task) for at in range(0, len(seen), BLOCK)]
    return pd.DataFrame(out, columns=["part", "row", "weights", "tokens", "task"])


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean of a block of weights, by tokens."""
    total, tokens = 0.0, int(rows["tokens"].sum())
    for weights, n in zip(rows["weights"], rows["tokens"], strict=True):
        total = total + np.frombuffer(weights, "<f4").astype("f8") * (n / tokens)
    return rows.iloc[:1].assign(weights=[total.astype("<f4").tobytes()], tokens=tokens)


def _load(model: Model, rows) -> None:
    for r in rows:
        part, seen, at = model.parts[r["part"]], model.seen[r["part"]], r["row"]
        n = min(BLOCK, len(seen) - at)
        values = np.frombuffer(r["weights"], "<f4").reshape(n, -1)
        part[at : at + n] = values[:, :-1].reshape(part[at : at + n].shape)
        seen[at : at + n] = values[:, -1]


class Trained:
    """Counts that every executor needs, and the model."""

    def __init__(self, n: int, v: int, sent: dict[bytes, int], own: dict[bytes, int], sums: np.ndarray, model: Model):
        self.n, self.v, self.sent, self.own, self.sums, self.model = n, v, sent, own, sums, model

    def classes(self) -> Classes:
        return Classes(self.own, self.model.inner.first, self.model.shape.endings)


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Words with their counts, most frequent first, as many as ``most`` allows: the bound
    comes from a table of how many words have about which count, some hundred rows."""
    step = F.floor(F.log2("n") * 8)
    table = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, bound = 0, None
    for r in table:
        total += r["words"]
        if total > most:
            break
        bound = r["step"]
    if bound is None:
        return {}
    rows = counts.where(step >= bound).collect()
    return {bytes(r["word"]): r["n"] for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))}


def train(scratch: Scratch, docs: DataFrame, shape: Shape = Shape()) -> tuple[DataFrame, Trained]:
    """(word, n) of the training documents and what is fitted on them."""
    spark = docs.sparkSession
    counts = scratch.save(count_words(docs), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sent = frequent(counts, shape.sent)
    own = {END: 0}
    for word in sent:
        if len(own) < shape.own and word != END:
            own[word] = len(own)
    first, m = len(own), len(own) + shape.endings
    inner = [word for word in sent if word not in own][: math.ceil(shape.per_root * math.sqrt(v))]
    classes = Classes({}, first, shape.endings)
    places = Inner(m, first, np.array([classes[word] for word in inner], np.int32))
    # of each shared class: words seen, and their tokens; one place more is for new words
    ending = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")), F.lit(shape.endings))
    names = spark.createDataFrame([(bytearray(w),) for w in (*own, *inner)], "word binary")
    shared = counts.join(F.broadcast(names), "word", "left_anti").groupBy(ending.alias("ending")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()
    tokens, sums = np.zeros(m), np.ones(m)
    for word, k in own.items():
        tokens[k] = sent.get(word, 0)
    for r in shared:
        tokens[first + r["ending"]] = r["tokens"]
        sums[first + r["ending"]] = r["tokens"] + r["words"] + 1
    weights = np.zeros(shape.endings + len(inner))
    weights[places.slot[first:m]] = sums[first:]
    for k, word in enumerate(inner):
        tokens[places.coarse[m + k]] += sent[word]
        weights[places.slot[m + k]] = sent[word] + 1
    own |= {word: m + k for k, word in enumerate(inner)}
    model = Model((tokens + 0.5) / (tokens + 0.5).sum(), shape, places, weights)
    fitted = Trained(n, v, sent, own, sums, model)
    if not n:
        return counts, fitted

    def run(epochs: int):
        shared_model = spark.sparkContext.broadcast((model, own))

        def rows(batches):
            single_threaded()
            model, own = shared_model.value
            model.parts, model.seen, model.trained = [p.copy() for p in model.parts], [s.copy() for s in model.seen], 0
            classes, rng = Classes(own, first, shape.endings), np.random.default_rng(shape.seed)
            for batch in batches:
                for _ in range(epochs):
                    _batches(model, classes, 0, batch["text"], rng)
            if model.trained:
                yield _weights(model)

        return rows

    start = start_texts(docs, shape).repartition(1)
    _load(model, start.mapInPandas(run(shape.start_epochs), WEIGHTS).collect())
    # first the mean of each GROUP partitions, then that of the groups, so no task holds all
    every = docs.select("text").mapInPandas(run(1), WEIGHTS)
    every = every.groupBy("part", "row", F.floor(F.col("task") / GROUP)).applyInPandas(_mean, WEIGHTS)
    _load(model, every.groupBy("part", "row").applyInPandas(_mean, WEIGHTS).collect())
    return counts, fitted


def start_texts(docs: DataFrame, shape: Shape) -> DataFrame:
    """The texts of the starting run: distinct ones whose hashes lie below a bound that
    leaves at most about ``start_docs`` of them and ``start_bytes`` in all, however often a
    text or an id is repeated. A text of more than a sixteenth of the bytes has no part in
    this run; the following one trains on every text."""
    long_ = shape.start_bytes // 16
    texts = docs.select("text").where(F.octet_length("text") <= long_)
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = share_below(n, min(shape.start_docs, int(n * shape.start_bytes / max(size, 1))))
    return (texts if share is None else texts.where(hash_share("text") < share)).distinct()


SCORED = "rid long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>"


class Known(dict):
    """Number of each word sent; of others -1 less their class."""

    def __init__(self, fitted: Trained):
        super().__init__((w, k) for k, w in enumerate(fitted.sent))
        self.classes = fitted.classes()
        #: by number, then by -1 less the class: fine class, and log10(count + 1) or -1
        n = len(self)
        tail = np.arange(self.classes.first + self.classes.endings - 1, -1, -1)
        self.fine = np.concatenate([np.fromiter(map(self.classes.__getitem__, fitted.sent), np.int32, n), tail]).astype(np.int32)
        self.logs = np.concatenate([np.log10(np.fromiter(fitted.sent.values(), "f8", n) + 1), np.full(len(tail), -1.0)])

    def of(self, tokens: Tokens) -> np.ndarray:
        """The number of each distinct word of ``tokens``."""
        found = np.fromiter(map(self.get, tokens.words, repeat(-1)), np.int64, len(tokens.words))
        # a word with a class of its own is among those sent, the end token aside
        return np.where(found < 0, -1 - self.classes.of(tokens), found)

    def texts(self, texts, whole: bool):
        """(numbers of the tokens, words not sent) of each text; the words are left out if
        the sent ones are the ``whole`` vocabulary."""
        for t in encoded(texts):
            number = self.of(t)
            for ids in np.split(t.ids, t.stops[:-1]):
                at = number[ids]
                yield at, [] if whole else [t.words[k] for k in ids[at < 0].tolist()]


def score_documents(docs: DataFrame, held_out, shape: Shape = Shape()) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by a model of those not ``held_out``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts, fitted = train(scratch, docs.where("NOT held_out"), shape)
    sent = spark.sparkContext.broadcast(fitted)
    base = math.log10(fitted.n + fitted.v + 1)

    def rows(batches):
        single_threaded()
        fitted = sent.value
        known = Known(fitted)
        a, c, z = fitted.model.tables()
        log_sums = np.log10(fitted.sums)
        whole = len(fitted.sent) == fitted.v  # no word is left to join
        inner = fitted.model.inner
        for batch in batches:
            out, held, number = [], [], 0

            def step() -> None:
                """Sums over the tokens of the documents held; each closes with the end
                token, so no context reaches into the next."""
                at = np.concatenate(held)
                fine, own, new = known.fine[at], known.logs[at], at < 0
                u, v, w = _contexts(inner.coarse[fine], 0)
                shared = inner.rest[fine]
                score = a[u, w].astype("f8") + c[v, w] - z[u, v]
                score[shared] -= log_sums[w[shared]]
                score[shared & ~new] += own[shared & ~new]
                score += fitted.model.within(*_contexts(fine, 0)[1:])
                own[new] = 0
                starts = np.cumsum([0, *map(len, held[:-1])])
                sums = [np.add.reduceat(x, starts).tolist() for x in (~new, own, score)]
                for row, n, plain, total in zip(out[-len(held) :], *sums, strict=True):
                    row[4:7] = n, plain - row[3] * base, total

            for rid, doc, held_out, (at, rare) in zip(batch["rid"], batch["doc_id"], batch["held_out"], known.texts(batch["text"], whole), strict=True):
                out.append([rid, doc, held_out, len(at), 0, 0.0, 0.0, rare])
                held.append(at)
                number += len(at)
                if number >= 262_144:
                    step()
                    held, number = [], 0
            if held:
                step()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    # ids as text: a column of whole numbers with nulls would reach pandas as floats
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("rid", F.monotonically_increasing_id())
    main = scratch.save(named.mapInPandas(rows, SCORED).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "scored")
    # for words not sent, the same term is missing in both scores; they belong to the rest of a shared class
    rare = main.select("rid", F.explode("rare").alias("word")).join(counts, "word")
    rare = rare.groupBy("rid").agg(F.count("*").alias("_tf"), F.sum(F.log10(F.col("n") + 1)).alias("_log"))
    both = main.drop("rare").join(rare, "rid", "left")
    add = F.coalesce(F.col("_log"), F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("_tf"), F.lit(0))).alias("n_known"),
        F.lit(fitted.n).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("model") + add).alias("score"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, crc_of_id("doc_id") % 7 == 2)
