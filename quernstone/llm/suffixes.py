"""Repeated passages by a sparse suffix array.

A byte goes if it is covered by a string of ``WIDTH`` bytes that also starts earlier.
Suffixes are taken at anchors only: the anchor of a window of WIDTH bytes is the leftmost
smallest hash among its GRAM-byte grams, so equal windows have equal anchors at equal
places. Anchors whose gram occurs once in all texts are left out; the other anchors'
suffixes, with what precedes them in their windows, are range-partitioned by their
leading bytes at sampled splitters and sorted in each bucket by multikey refinement, eight
bytes a step. Ranks at each depth of the suffixes and of the reversed left parts then tell
which windows are equal, exactly. Splitters are whole grams and equal grams are never
parted, so no group of equal windows crosses the boundary of two buckets.

Frequent passages are combined before each shuffle: of equal grams or contexts in a task
only the first travels on, the others are known to be repeated. A gram that stands in so
many different contexts that it would fill a bucket is not kept together: its windows are
told apart by a 128-bit digest and dealt by it.

Documents are put in order once: by id, then by the md5 of the text, null ids last. So two
texts with one id are two documents, rows that repeat an id and text are one and get the
same result, and a row without an id loses what any row with an id holds.

Other defined cases: a null text is empty; texts shorter than WIDTH lose nothing; an exact
copy of an earlier document is removed whole (if it has WIDTH bytes); an empty table gives
an empty result; ``without_repeats`` carries further columns along.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import Scratch, free_names, numbered, partitions

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM  # a window has SPAN + 1 grams
#: windows looked at in one step; their place fits into the low bits of a hash
STEP = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: anchors held by a task before the first of equal ones travel on
HELD = 1_000_000
#: documents whose grams give the splitters, about
SAMPLE_DOCS = 2_000
SAMPLE_GRAMS = 64
#: anchors that one task compares, and suffixes with contexts, about
ANCHORS = 2_000_000
SUFFIXES = 400_000
#: a text has about one anchor for so many bytes
ANCHOR_BYTES = 35
#: bytes of a window's digest
DIGEST = 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    out = words[:n] * _A
    for k in (8, 16, 24):
        out = _mixed(out) + words[k : k + n]
        out *= _A
    return _mixed(out)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of each anchor of a text."""
    windows = len(data) - WIDTH + 1
    if windows < 1:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    hashes = gram_hashes(data)
    places = []
    for at in range(0, windows, STEP):
        until = min(at + STEP, windows)
        h = (hashes[at : until + SPAN] & ~PLACE) | np.arange(until + SPAN - at, dtype=np.uint64)
        # smallest of SPAN + 1 in a row, by doubling
        low, wide = h, 1
        while 2 * wide <= SPAN + 1:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        rest = SPAN + 1 - wide
        low = np.minimum(low[: until - at], low[rest : rest + until - at])
        places.append((low & PLACE).astype(np.int64) + at)
    place = np.concatenate(places)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    ends = np.concatenate([starts[1:], [windows]]) - 1
    return place[starts], starts, ends, hashes[place[starts]]


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode()


FOUND = "gram long, text long, place int, known boolean"


def _first_of_each(gram: np.ndarray, text: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """One row of each gram, to be compared with other tasks' rows, and a row that is
    known to be repeated for each occurrence of a gram that this task has at least twice."""
    order = np.lexsort((place, text, gram))
    gram, text, place = gram[order], text[order], place[order]
    same = (gram[1:] == gram[:-1]) & (text[1:] == text[:-1]) & (place[1:] == place[:-1])
    keep = np.concatenate([[True], ~same])  # copies of one text count once
    gram, text, place = gram[keep], text[keep], place[keep]
    head = np.concatenate([[True], gram[1:] != gram[:-1]])
    many = ~head | np.concatenate([~head[1:], [False]])
    first = pd.DataFrame({"gram": gram[head], "text": text[head], "place": place[head], "known": False})
    # these need no comparison: they are dealt by their own place
    spread = _mixed((text.view(np.uint64) * _A) ^ place.astype(np.uint64)).view(np.int64)
    more = pd.DataFrame({"gram": spread[many], "text": text[many], "place": place[many], "known": True})
    return pd.concat([first, more])


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(digest, places): anchors whose gram occurs twice or more, by digest of the text."""

    def find(batches):
        held, number = [], 0
        for batch in batches:
            for text, digest in zip(batch["text"], batch["digest"], strict=True):
                place, _, _, gram = anchors(_bytes(text))
                if len(place):
                    held.append((gram.view(np.int64), np.full(len(place), digest, np.int64), place))
                    number += len(place)
                if number >= HELD:
                    yield _first_of_each(*map(np.concatenate, zip(*held, strict=True)))
                    held, number = [], 0
        if held:
            yield _first_of_each(*map(np.concatenate, zip(*held, strict=True)))

    def compare(batches):
        # a task has one row at most of each gram and earlier block of rows
        parts = [(b["gram"].to_numpy(), b["text"].to_numpy(), b["place"].to_numpy(), b["known"].to_numpy()) for b in batches]
        if not parts:
            return
        gram, text, place, known = map(np.concatenate, zip(*parts, strict=True))
        yield pd.DataFrame({"text": text[known], "place": place[known]})
        gram, text, place = gram[~known], text[~known], place[~known]
        order = np.lexsort((place, text, gram))
        gram, text, place = gram[order], text[order], place[order]
        if not len(gram):
            return
        # repeated if another row of the gram has another text or place
        head = np.concatenate([[True], gram[1:] != gram[:-1]])
        group = head.cumsum() - 1
        starts = np.flatnonzero(head)
        other = (text != text[starts][group]) | (place != place[starts][group])
        many = np.bitwise_or.reduceat(other, starts)[group]
        yield pd.DataFrame({"text": text[many], "place": place[many]})

    texts = texts.select("text", F.xxhash64("text").alias("digest"))
    found = texts.mapInPandas(find, FOUND).repartition(buckets, "gram")
    return found.mapInPandas(compare, "text long, place int").groupBy(F.col("text").alias("digest")).agg(F.collect_set("place").alias("places"))


def multikey_order(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte rows, and the length of the prefix that each shares
    with the row before it in that order."""
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    words = padded.view(">u8").astype("u8")
    order = np.argsort(words[:, 0], kind="stable")
    head = np.arange(n) == 0
    for k in range(words.shape[1]):
        if k:
            # only runs that are still tied are refined by their next eight bytes
            run = head.cumsum()
            tied = ~head
            tied[:-1] |= ~head[1:]
            at = np.flatnonzero(tied)
            rows = order[at]
            order[at] = rows[np.lexsort((words[rows, k], run[at]))]
        value = words[order, k]
        head[1:] |= value[1:] != value[:-1]
        if head.all():
            break
    shared = np.zeros(n, np.int64)
    if n > 1:
        for at in range(1, n, 65_536):
            rows = slice(at, min(at + 65_536, n))
            differ = matrix[order[rows]] != matrix[order[rows.start - 1 : rows.stop - 1]]
            shared[rows] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, shared


def equal_windows(doc: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, context: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of all windows that an earlier one equals. ``context`` holds
    the bytes from a row's first window to the end of its last; rows come ordered by
    document and place."""
    left = np.frombuffer(b"".join(c[: p - f][::-1].ljust(SPAN, b"\0") for c, p, f in zip(context, place, first, strict=True)), np.uint8).reshape(-1, SPAN)
    right = np.frombuffer(b"".join(c[p - f : p - f + WIDTH].ljust(WIDTH, b"\0") for c, p, f in zip(context, place, first, strict=True)), np.uint8).reshape(-1, WIDTH)
    right_order, right_shared = multikey_order(right)
    left_order, left_shared = multikey_order(left)
    right_rank, left_rank = np.empty_like(right_order), np.empty_like(left_order)
    right_rank[right_order], left_rank[left_order] = np.arange(len(doc)), np.arange(len(doc))
    rows, starts = [], []
    for back in range(SPAN + 1):
        at = np.flatnonzero((place - back >= first) & (place - back <= last))
        if len(at) < 2:
            continue
        # equal up to a depth: no shorter shared prefix stands between two ranks
        r = (right_shared < WIDTH - back).cumsum()[right_rank[at]]
        k = (left_shared < back).cumsum()[left_rank[at]]
        _, head, of = np.unique(r * (len(doc) + 1) + k, return_index=True, return_inverse=True)
        again = head[of] != np.arange(len(at))
        rows.append(at[again])
        starts.append(place[at[again]] - back)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts)


SUFFIX = "bucket int, doc long, place int, first int, last int, context binary"


def suffixes_of(texts: DataFrame, splitters: list[bytes], hot: frozenset[bytes] = frozenset()) -> DataFrame:
    """Anchored suffixes of ``texts`` (doc, text, places) with their bucket. Of equal
    contexts in a task only the earliest keeps its context. Of a ``hot`` gram there is a
    row a window, with the window's digest as context."""
    bounds = np.array(splitters, dtype=f"S{GRAM}")

    def send(rows: list) -> pd.DataFrame:
        rows.sort(key=lambda r: (r[0], r[1]))
        # a row that repeats an id is the same document
        rows = [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
        seen, out = set(), []
        grams = np.array([c[p - f : p - f + GRAM] for _, p, f, _, c in rows], dtype=f"S{GRAM}")
        bucket = np.searchsorted(bounds, grams, side="right")
        single = np.array([len(c) == DIGEST for *_, c in rows], bool)
        bucket[single] = [int.from_bytes(rows[k][4][:4], "little") % (len(bounds) + 1) for k in np.flatnonzero(single)]
        for (doc, place, first, last, context), b in zip(rows, bucket.tolist(), strict=True):
            key = (place - first, context)
            # what needs no comparison is dealt by document, not by its gram
            out.append((doc % (len(bounds) + 1), doc, place, first, last, None) if key in seen else (b, doc, place, first, last, context))
            seen.add(key)
        return pd.DataFrame(out, columns=["bucket", "doc", "place", "first", "last", "context"])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text, places in zip(batch["doc"], batch["text"], batch["places"], strict=True):
                data = _bytes(text)
                place, first, last, _ = anchors(data)
                wanted = np.isin(place, np.asarray(places))
                for p, f, e in zip(place[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    if data[p : p + GRAM] in hot:
                        held += [(doc, w, w, w, hashlib.blake2b(data[w : w + WIDTH], digest_size=DIGEST).digest()) for w in range(f, e + 1)]
                        size += (DIGEST + WIDTH) * (e - f + 1)
                        continue
                    held.append((doc, p, f, e, data[f : e + WIDTH]))
                    size += e - f + WIDTH
                    if size > 24 << 20:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)

    return texts.mapInPandas(rows, SUFFIX)


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans that touch or overlap, put together."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return pd.DataFrame({"doc": doc, "from": start, "to": end})
    change = np.concatenate([[True], doc[1:] != doc[:-1]])
    # the furthest end so far in a document: documents are set apart by an offset
    apart = (change.cumsum() - 1) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + apart)
    head = change | np.concatenate([[True], (start + apart)[1:] > far[:-1]])
    at = np.flatnonzero(head)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return pd.DataFrame({"doc": doc[at], "from": start[at], "to": far[last] - apart[at]})


def repeated_spans(suffixes: DataFrame, buckets: int) -> DataFrame:
    """(doc, from, to): bytes that windows found to be repeated cover."""

    def rows(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        held = pd.concat(parts)
        known = held[held["context"].isna()]
        held = held[held["context"].notna()].drop_duplicates(["doc", "place"]).sort_values(["doc", "place"])
        digests = held["context"].map(len) == DIGEST
        again = held[digests][held[digests].duplicated("context")]
        known, held = pd.concat([known, again]), held[~digests]
        doc, place, first, last = (held[c].to_numpy(np.int64) for c in ("doc", "place", "first", "last"))
        spans = [(known["doc"].to_numpy(np.int64), known["first"].to_numpy(np.int64), known["last"].to_numpy(np.int64) + WIDTH)]
        if len(doc):
            row, start = equal_windows(doc, place, first, last, held["context"].tolist())
            spans.append((doc[row], start, start + WIDTH))
        yield _runs(*map(np.concatenate, zip(*spans, strict=True)))

    return suffixes.repartitionById(buckets, F.col("bucket")).mapInPandas(rows, "doc long, from int, to int")


def _splitters(texts: DataFrame, n: int, buckets: int) -> tuple[list[bytes], frozenset[bytes]]:
    """Grams that part the anchors of a bounded sample of documents evenly, and those that
    stand in more different contexts than a bucket should hold."""

    def rows(batches):
        for batch in batches:
            for text in batch["text"]:
                data = _bytes(text)
                place, first, last, _ = anchors(data)
                step = max(1, len(place) // SAMPLE_GRAMS)
                chosen = list(zip(place[::step][:SAMPLE_GRAMS].tolist(), first[::step].tolist(), last[::step].tolist(), strict=False))
                around = [hashlib.blake2b(data[f : e + WIDTH], digest_size=8).digest() for _, f, e in chosen]
                yield pd.DataFrame({"gram": [data[p : p + GRAM] for p, _, _ in chosen], "around": around})

    chosen = texts.select("text").sample(min(1.0, SAMPLE_DOCS / max(n, 1)), seed=7)
    grams = sorted(bytes(r["gram"]) for r in chosen.mapInPandas(rows, "gram binary, around binary").distinct().collect())
    most = max(8, len(grams) // buckets)
    hot = frozenset(g for g, k in Counter(grams).items() if k > most)
    even = sorted({g for g in grams if g not in hot})
    return sorted({even[k * len(even) // buckets] for k in range(1, buckets)}) if even else [], hot


def marks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, sum, copy, spans): what to remove of each document that loses anything,
    the document being given by its id and the md5 of its text.

    ``copy`` holds for later copies of a whole text; spans may overlap."""
    spark = docs.sparkSession
    named = docs.select("doc_id", "text").where(F.octet_length("text") >= WIDTH)
    light = named.select("doc_id", F.xxhash64("text").alias("digest"), F.md5(F.col("text").cast("binary")).alias("sum"), F.octet_length("text").alias("bytes")).distinct()
    order = [F.col("doc_id").asc_nulls_last(), F.col("sum")]
    light = scratch.save(numbered(scratch, light, order, "ordered").withColumnRenamed("index", "doc"), "light")
    n, size = light.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    first = light.groupBy("sum").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.save(light.join(scratch.save(first.drop("n"), "first"), "sum").where("doc <> first").select("doc"), "copies")
    places = repeated_anchors(named, partitions(spark, size // ANCHOR_BYTES, ANCHORS))
    # only first copies go on
    wanted = light.join(copies, "doc", "left_anti").join(places, "digest").select("doc", "doc_id", F.col("sum").alias("_sum"), "places")
    wanted = scratch.save(wanted.withColumnRenamed("doc_id", "_id"), "wanted")
    number = wanted.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    splitters, hot = _splitters(named, n, partitions(spark, number, SUFFIXES))
    whole = named.withColumn("sum", F.md5(F.col("text").cast("binary")))
    texts = whole.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum"))).select("doc", "text", "places")
    spans = scratch.save(repeated_spans(suffixes_of(texts, splitters, hot), len(splitters) + 1), "spans")
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    both = by_doc.withColumn("copy", F.lit(False)).unionByName(copies.select("doc", F.lit(None).cast(by_doc.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy")))
    return light.select("doc", "doc_id", "sum").join(both, "doc").select("doc_id", "sum", "copy", "spans")


def _kept(data: bytes, copy: bool, spans) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, runs removed)."""
    if copy is True and len(data) >= WIDTH:
        return b"", len(data), 1
    if spans is None or copy is True:
        return data, 0, 0
    runs = _runs(np.zeros(len(spans), np.int64), np.array([s["from"] for s in spans], np.int64), np.array([s["to"] for s in spans], np.int64))
    out, at = [], 0
    for start, end in zip(runs["from"].tolist(), runs["to"].tolist(), strict=True):
        out.append(data[at:start])
        at = end
    out.append(data[at:])
    left = b"".join(out)
    return left, len(data) - len(left), len(runs)


def _marked(docs: DataFrame, scratch: Scratch, copy: str, spans: str) -> DataFrame:
    """``docs`` with what ``marks`` found in two more columns of the given names."""
    of, name, sum_ = free_names([*docs.columns, copy, spans], "_of", "_id", "_sum")
    found = marks(docs, scratch).select(F.col("doc_id").alias(name), F.col("sum").alias(sum_), F.col("copy").alias(copy), F.col("spans").alias(spans))
    wide = docs.withColumn(of, F.md5(F.col("text").cast("binary")))
    return wide.join(found, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(of) == F.col(sum_)), "left").select(*docs.columns, copy, spans)


REPORT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(docs: DataFrame) -> DataFrame:
    """What is left of each document's bytes."""

    def rows(batches):
        for batch in batches:
            out = []
            for doc, text, copy, spans in zip(batch["doc_id"], batch["text"], batch["copy"], batch["spans"], strict=True):
                data = _bytes(text)
                left, removed, runs = _kept(data, copy, spans)
                out.append((doc, len(data), removed, runs, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    # ids as text: a column of whole numbers with nulls would reach pandas as floats
    marked = _marked(docs, Scratch(docs.sparkSession, "suffixes"), "copy", "spans").withColumn("doc_id", F.col("doc_id").cast("string"))
    return marked.mapInPandas(rows, REPORT).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of text, and n_chars to match if there is
    one. Characters of which only a part would stay go too."""

    def rest(texts: pd.Series, copies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _kept(_bytes(t), c, s)[0].decode(errors="ignore") for t, c, s in zip(texts, copies, spans, strict=True)], dtype=object)

    cut = F.pandas_udf(rest, "string")
    copy, spans = free_names(docs.columns, "_copy", "_spans")
    marked = _marked(docs, Scratch(docs.sparkSession, "suffixes"), copy, spans)
    shorter = marked.withColumn("text", F.when(F.col(copy).isNull(), F.col("text")).otherwise(cut("text", copy, spans)))
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return shorter.select(*docs.columns)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
