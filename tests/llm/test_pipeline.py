"""The corpus pipeline against brute force, stage by stage, each on its own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_documents import SCHEMA, components, fixture_rows, shingle_sets
from tokenizers import Tokenizer

import corpus_pipeline
from quernstone.llm import mixing, quality


def without_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = None if text is None else left.decode(errors="ignore")
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    junk = [(500 + k, " | ".join(f"w{k}{j}" for j in range(30)), "en", "src1", 0, 1, "x", 1) for k in range(40)]
    rows = fixture_rows() + junk
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if r[0] >= 500 else 1, 0) for r in rows if r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    columns = inputs[0].columns
    assert all(d.columns == columns for d in inputs)
    start, good, single, cut, mix = ([r for r in d.collect()] for d in inputs)

    predicted = {r["doc_id"]: r["predicted"] for r in quality.score_documents(inputs[0], spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in start if predicted[r["doc_id"]])
    assert not any(r["doc_id"] >= 500 for r in good)

    sets = shingle_sets([tuple(r) for r in good])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(r["doc_id"] for r in single) == sorted(set(components(sets, links).values()))

    assert {r["doc_id"]: r["text"] for r in cut} == without_repeats({r["doc_id"]: r["text"] for r in single}) and len(cut) == len(single)

    copies = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(inputs[3]).collect()}
    assert Counter(r["doc_id"] for r in mix) == Counter({i: c for i, c in copies.items() if c})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in mix:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            expected[r["doc_id"], s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in docs.collect()) == expected


def test_run_is_the_stages(spark, folder):
    first = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, first.select(*key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, folder).select(*key).collect()))
    assert "pipeline" in __import__("__spark_entry__").queries()
