"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from quernstone.llm import lm, merkle, mixing, ngrams, packing, phrases, prints, quality, search, shards, suffixes, vectors, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_vectors": vectors.op1_vectors,
        "op2_ngrams": ngrams.op2_ngrams,
        "op3_suffixes": suffixes.op3_suffixes,
        "op4_warc": warc.op4_warc,
        "op5_quality": quality.op5_quality,
        "op6_lm": lm.op6_lm,
        "op7_mixing": mixing.op7_mixing,
        "op8_search": search.op8_search,
        "op9_shards": shards.op9_shards,
        "op10_packing": packing.op10_packing,
        "op11_merkle": merkle.op11_merkle,
        "op12_prints": prints.op12_prints,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vectors": vectors.OP1_SQL,
        "op2_ngrams": ngrams.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op13_phrases": phrases.OP13_SQL,
    }
