"""The registered queries over whole tables: columns, coverage and plain recomputation."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from framewright.llm.common import tokenizer_path
from framewright.llm.near_dedup import words_of
from framewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op2_near_duplicates": {"doc_id", "class_id", "class_size"},
    "op3_url_model": {"page_id", "host", "path", "rule", "verdict"},
    "op4_quality": {"doc_id", "held_out", "score", "predicted"},
    "op5_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_site_templates": {"page_id", "url", "text", "n_chars"},
    "op8_licences": {"doc_id", "paragraph", "family", "text"},
    "op9_bit_sliced": {"query_id", "rank", "vec_id", "score"},
    "op10_cross_polytope": {"query_id", "rank", "vec_id", "score"},
    "op11_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op12_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op13_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert COLUMNS[name] <= set(QUERIES[name](spark, SF).columns)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_packing_returns_every_token_once(spark, documents):
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = QUERIES["op1_packing"](spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(documents)
    for name, pieces in by_doc.items():
        ids = np.asarray(plain.encode(documents[name]["text"], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)


def test_classifiers_on_held_out_rows(spark, documents):
    for r in (rows := QUERIES["op5_language"](spark, SF).collect()):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(documents)
    assert sum(documents[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(labels[r["doc_id"]] == r["predicted"] for r in held) >= 0.8 * len(held)


def test_exact_copies_share_a_class(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op2_near_duplicates"](spark, SF).collect()}
    assert set(rows) == set(documents)
    first = {}
    for name in sorted(documents):
        words = " ".join(words_of(documents[name]["text"]))
        other = first.setdefault(words, name)
        assert rows[name]["class_id"] == rows[other]["class_id"] <= other
    sizes = {}
    for r in rows.values():
        sizes[r["class_id"]] = sizes.get(r["class_id"], 0) + 1
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows.values())
