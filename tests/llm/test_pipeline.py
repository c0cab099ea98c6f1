import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm.common import tokenizer_path
from framewright.llm.near_dedup import words_of
from framewright.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns_and_filters(spark, steps):
    original, language, quality, distinct, mixed, _ = steps
    assert all(step.columns == original.columns for step in steps[1:5])
    rows = [{r["doc_id"]: r["text"] for r in step.collect()} for step in steps[:4]]
    for before, after in zip(rows, rows[1:], strict=False):
        assert after.items() <= before.items()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in rows[1] if labels.get(i) == 1]
    assert sum(i in rows[2] for i in good) >= 0.97 * len(good)
    texts = [" ".join(words_of(t)) for t in rows[3].values()]
    assert len(set(texts)) == len(texts)
    assert {" ".join(words_of(t)) for t in rows[2].values()} >= set(texts)


def test_mix_and_tokens(steps):
    mixed, packed = steps[4].collect(), steps[5].collect()
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted(len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sorted(r["doc_tokens"] for r in packed if r["start"] == 0) == want
    assert sum(r["length"] for r in packed) == sum(want)
    for r in packed[:200]:
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)


def test_run_equals_the_stages(spark, steps):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[-1])


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["target", "source_size", "_size", "_key", "_whole", "_doc", "_rejected", "_lang_pred", "_score", "score", "_told", "_quality"]


def test_clashing_columns_nulls_ties_and_long_texts(spark, tmp_path):
    """Every stage keeps all columns and their values, whatever they are called."""
    sample = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in sample]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, 5), (900, None, "en", None, None), (901, "", None, "a", 0)]
    rows += [(902, rows[5][1] * 200, "en", "a", 9), (903, "!!", "de", "b", 2)]
    schema = ODD + "".join(f", {c} string" for c in CLASHES)
    spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(r[0], i % 2, 0) for i, r in enumerate(rows)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, str(tmp_path)), name)
        assert after.columns == docs.columns
        for r in after.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASHES)
            assert name == "mixing" or (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) in rows
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in packed) == docs.count()
