import random
import zlib

import numpy as np
import pytest

from framewright.llm.language import identify_languages, term_counts, train_languages
from framewright.llm.quality import bag, features, score_quality, train_quality

SF = "/root/testdata/sf0.01"


def test_term_counts_are_byte_ngrams():
    text = "Ab é"
    raw = b" " + "ab é".encode() + b" "
    want = {}
    for n, base in ((2, 1 << 24), (3, 0)):
        for i in range(len(raw) - n + 1):
            key = int.from_bytes(raw[i : i + n], "big") + base
            place = (key * 2654435761 & 0xFFFFFFFF) >> 20
            want[place] = want.get(place, 0) + 1
    found = term_counts([text])[0]
    assert {int(i): int(found[i]) for i in np.flatnonzero(found)} == want


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id").collect()
    held = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    model = train_languages(docs.where(~docs.doc_id.isin(held)))
    again = train_languages(docs.where(~docs.doc_id.isin(held)).repartition(5))
    assert np.allclose(model.centroids, again.centroids, atol=1e-5) and (model.of == again.of).all()
    told = identify_languages(docs.where(docs.doc_id.isin(held)), model, prefix="p_").collect()
    assert sum(r["lang"] == r["p_lang_pred"] for r in told) / len(told) > 0.99
    assert all(0 <= r["p_score"] <= 1 for r in told)
    assert sum(r["p_rejected"] for r in told) / len(told) < 0.02


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "the and of that with", "en", 1), (2, "der die und nicht", "de", 1), (3, None, "en", 1), (4, "12 !?", None, 1),
         (5, "", "de", 1), (6, "漢字かな", None, 1), (7, "the and " * 30000, None, 1), (1, "the and of that with", "en", 1)],
        "doc_id long, text string, lang string, score int",
    )
    model = train_languages(docs)
    got = {r["doc_id"]: r for r in identify_languages(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert got[6]["rejected"] and got[6]["lang_pred"] in ("en", "de")
    assert identify_languages(docs, model).count() == 8
    nothing = train_languages(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in identify_languages(docs, nothing).collect()} == {"und"}
    assert identify_languages(docs.limit(0), model).count() == 0


def test_features_equal_a_plain_loop():
    """The vectorised hashes of several texts are those of each text alone, and words are told apart."""
    texts = ["", "a", "abc de", "The the THE cat", "é" * 9, "x y x y", "|" * 50]
    for kind, (buckets, starts) in enumerate(features(texts, 16)):
        for i, text in enumerate(texts):
            alone, _ = list(features([text], 16))[kind]
            assert buckets[starts[i] : starts[i + 1]].tolist() == alone.tolist(), (kind, text)
    words = [list(features([t], 16))[-2][0].tolist() for t in ("one two", "two one")]
    assert words[0] == words[1][::-1] and words[0][0] != words[0][1]


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = labelled.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    model = train_quality(spark.createDataFrame(labelled[~held]))
    scores = model.score(labelled[held].text.tolist())
    truth = labelled[held].quality.to_numpy()
    assert ((scores >= 0.5) == truth).mean() > 0.95
    for text, score in list(zip(labelled[held].text, scores, strict=True))[:20]:
        ids, share = bag(text, model.bits)
        odds = float((model.odds[ids] * share).sum()) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)


def test_quality_edge_cases(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=30)), 1, "s") for i in range(40)]
    bad = [(100 + i, "### %%% " * 20, 0, "s") for i in range(40)]
    odd = [(900, None, 1, "s"), (901, "", None, "s"), (None, "alpha beta", 1, "s"), (902, "beta gamma " * 40000, None, "s")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, quality int, score string")
    model = train_quality(docs)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert all(got[r[0]] > 0.5 for r in good) and all(got[r[0]] < 0.5 for r in bad)
    assert got[902] > 0.5 and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901]
    one_class = train_quality(docs.where("quality = 1"))
    assert {r["score"] > 0.5 for r in score_quality(docs, one_class).collect()} == {True}
    assert {r["score"] for r in score_quality(docs, train_quality(docs.limit(0))).collect()} == {0.5}
    assert score_quality(docs.limit(0), model).count() == 0
