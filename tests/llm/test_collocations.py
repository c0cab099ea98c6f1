"""Collocations against counting every phrase of every piece in plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import collocations
from framewright.llm.collocations import adjoining, mine_collocations

SCHEMA = "text string, lang string, doc string, word string, w1 int, f int, n int, body string"


def brute(rows, max_words=3, least=10, share=50, top=2000):
    grams, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for length in range(1, max_words + 1):
                for i in range(len(words) - length + 1):
                    grams.setdefault(lang, Counter())[tuple(words[i : i + length])] += 1
    out = []
    for lang, counts in grams.items():
        often = {x: a for x, a in counts.items() if len(x) > 1 and a >= least}
        found = []
        for x, a in often.items():
            if any(
                len(y) > len(x) and 100 * b >= share * a and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
                for y, b in often.items()
            ):
                continue
            cuts = [(10**6 * a * a // (counts[x[:k]] * counts[x[k:]]), k) for k in range(1, len(x))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(x).encode(), counts[x[:k]], counts[x[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["The", "of", "ÉTÉ", "é", "a\x00b", "x", "y", "zz", " ", "#1"]
    rows = []
    for _ in range(120):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "! "])
            for _ in range(rng.randrange(30))
        )
        rows.append((text, rng.choice(["en", "de", "und", "", None])))
    rows += rows[:10]
    rows += [(None, "en"), ("", None), ("go on and on " * 3000, "fr"), ("new york city " * 20 + ". new york . " * 15, "de")]
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, 3), (2, 3), (3, 4)])
def test_all_phrases(spark, seed, words):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "", "", 1, 2, 3, "b") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in mine_collocations(df, max_words=words).collect())
    assert got == brute(rows, words)
    assert "doc" in df.columns and not [t for t in spark.catalog.listTables() if t.name.startswith("occurrences_")]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = made(4)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in mine_collocations(df, top=7).collect()) == brute(rows, top=7)


def test_stored_relation_joins_without_shuffle(spark):
    docs = spark.createDataFrame([("en", i, "a b c. d e") for i in range(50)], "lang string, doc long, body string")
    rows = collocations.occurrences(docs).withColumn("w1", F.xxhash64("word"))
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None)
    with collocations.settings(spark, collocations.CO_LOCATED):
        relation = collocations.Relation(rows.repartition(4, "doc").select("doc", "piece", "pos", "w1"), 4)
        joined = adjoining(relation.read(), 1)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 150
        relation.forget()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None) == before


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    words = spark.createDataFrame([(1, big), (2, big + 1)], "w1 long, f long")
    pairs = spark.createDataFrame([(1, 2, big - 1)], "w1 long, w2 long, f long")
    row = collocations.scored(pairs, 2, [words, pairs]).first()
    assert row["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 1))


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert mine_collocations(none).count() == 0
    rare = spark.createDataFrame([("one two three", "en"), (None, None)], "text string, lang string")
    assert mine_collocations(rare).count() == 0


def test_stored_relation_joins_without_sort(spark):
    docs = spark.createDataFrame([("en", i, "a b  c.\td e\x0b? f") for i in range(50)], "lang string, doc long, body string")
    rows = collocations.occurrences(docs).withColumn("w1", F.xxhash64("word"))
    with collocations.settings(spark, collocations.CO_LOCATED):
        relation = collocations.Relation(rows.repartition(4, "doc").select("doc", "piece", "pos", "w1"), 4)
        joined = adjoining(relation.read(), 1, relation.read_by_next())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        plain = adjoining(relation.read(), 1)
        assert joined.count() == 150 and joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
        relation.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("occurrences_")]
