import math
import re

import pytest

from framewright.llm.mixing import mix_sources, mixed_documents


def water(sizes, weights, share, epochs):
    """Targets by refilling until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = epochs * sizes[s]
            rest -= target[s]
        free -= over
    return target


ROWS = (
    [(i, "wort " * (i % 40), ["b", "a", None, "c"][i % 4], "x") for i in range(400)]
    + [(1000 + i, None if i % 2 else "", "empty", "x") for i in range(6)]
    + [(7, "same row again", "a", "x")] * 5
    + [(None, "a null id", "b", "x"), (2000, "lang " * 5000, "d", "x")]
)
SCHEMA = "doc_id long, text string, source string, size string"


def test_targets_and_words_taken(spark):
    got = mix_sources(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    for source, words in taken.items():
        assert want[source] - 7 <= words <= want[source] + 1e-6


def test_reruns_and_partitions_agree(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(mix_sources(docs)) == key(mix_sources(docs.repartition(7)))
    assert key(mix_sources(docs)) != key(mix_sources(docs, seed=18))


@pytest.mark.parametrize("share", [0.3, 1.0, 2.0, 5.0])
def test_mixed_documents_hold_what_is_taken(spark, share):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = mix_sources(docs, share=share)
    taken = {r["source"]: r["s"] for r in plan.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "s").collect()}
    got = mixed_documents(docs, share=share)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {s: n for s, n in taken.items() if n}


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
