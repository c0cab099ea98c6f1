"""Near copies with passages that recur inside a document."""

import random

import numpy as np

from framewright.llm import near_dedup as nd
from framewright.llm.near_dedup import near_duplicate_classes

VOCABULARY = [f"w{i}" for i in range(3000)]


def numbers(words):
    return np.array([int(w[1:]) for w in words], np.uint16)


def plain_share(a, b):
    """Longest common subsequence of the shingles themselves, by the quadratic table."""
    x, y = ([tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))] for t in (a, b))
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1] / (len(x) + len(y) - table[-1, -1])


def song(rng, verses, words=50):
    chorus = rng.choices(VOCABULARY, k=words)
    return chorus, [w for _ in range(verses) for w in chorus + rng.choices(VOCABULARY, k=words)]


def test_share_with_repeats_equals_the_unlabelled_table():
    rng = random.Random(6)
    near = 0
    for turn in range(120):
        chorus, text = song(rng, rng.randrange(2, 5), rng.choice([6, 12, 20]))
        other = list(text)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(other) + 1)
            if rng.random() < 0.5:
                other[at:at] = rng.choice([chorus, [rng.choice(VOCABULARY)]])
            else:
                del other[at : at + rng.choice([1, len(chorus)])]
        if turn % 4 == 0:  # few words, so that the bits are used
            text, other = ([f"w{int(w[1:]) % 2}" for w in t] for t in (text, other))
        share, got = plain_share(text, other), nd.alignment_share(numbers(text), numbers(other), 0.8)
        near += share >= 0.8
        assert abs(got - share) < 1e-9 if share >= 0.8 else got < 0.8
        assert nd.similar(numbers(text), numbers(other), 0.8) == (share >= 0.8)
    assert near > 20


def test_both_ways_to_the_common_length_agree(monkeypatch):
    rng = np.random.default_rng(7)
    for words in (2, 40):
        x, y = (rng.integers(0, words, n).astype(np.uint64) for n in (300, 280))
        table = np.zeros((301, 281), int)
        for i in range(300):
            for j in range(280):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert nd.common_length(x, y, 300) == table[-1, -1]
        monkeypatch.setattr(nd, "BLOCK_BITS", 64)
        assert nd._bit_length(x, y) == table[-1, -1]


def test_one_chorus_more_is_a_near_copy(spark):
    chorus, text = song(random.Random(8), 10)
    assert nd.alignment_share(numbers(text), numbers(chorus + text), 0.8) > 0.94
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(chorus + text))], "doc_id long, text string")
    assert {r["class_id"] for r in near_duplicate_classes(docs).collect()} == {1}
