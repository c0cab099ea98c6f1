import collections
import random

import numpy as np

from framewright.llm import near_dedup as nd
from framewright.llm.near_dedup import drop_near_duplicates, near_duplicate_classes

VOCABULARY = [f"w{i}" for i in range(3000)]


def plain_shingles(text):
    words = nd.words_of(text)
    seen, out = collections.Counter(), []
    for i in range(max(1, len(words) - 4)):
        gram = tuple(words[i : i + 5])
        seen[gram] += 1
        out.append((gram, seen[gram]))
    return out


def plain_share(a, b):
    """Longest common subsequence of labelled shingles, by the quadratic table."""
    x, y = plain_shingles(a), plain_shingles(b)
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1] / (len(x) + len(y) - table[-1, -1])


def plain_classes(rows, least=0.8):
    """class of each id by comparing all pairs."""
    rows = [(i, t) for i, t in rows if i is not None]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            wa, wb = nd.words_of(a or ""), nd.words_of(b or "")
            if (not wa or not wb) and rows[i][0] != rows[j][0]:
                continue
            if wa == wb or (min(len(wa), len(wb)) > 4 and plain_share(a, b) >= least):
                parent[root(i)] = root(j)
    names = collections.defaultdict(list)
    for i, (name, _) in enumerate(rows):
        names[root(i)].append(name)
    return sorted((n, min(g), len(g)) for g in names.values() for n in g)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words = words or ["x"]
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[at] = rng.choice(VOCABULARY)
        elif kind < 0.8:
            words.insert(at, rng.choice(VOCABULARY))
        else:
            del words[at]
    return words


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):  # groups of near copies, some links, some not
        base = rng.choices(VOCABULARY, k=rng.choice([8, 30, 90, 150]))
        texts += [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25 + 2))) for _ in range(6)]
    passage = rng.choices(VOCABULARY, k=60)  # one passage in many different texts
    texts += [" ".join(rng.choices(VOCABULARY, k=20) + passage + rng.choices(VOCABULARY, k=rng.randrange(1, 60))) for _ in range(25)]
    texts += ["the " * 40, "The, the! " * 20, "the " * 50, "", None, "...", "...", "a b", "A b", "a b c", "one"]
    moved = rng.choices(VOCABULARY, k=100)
    texts += [" ".join(moved), " ".join(moved[50:] + moved[:50])]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (None, "a b"), (None, None)]


def test_aligned_equals_the_quadratic_table():
    rng = random.Random(4)
    numbers = lambda t: np.array([hash(w) & 0xFFFF for w in nd.words_of(t)], np.uint16)
    for _ in range(200):
        base = rng.choices(VOCABULARY[: rng.choice([3, 50, 3000])], k=rng.randrange(1, 80))
        a, b = " ".join(base), " ".join(edited(rng, base, rng.randrange(0, 6))[: rng.randrange(1, 100)] or ["x"])
        share = plain_share(a, b)
        got = nd.aligned(numbers(a), numbers(b), 0.8)
        if share >= 0.8 and min(len(nd.words_of(a)), len(nd.words_of(b))) > 4:
            assert abs(got - share) < 1e-9
        elif min(len(nd.words_of(a)), len(nd.words_of(b))) > 4:
            assert got < 0.8


def test_classes_equal_comparing_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, class_id int")
        got = near_duplicate_classes(docs).collect()
        named = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in got if r["doc_id"] is not None)
        assert named == plain_classes(rows)
        assert sum(r["doc_id"] is None for r in got) == 2


def test_one_of_each_class_stays(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, key long")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c, _ in plain_classes(rows)})
    assert ids.count(None) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_classes(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0


def test_order_decides(spark):
    """The same shingles in another order are another text."""
    rng = random.Random(9)
    blocks = [rng.choices(VOCABULARY, k=30) for _ in range(6)]
    straight = " ".join(w for b in blocks for w in b)
    turned = " ".join(w for b in reversed(blocks) for w in b)
    docs = spark.createDataFrame([(1, straight), (2, turned), (3, straight.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
