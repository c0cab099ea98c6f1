"""The filter audit against running every order on every document."""

import random
import re
from itertools import permutations

import pytest

from framewright.llm.filter_audit import audit_filters, path_counts

SCHEMA = "doc_id long, text string, source string, n long, id string, part string"


def brute(docs, labels):
    """Each order applied left to right, document by document."""
    texts = [(d[0], d[1] or "", d[2] or "") for d in docs]
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = marks.get(i, (0, 0))
            marks[i] = (max(good, int(quality == 1)), max(bad, int(toxic == 1)))
    failing = []
    for i, text, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            f.add("C")
        if re.search(r"[#$%&*|]", text):
            f.add("D")
        if i is not None and any(j is not None and j < i and t == text for j, t, _ in texts):
            f.add("E")
        failing.append((part, f, *marks.get(i, (0, 0))))
    rows, shapley = {}, {}
    for part in {p for p, *_ in failing}:
        own = [x for x in failing if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                failed = sum(name in x[1] for x in own)
                rows[part, "".join(order), step] = (
                    len(left), len(gone), failed - len(gone), sum(x[1] == {name} for x in own),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                )
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def audited(df, labels):
    return {
        (r["part"], r["filter_order"], r["step"]): (
            r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]
        )
        for r in audit_filters(df, labels).collect()
    }


def made(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(rng.choice([5, 999]))) for _ in range(n)) for n in (3, 199, 200, 201, 700)]
    pool += ["", None, "A", "ABC def" * 90, pool[2] + " #", "x y " * 210, pool[3].upper(), "x " * 30_000]
    docs = []
    for _ in range(60):
        i = rng.choice([None, *range(40)])
        docs.append((i, rng.choice(pool), rng.choice(["a", "b", "", None]), 1, "other", "z"))
    docs += docs[:5]
    labels = [(rng.choice([None, *range(45)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order(spark, seed):
    docs, labels = made(seed)
    df = spark.createDataFrame(docs, SCHEMA)  # columns named as the operator's own ones do not disturb it
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(df, marks) == brute(docs, labels)


def test_paths_count_orders():
    forward, backward = path_counts(5)
    assert forward[31] == backward[0] == 120
    for state in range(32):
        through = sum(
            sum(1 << "ABCDE".index(x) for x in order[: state.bit_count()]) == state for order in permutations("ABCDE")
        )
        assert forward[state] * backward[state] == through


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(none, marks).count() == 0
    one = spark.createDataFrame([(1, None, None, 0, "", "")], SCHEMA)
    rows = audit_filters(one).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}
    assert all((r["removed"], r["shapley"]) == ((1, 120) if r["filter_order"][r["step"] - 1] == "A" else (0, 0)) for r in rows)
