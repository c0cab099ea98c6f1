import math

import numpy as np
import pytest

from framewright.llm.bit_sliced import Slices, block_top, signed_powers, top_k_products
from framewright.llm.cross_polytope import Hashes, fine_buckets, hadamard, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, score long, v string"


def odd_rows(dims):
    nan, inf = float("nan"), float("inf")
    return [
        (5000, None), (5001, []), (5002, [nan] * dims), (5003, [inf] + [0.5] * (dims - 1)), (5004, [None] * dims),
        (None, [0.5] * dims), (5005, [0.5] * (dims + 1)), (5006, [0.0] * dims),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "") for i, v in rows], SCHEMA)


def vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x = np.round(x / np.linalg.norm(x, axis=1)[:, None], 2).astype(np.float32)
    if copies:
        x[:copies] = x[0]
    return x


def plain_products(rows, asked, k):
    dims = len(rows[0][1])
    good = [(i, np.floor(64 * np.asarray(v, float)).astype(int)) for i, v in rows
            if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if asked(q):
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_signed_powers():
    for factor in range(-300, 300):
        terms = signed_powers(factor)
        assert sum(s << e for s, e in terms) == factor
        assert len(terms) <= bin(abs(factor)).count("1") + (factor < 0)


@pytest.mark.parametrize("rows, dims, top", [(1, 3, 5), (64, 4, 1), (65, 2, 9), (700, 16, 300), (130, 5, 0)])
def test_block_equals_sorting(rows, dims, top):
    rng = np.random.default_rng(rows)
    values, ids = rng.integers(-top - 1, top + 1, (rows, dims)), rng.permutation(rows)
    index = Slices(values)
    for q in range(min(rows, 20)):
        got, scores = block_top(index, ids, values[q], ids[q], 7)
        exact = values @ values[q]
        want = sorted((-s, i) for s, i in zip(exact.tolist(), ids.tolist(), strict=True) if i != ids[q])[:7]
        assert [(-s, i) for s, i in zip(scores.tolist(), got.tolist(), strict=True)] == want


def test_top_products_with_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("framewright.llm.bit_sliced.BLOCK_ROWS", 70)
    monkeypatch.setattr("framewright.llm.bit_sliced.BLOCK_QUERIES", 6)
    rows = list(enumerate(vectors(300, 8, 1, copies=100).tolist())) + odd_rows(8)
    df = frame(spark, rows)
    got = top_k_products(df, df.where("vec_id % 20 = 0"), 20).collect()
    want = plain_products(rows, lambda q: q % 20 == 0, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    few = frame(spark, rows[:4])
    assert top_k_products(few, few, 20).count() == 12
    assert top_k_products(df.limit(0), df, 20).count() == 0
    assert top_k_products(df, df.limit(0), 20).count() == 0


def test_hadamard_is_orthogonal():
    x = hadamard(np.eye(16))
    assert np.allclose(x @ x.T, np.eye(16)) and np.allclose(np.abs(x), 0.25)


def test_hash_is_the_nearest_axis():
    hashes = Hashes(6, 3, 4, 1)
    x = np.random.default_rng(0).normal(size=(50, 6))
    near = np.stack([hashes.closeness(x, table) for table in range(3)], axis=1)
    assert near.shape == (50, 3, 2 * 8 * 4)
    assert (hashes.places(x) == near.argmax(axis=2)).all()
    behind = (near.max(axis=2, keepdims=True) - near).reshape(50, -1)
    probes = hashes.probes(x, 9)
    assert np.allclose(np.sort(np.take_along_axis(behind, probes, axis=1)), np.sort(behind, axis=1)[:, :9])
    assert fine_buckets(1000, 64, 4096) == 1 and fine_buckets(10**8, 64, 4096) > 100


def test_large_components(spark):
    rows = [(i, [x * 1e200 for x in v]) for i, v in enumerate(vectors(60, 6, 8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, df.where("vec_id % 50 = 0"), 5).collect()
    want = plain_cosines([(i, [x / 1e200 for x in v]) for i, v in rows], lambda q: q % 50 == 0, 5)
    assert got and all(-1 <= r["score"] <= 1.0000001 for r in got)
    assert sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got) >= 9


def test_pruning_and_recall_on_twenty_thousand_rows():
    """Nearly random vectors, as the driver's: few rows are scored, and nearly all neighbours found."""
    x = np.random.default_rng(5).normal(size=(20_000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    fine = fine_buckets(len(x), 64, 8)
    hashes = Hashes(64, 16, fine, 3)
    own = np.concatenate([hashes.places(x[i : i + 2000]) for i in range(0, len(x), 2000)])
    found = looked = 0
    for q in range(100):
        probes = hashes.probes(x[q : q + 1], round(16 * 7 * fine**0.5))[0]
        hit = np.stack([np.isin(own[:, t], probes[probes // (128 * fine) == t] % (128 * fine)) for t in range(16)], axis=1)
        looked += hit.sum()
        cosines = x @ x[q]
        cosines[q] = -2
        found += hit[np.argsort(-cosines)[:5]].any(axis=1).sum()
    assert found >= 0.9 * 500 and looked <= 0.3 * 100 * len(x)


def plain_cosines(rows, asked, k):
    dims = len(rows[0][1])
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == dims
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if asked(q):
            cos = [(-round(float(v @ w) / math.sqrt(float(v @ v)) / math.sqrt(float(w @ w)), 12), i) for i, w in good if i != q]
            out[q] = sorted(cos)[:k]
    return out


@pytest.mark.parametrize("rows, copies, bucket_rows", [(800, 0, 4096), (800, 300, 2)])
def test_neighbours_against_brute_force(spark, monkeypatch, rows, copies, bucket_rows):
    monkeypatch.setattr("framewright.llm.cross_polytope.PART_ROWS", 50)
    table = list(enumerate(vectors(rows, 12, 2, copies).tolist())) + odd_rows(12)
    df = frame(spark, table)
    got = nearest_neighbours(df, df.where("vec_id % 50 = 0"), 5, bucket_rows=bucket_rows, probes=8).collect()
    want = plain_cosines(table, lambda q: q % 50 == 0, 5)
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
    assert all(v == sorted(v) for v in mine.values())
    found = sum(len({i for _, i in want[q]} & {i for _, i in mine.get(q, [])}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    if copies:  # a query among the copies finds the smallest ids of its copies
        assert [i for _, i in mine[0]] == [1, 2, 3, 4, 5] and [i for _, i in mine[50]] == [0, 1, 2, 3, 4]


def test_neighbours_of_small_tables(spark):
    few = frame(spark, list(enumerate(vectors(3, 4, 5).tolist())))
    assert {(r["query_id"], r["rank"]) for r in nearest_neighbours(few, few, 5, probes=8).collect()} == {(q, r) for q in range(3) for r in (1, 2)}
    assert nearest_neighbours(few.limit(0), few, 5).count() == 0
    assert nearest_neighbours(few, few.limit(0), 5).count() == 0


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = plain_cosines(rows, lambda q: q % 50 == 0, 5)
    found = 0
    for r in nearest_neighbours(df, df.where("vec_id % 50 = 0"), 5).collect():
        found += r["vec_id"] in {i for _, i in want[r["query_id"]]}
    assert found >= 0.9 * sum(map(len, want.values()))
