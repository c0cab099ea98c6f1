import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.functions.hashing import covering_masks, deep_cover, light_cover
from framewright.operators import dedup
from framewright.operators.dedup import duplicate_ordinals, first_near, mark_duplicates, near_dedup, near_links, near_pairs

SCHEMA = "ordinal bigint, phash string"


def greedy(rows, threshold, seeds=()):
    """The rule as a plain loop: ordinals of the dropped rows."""
    seen, dropped = [int(s, 16) for s in seeds], []
    for ordinal, text in sorted(rows):
        if text is None or len(text) != 16:
            continue
        value = int(text, 16)
        if any(bin(value ^ other).count("1") <= threshold for other in seen):
            dropped.append(ordinal)
        else:
            seen.append(value)
    return dropped


def clusters(rows, centers, flips, seed):
    rng = random.Random(seed)
    middle = [rng.getrandbits(64) for _ in range(centers)]
    result = []
    for i in range(rows):
        value = rng.choice(middle)
        for _ in range(rng.randint(0, flips)):
            value ^= 1 << rng.randrange(64)
        result.append((3 * i + 1, f"{value:016x}"))
    return result


def dropped(spark, rows, threshold=10, seeds=None, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    if seeds is not None:
        seeds = spark.createDataFrame([(s,) for s in seeds], "phash string")
    return sorted(r[0] for r in duplicate_ordinals(df, threshold, seeds, **options).collect())


H = "00ff00ff12345678"


@pytest.mark.parametrize(
    "hashes, seeds, expected",
    [
        ([H, H], None, [1]),
        ([H], [H], [0]),
        ([None, None], None, []),
        (["0000000000000000", "00000000000000ff", "000000000000ffff"], None, [1]),
        (["0000000000000000", "00000000000003ff"], None, [1]),
        (["0000000000000000", "00000000000007ff"], None, []),
        (["zz", "zz"], None, []),
        (["FFFFFFFFFFFFFFFF", "fffffffffffffffe"], None, [1]),
    ],
)
def test_cases(spark, hashes, seeds, expected):
    assert dropped(spark, list(enumerate(hashes)), seeds=seeds) == expected


@pytest.mark.parametrize(
    "threshold, rows, centers, flips, options",
    [
        (0, 300, 20, 2, {}),
        (3, 400, 30, 5, {}),
        (10, 400, 40, 9, {}),
        (13, 200, 15, 9, {}),
        # Crowded buckets: every row takes the deep cover.
        (10, 300, 3, 9, {"bucket_rows": 8}),
        # A large group of near-copies: decided by prefixes.
        (10, 400, 2, 6, {"bucket_rows": 64, "min_comparisons": 2000, "comparisons_per_row": 1}),
        (4, 400, 2, 3, {"bucket_rows": 8, "min_comparisons": 2000, "comparisons_per_row": 1}),
    ],
)
def test_equals_the_plain_loop(spark, threshold, rows, centers, flips, options):
    data = clusters(rows, centers, flips, rows + centers)
    assert dropped(spark, data, threshold, **options) == greedy(data, threshold)
    seeds = [h for _, h in data[::23]]
    assert dropped(spark, data, threshold, seeds, **options) == greedy(data, threshold, seeds)


def test_prefixes_hold_when_copies_are_adjacent(spark):
    """Order sorted by cluster, so that a prefix says nothing about the rest."""
    data = clusters(400, 4, 6, 5)
    ordered = [(i, h) for i, (_, h) in enumerate(sorted(data, key=lambda row: row[1]))]
    options = {"bucket_rows": 32, "min_comparisons": 1000, "comparisons_per_row": 1}
    assert dropped(spark, ordered, 10, **options) == greedy(ordered, 10)


def test_one_hash_holds_most_rows(spark):
    df = spark.range(20000).select(
        F.col("id").alias("ordinal"),
        F.when(F.col("id") % 3 > 0, H)
        .otherwise(F.lpad(F.hex(F.xxhash64("id")), 16, "0"))
        .alias("phash"),
    )
    kept = near_dedup(df)
    assert kept.where(F.col("phash") == H).count() == 1


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_long_chain(spark, coalesce):
    """Each hash is near its neighbours only, like frames of a slow pan; the chain
    lies in one range of the order, or crosses several."""
    value, rows = 0, []
    rng = random.Random(3)
    for i in range(40):
        rows.append((i, f"{value:016x}"))
        for bit in rng.sample(range(64), 7):
            value ^= 1 << bit
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, coalesce)
    try:
        assert dropped(spark, rows) == greedy(rows, 10)
    finally:
        spark.conf.unset(setting)


def test_sweep_across_batches():
    from framewright.operators.dedup import _sweep

    rows = [(1, 2, True), (2, 3, False), (3, 4, False), (2, 4, False), (9, 10, False), (1, 11, True), (9, 11, False)]
    for size in (1, 2, 3, 7):
        batches = (pd.DataFrame(rows[i : i + size], columns=["a", "b", "root"]) for i in range(0, 7, size))
        result = pd.concat(list(_sweep(batches)))
        kept = {n: None if pd.isna(k) else bool(k) for n, k in zip(result.node, result.kept)}
        assert kept == {2: False, 3: True, 4: False, 10: None, 11: False}


def test_pairs_and_marks(spark):
    data = clusters(200, 10, 9, 1)
    df = spark.createDataFrame(data, SCHEMA)
    firsts = {}
    for ordinal, text in data:
        firsts.setdefault(int(text, 16), ordinal)
    items = sorted((o, v) for v, o in firsts.items())
    expected = {
        (a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :]
        if bin(x ^ y).count("1") <= 10
    }
    assert {tuple(r) for r in near_pairs(df).collect()} == expected
    marks = {r.ordinal: r.is_duplicate for r in mark_duplicates(df).collect()}
    assert sorted(o for o, dup in marks.items() if dup) == greedy(data, 10)


@pytest.mark.parametrize("radius, width", [(0, 64), (1, 21), (4, 32), (5, 32), (6, 64), (10, 64)])
def test_cover_misses_nothing(radius, width):
    rng = random.Random(radius)
    masks = covering_masks(radius, width)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(masks)
    for _ in range(500):
        difference = sum(1 << b for b in rng.sample(range(width), radius))
        assert any(difference & mask == 0 for mask in masks)


def test_split_covers():
    rng = random.Random(0)
    for threshold in range(0, 14):
        for cover in (light_cover(threshold), deep_cover(threshold)):
            masks = [int(m) & (1 << 64) - 1 for m in cover]
            for _ in range(100):
                difference = sum(1 << b for b in rng.sample(range(64), threshold))
                assert any(difference & mask == 0 for mask in masks)


def test_pairs_need_a_cover(spark):
    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame([(0, H)], SCHEMA), 25)


@pytest.mark.parametrize("threshold", [-1, 0, 5, 24, 25, 27, 31, 40, 64, 70])
def test_any_threshold(spark, threshold, monkeypatch):
    monkeypatch.setattr(dedup, "WIDE_ROWS", 50)  # several blocks
    data = clusters(260, 120, 9, threshold) + [(5000, None), (5001, "zz")]
    seeds = [text for _, text in clusters(70, 40, 9, 99)]
    if threshold < 40:
        assert dropped(spark, data, threshold) == greedy(data, threshold)
        assert dropped(spark, data, threshold, seeds) == greedy(data, threshold, seeds)
    else:
        assert dropped(spark, data, threshold) == greedy(data, min(threshold, 64))


def test_more_seeds_than_rows_at_a_wide_threshold(spark, monkeypatch):
    monkeypatch.setattr(dedup, "WIDE_ROWS", 30)
    seeds = ["0" * 16] * 5 + [f"{i:016x}" for i in range(100)]  # all in one corner: most rows stay
    data = clusters(80, 60, 3, 5)
    assert dropped(spark, data, 26, seeds) == greedy(data, 26, seeds)


def first_neighbour(rows, threshold):
    seen, found = [], []
    for ordinal, text in sorted(rows):
        near = [first for first, value in seen if bin(int(text, 16) ^ value).count("1") <= threshold]
        if near:
            found.append((ordinal, min(near)))
        else:
            seen.append((ordinal, int(text, 16)))
    return found


@pytest.mark.parametrize(("threshold", "options"), [(0, {}), (10, {}), (10, {"bucket_rows": 8}), (24, {}), (26, {}), (33, {})])
def test_first_near(spark, threshold, options, monkeypatch):
    monkeypatch.setattr(dedup, "WIDE_ROWS", 40)
    data = clusters(300, 25, 9, threshold)
    found = first_near(spark.createDataFrame(data, SCHEMA), threshold, **options)
    assert sorted(tuple(r) for r in found.collect()) == first_neighbour(data, threshold)


def test_first_near_of_nothing(spark):
    assert first_near(spark.createDataFrame([], SCHEMA)).count() == 0
    assert first_near(spark.createDataFrame([(1, H), (2, None)], SCHEMA), 30).count() == 0


def test_links_of_each_record(spark):
    """A row per record: quadratic numbers of pairs are counted, block against block, and not listed."""
    data = clusters(300, 4, 6, 17) + [(5000, None), (5001, "zz"), (5002, H), (5003, H)]
    valid = sorted((o, int(h, 16)) for o, h in data if h and len(h) == 16)
    firsts = {}
    for ordinal, value in valid:
        firsts.setdefault(value, ordinal)
    expected = [
        (o, firsts[v], sum(0 < bin(v ^ other).count("1") <= 10 for other in firsts)) for o, v in valid
    ]
    df = spark.createDataFrame(data, SCHEMA)
    for block_rows in (None, 50):
        assert sorted(tuple(r) for r in near_links(df, block_rows=block_rows).collect()) == expected


@pytest.mark.parametrize("scan_pairs", [0, 8e12])
def test_crowds_are_scanned_up_to_a_size(spark, scan_pairs, monkeypatch):
    """Crowded tables are decided by scans, in several blocks; larger ones by covers and prefixes."""
    monkeypatch.setattr(dedup, "SCAN_PAIRS", scan_pairs)
    monkeypatch.setattr(dedup, "WIDE_ROWS", 60)
    calls = []
    scan = dedup._wide_survivors
    monkeypatch.setattr(dedup, "_wide_survivors", lambda *args: calls.append(1) or scan(*args))
    options = {"bucket_rows": 8, "min_comparisons": 2000, "comparisons_per_row": 1}
    data = clusters(300, 6, 8, 23)
    seeds = [h for _, h in data[::31]]
    assert dropped(spark, data, 10, **options) == greedy(data, 10)
    assert dropped(spark, data, 10, seeds, **options) == greedy(data, 10, seeds)
    assert bool(calls) == (scan_pairs > 0)
    found = first_near(spark.createDataFrame(data, SCHEMA), 10, **options)
    assert sorted(tuple(r) for r in found.collect()) == first_neighbour(data, 10)


def test_records_without_a_place_pass_a_scanned_crowd(spark):
    data = clusters(300, 3, 9, 11)
    df = spark.createDataFrame([*data, (None, H)], SCHEMA)
    kept = near_dedup(df, bucket_rows=8, min_comparisons=2000, comparisons_per_row=1)
    gone = set(greedy(data, 10))
    assert sorted(r[0] for r in kept.where("ordinal is not null").select("ordinal").collect()) == sorted({o for o, _ in data} - gone)
    assert kept.where("ordinal is null").count() == 1
