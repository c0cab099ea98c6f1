"""All pairs of near hashes: whole, each once, by covers and by blocks."""

import math

import pyarrow as pa
import pytest
from test_dedup import SCHEMA, clusters

from checks import curation_checks
from framewright.operators import dedup
from framewright.operators.dedup import near_pairs


def listed(rows, threshold):
    """The rule as a plain loop: the first ordinals of each two near hashes."""
    firsts = {}
    for ordinal, text in rows:
        if ordinal is not None and text is not None and len(text) == 16:
            firsts[int(text, 16)] = min(ordinal, firsts.get(int(text, 16), math.inf))
    return sorted(
        (a, b) for x, a in firsts.items() for y, b in firsts.items() if a < b and bin(x ^ y).count("1") <= threshold
    )


@pytest.mark.parametrize("threshold", [0, 4, 10, 24])
@pytest.mark.parametrize("options", [{}, {"bucket_rows": 1}, {"bucket_rows": 1, "block_rows": 40}])
def test_pairs_equal_the_plain_loop(spark, threshold, options, monkeypatch):
    monkeypatch.setattr(dedup, "_LEAST_BLOCK_ROWS", 100)
    scans = []
    scan = dedup._scanned_pairs
    monkeypatch.setattr(dedup, "_scanned_pairs", lambda *args: scans.append(1) or scan(*args))
    data = clusters(300, 4, 6, 31)
    # Equal hashes, hashes that are none or have no place, and places that come twice.
    data += [(4, data[0][1]), (2000, data[5][1]), (7000, None), (7001, "zz"), (None, f"{3:016x}")]
    data += [(o, f"{int(h, 16) ^ 1:016x}") for o, h in data[:20]]
    found = near_pairs(spark.createDataFrame(data, SCHEMA), threshold, **options)
    assert sorted(map(tuple, found.collect())) == listed(data, threshold)
    assert bool(scans) == ("bucket_rows" in options and threshold > 0)


def test_pairs_of_few_hashes_in_many_blocks(spark):
    """A block may be empty, and one that meets it is not compared with itself again."""
    data = [(1, f"{0:016x}"), (2, f"{1:016x}"), (3, f"{3:016x}")]
    hashes = dedup._hashes(spark.createDataFrame(data, SCHEMA), "phash", "ordinal")
    found = dedup._scanned_pairs(hashes, 10, 1)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (2, 3)]
    nothing = dedup._hashes(spark.createDataFrame([], SCHEMA), "phash", "ordinal")
    assert dedup._scanned_pairs(nothing, 10, 1).count() == 0


def test_a_group_of_near_copies_is_written_in_parts(monkeypatch):
    monkeypatch.setattr(dedup, "_PAIR_ROWS", 50)
    monkeypatch.setattr(dedup, "_CACHED_WORDS", 16)
    n = 100
    rows = pa.RecordBatch.from_pydict(
        {"bits": [1 << i % 50 for i in range(n)], "ordinal": [*range(n)], "side": pa.array([0] * n, pa.int32())}
    )
    parts = list(dedup._pairs_between(10)((pa.scalar(0), pa.scalar(0)), iter([rows])))
    assert max(p.num_rows for p in parts) < 50 + 16
    assert sorted((r["a"], r["b"]) for p in parts for r in p.to_pylist()) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_the_query_has_a_row_per_pair(spark, tmp_path):
    texts = ["a b c d e f", "a b c d e f g", "a b c d e f", "z y x w"]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = curation_checks.hash_pairs(spark, str(tmp_path))
    hashes = [(r.ordinal, r.phash) for r in curation_checks.hashed(spark, str(tmp_path)).collect()]
    assert found.columns == ["a", "b"]
    assert sorted(map(tuple, found.collect())) == listed(hashes, 10)
