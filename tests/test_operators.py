import json

import pytest
from pyspark.sql import functions as F

from framewright.functions import text
from framewright.functions.licenses import license_from_url, resolve_license
from framewright.functions.vectors import cosine_similarity
from framewright.operators import aggregates, gates, joins, ordering, sets
from framewright.plans.search import search_all


def column(spark, values, expression, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_file_extension(spark):
    urls = ["https://a/b/p.PNG?w=1", "https://a/p.jpeg", "https://a/p.tiff", "https://a/p", "x.webp", "a.b/c"]
    assert column(spark, urls, text.file_extension(F.col("x"))) == [
        ".png", ".jpg", ".jpg", ".jpg", ".webp", ".jpg",
    ]
    formats = ["JPEG", "jpg", "PNG", "webp", "", "tiff"]
    assert column(spark, formats, text.file_extension(F.lit("a/b.gif"), F.col("x"))) == [
        ".jpg", ".jpg", ".png", ".webp", ".gif", ".gif",
    ]


def test_names(spark):
    names = ["a.tar.gz", "b", ".hidden", "c.png"]
    assert column(spark, names, text.stem(F.col("x"))) == ["a.tar", "b", ".hidden", "c"]
    assert column(spark, names, text.suffix(F.col("x"))) == [".gz", "", "", ".png"]
    paths = ["file:/x/a.png", "file:///x/a.png", "/x/a.png"]
    assert set(column(spark, paths, text.normalize_path(F.col("x")))) == {"/x/a.png"}


def test_license_short_names(spark):
    names = ["CC0", "Public domain", "CC-BY-SA 4.0", "CC-BY 4.0", "CC BY 4.0", "CC-BY-NC 4.0", "CC-BY 3.0", "", None]
    kind = lambda **options: column(
        spark, names, resolve_license(F.col("x"), **options).license_type
    )
    base = ["CC0-1.0", "CC0-1.0", None, "CC-BY-4.0", None, "CC-BY-4.0", "CC-BY-4.0", None, None]
    assert kind() == base
    assert kind(include_cc_by_sa=True) == base[:2] + ["CC-BY-SA-4.0"] + base[3:]
    assert kind(strict=True) == ["CC0-1.0", "CC0-1.0", None, "CC-BY-4.0", "CC-BY-4.0", None, None, None, None]


def test_license_urls(spark):
    urls = ["http://x/by/2.0/", "http://x/BY/4.0/", "http://x/publicdomain/zero/1.0", "http://cc0", "other", None]
    assert column(spark, urls, license_from_url(F.col("x"))) == [
        "CC-BY-2.0", "CC-BY-4.0", "CC0-1.0", "CC0-1.0", "CC-BY-2.0", "CC-BY-2.0",
    ]


@pytest.mark.parametrize(
    "values, code",
    [
        ({"local_path": None}, "no_local_file"),
        ({"local_path": ""}, "no_local_file"),
        ({"file_exists": False}, "file_not_found"),
        ({"file_size_bytes": 5}, "file_too_small"),
        ({"width": None}, "invalid_image"),
        ({"width": 50, "height": 300}, "width"),
        ({"width": 400, "height": 50}, "height"),
        ({"width": 1600, "height": 300}, "aspect_ratio"),
        ({"width": 1024, "height": 256}, ""),
        ({"blur_score": 99.9}, "too_blurry"),
        ({"blur_score": 100.0}, ""),
        ({"blur_score": None}, ""),
        ({"file_size_bytes": 10240, "width": 256, "height": 256}, ""),
    ],
)
def test_quality_gate(spark, values, code):
    row = {"local_path": "/a.png", "file_exists": True, "file_size_bytes": 20000, "width": 400,
           "height": 300, "blur_score": 500.0, **values}
    schema = "local_path string, file_exists boolean, file_size_bytes bigint, width int, height int, blur_score double"
    result = gates.quality_gate(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert result.reason_code == code
    assert bool(result.reason) == bool(code)


def test_reason_text(spark):
    schema = "local_path string, file_exists boolean, file_size_bytes bigint, width int, height int, blur_score double"
    df = spark.createDataFrame([("/a", True, 20000, 1600, 300, None), ("/a", True, 5, 1, 1, None)], schema)
    reasons = [r.reason for r in gates.quality_gate(df).collect()]
    assert reasons == ["aspect ratio 5.33 > 4.0", "file too small (5 < 10240)"]


def test_semantic_gate(spark):
    rows = [("a", "q", [1.0, 0.0]), ("b", "q", [0.0, 1.0]), ("c", "q", None), ("d", "other", [0.0, 1.0]),
            ("e", "q", [1.0]), ("f", "q", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, query string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, query_embedding array<float>")
    codes = {r.id: r.reason_code for r in gates.semantic_gate(df, queries, path=None, exists=None).collect()}
    assert codes == {"a": "", "b": "semantic", "c": "", "d": "", "e": "", "f": ""}


def test_semantic_gate_equality_passes_and_missing_file_rejects(spark):
    df = spark.createDataFrame(
        [("a", "q", [3.0, 4.0], "/a", True), ("b", "q", [3.0, 4.0], None, True), ("c", "q", [3.0, 4.0], "/c", False)],
        "id string, query string, embedding array<double>, local_path string, file_exists boolean",
    )
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, query_embedding array<double>")
    codes = {r.id: r.reason_code for r in gates.semantic_gate(df, queries, 0.6).collect()}
    assert codes == {"a": "", "b": "no_local_file", "c": "file_not_found"}


def test_cosine_of_mixed_lengths(spark):
    df = spark.createDataFrame(
        [([1.0, 1.0], [1.0, 0.0]), ([1.0], [2.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])],
        "a array<double>, b array<double>",
    )
    values = [r[0] for r in df.coalesce(1).select(cosine_similarity("a", "b")).collect()]
    assert values[0] == pytest.approx(0.5**0.5) and values[1] == 1.0 and values[2:] == [None, None, None]


@pytest.mark.parametrize(
    "n, val, test, sizes",
    [
        (0, 0.1, 0.1, (0, 0, 0)), (10, 0, 0, (10, 0, 0)), (10, 0.2, 0, (8, 2, 0)), (10, 0.2, 0.1, (7, 2, 1)),
        (3, 0.1, 0, (2, 1, 0)), (1000, 0.1, 0.05, (850, 100, 50)), (100, 0.29, 0, (72, 28, 0)), (1, 0.1, 0.1, (0, 0, 1)),
    ],
)
def test_splits(spark, n, val, test, sizes):
    assert ordering.split_sizes(n, val, test) == sizes
    df = spark.range(n).select((F.col("id") * F.col("id")).alias("ordinal"))
    counts = {r.split: r["count"] for r in ordering.assign_split(df, val, test).groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == sizes
    if n == 10 and test:
        order = [r.split for r in ordering.assign_split(df, val, test).orderBy("ordinal").collect()]
        assert order == ["train"] * 7 + ["val"] * 2 + ["test"]


def test_order_statistics_over_the_whole_range(spark):
    values = [-(2**63), -5, 0, 7, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert ordering.order_statistics(df, "x", range(6)) == values


def test_positions_within_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("v")
    )
    rows = ordering.with_position(df, ["v"], within=["k"], name="p").where("k = 'hot'").orderBy("v").collect()
    assert [r.p for r in rows] == list(range(len(rows)))


def test_quotas(spark):
    assert ordering.quotas(["a", "b", "c"], 11) == {"a": 4, "b": 4, "c": 3}
    rows = [("q", s, i) for s in "ab" for i in range(5)] + [("q", "c", 0)]
    df = spark.createDataFrame(rows, "query string, source string, rank int")
    kept = ordering.source_quota(df, ["a", "b", "c"], 11).groupBy("source").count()
    assert {r.source: r["count"] for r in kept.collect()} == {"a": 4, "b": 4, "c": 1}


def test_winners(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "id string, ordinal bigint, v string")
    assert {tuple(r) for r in ordering.first_wins(df, ["id"]).collect()} == {("a", 1, "x"), ("b", 5, None)}
    assert {tuple(r) for r in ordering.last_wins(df, ["id"]).collect()} == {("a", 2, "y"), ("b", 5, None)}


def test_frequency_ties_by_first_appearance(spark, frame):
    df = frame(*[{"source": s, "ordinal": i} for i, s in enumerate(["b", "a", "a", "b", "c"])])
    assert [(r.source, r["count"]) for r in aggregates.counts_by(df, "source").collect()] == [("b", 2), ("a", 2), ("c", 1)]


def test_page(spark):
    df = spark.range(25).select((F.col("id") * 10).alias("ordinal"))
    pages = [[r[0] // 10 for r in ordering.page(df, 10, n).orderBy("ordinal").collect()] for n in range(4)]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]


def test_info_ignores_zeros(frame):
    info = aggregates.dataset_info(frame({"width": 0, "height": 0}, {"width": 100, "height": 0}, {"width": 50, "height": 0})).first()
    assert (info.total, info.avg_width, info.min_width, info.avg_height) == (3, 75.0, 50, None)


def test_source_adapters(spark, frame):
    df = frame({"source": "a"}, {"source": "z"})
    assert [r.adapter for r in joins.record_source_join(df, ["b", "a"]).collect()] == ["a", "b"]
    assert [r.adapter for r in joins.record_source_join(df, []).collect()] == [None, None]
    with pytest.raises(ValueError):
        joins.allowed_sources(df, ["nowhere"], ["a"])


def test_json_round_trip(frame):
    df = frame({"id": "1", "tags": ["a", "b"], "phash": None, "description": 'say "é"\n'})
    line = df.select(text.record_to_json().alias("j")).first().j
    assert json.loads(line)["phash"] is None and len(json.loads(line)) == 22
    back = df.select(text.record_from_json(text.record_to_json()).alias("r")).select("r.*")
    assert back.drop("ordinal").first() == df.drop("ordinal").first()


def test_marked_files(spark, frame):
    files = spark.createDataFrame([("file:/x/a.png", 5)], "path string, length bigint")
    df = frame({"id": "a", "local_path": "/x/a.png"}, {"id": "b", "local_path": "/x/b.png"}, {"id": "c"})
    rows = {r.id: (r.file_exists, r.file_length) for r in gates.mark_files(df, files).collect()}
    assert rows == {"a": (True, 5), "b": (False, None), "c": (False, None)}
    assert [r.id for r in gates.has_file(df, files).collect()] == ["a"]


def test_union_keeps_order(frame):
    a = frame({"id": "a0", "ordinal": 4}, {"id": "a1", "ordinal": 9})
    b = frame({"id": "b0", "ordinal": 0}, {"id": "b1", "ordinal": 5})
    ids = [r.id for r in sets.union_datasets(a, b).orderBy("ordinal").collect()]
    assert ids == ["a0", "a1", "b0", "b1"]


def test_search_all(spark, frame):
    hits = {
        s: frame(*[{"id": f"{s}{i}", "source": s, "ordinal": i} for i in range(3)]).withColumnRenamed("ordinal", "rank")
        for s in ("b", "a")
    }
    found = search_all(hits, 3, "named").orderBy("ordinal").collect()
    assert [r.id for r in found] == ["b0", "b1", "a0"] and found[0].dataset_name == "named"
    with pytest.raises(ValueError):
        search_all({}, 3)


def test_scratch_is_shared_and_cleaned(spark, monkeypatch):
    import os

    from framewright import session

    monkeypatch.setattr(session, "_RUN", "run-of-a-test")
    table = session.materialize(spark.range(5).toDF("x"), "numbers")
    assert table.count() == 5
    root = session.shared_dir(spark).removeprefix("file:") + "/framewright/run-of-a-test"
    assert os.path.isdir(root)
    session.clean_scratch(spark)
    assert not os.path.exists(root)


@pytest.mark.parametrize("orders", [[0, 0, 1, 1, 2, 2, 3, 3, 4, 4], [1, 2, 2, 2, 2, 2, 2, 2, 2, 3], [0, 0, 2, 3, 4, 5, 6, 7, 8, 8]])
def test_splits_need_an_order(spark, orders):
    df = spark.createDataFrame([(i,) for i in orders], "ordinal bigint")
    with pytest.raises(ValueError, match="repeats"):
        ordering.assign_split(df, 0.1, 0.1)
    with pytest.raises(ValueError, match="null"):
        ordering.assign_split(df.limit(1).union(spark.sql("SELECT CAST(NULL AS BIGINT)")), 0.1, 0.1)


def test_repeats_that_cross_no_cut_do_no_harm(spark):
    df = spark.createDataFrame([(i,) for i in [0, 0, 0, 3, 4, 5, 6, 7, 8, 9]], "ordinal bigint")
    rows = ordering.assign_split(df, 0.1, 0.1).collect()
    assert sorted((r.ordinal, r.split) for r in rows)[-2:] == [(8, "val"), (9, "test")]
    assert sum(r.split == "train" for r in rows) == 8


def test_image_ids_need_an_order(spark):
    df = spark.createDataFrame([(5, "a", "x"), (9, "b", "x"), (2, "a", "y")], "ordinal bigint, split string, name string")
    rows = {(r.ordinal, r.image_id, r.name) for r in ordering.coco_image_id(df).collect()}
    assert rows == {(2, 1, "y"), (5, 2, "x"), (9, 1, "x")}
    for wrong in (5, None):
        with pytest.raises(ValueError, match="nulls or repeated"):
            ordering.coco_image_id(df.union(spark.createDataFrame([(wrong, "a", "z")], df.schema)))
