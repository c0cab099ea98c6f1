"""Nothing is lost where datasets, paths, names or writers meet."""

import json
import os

import pytest

from framewright import session
from framewright.operators.ordering import resolve_name_collision, split_sizes
from framewright.plans.curate import curate
from framewright.plans.maintain import merge_datasets, merge_records, refilter_marks
from framewright.session import materialize
from framewright.sinks import layouts
from framewright.sources import index
from framewright.sources.manifest import Manifest, PartitionedManifest


def test_merge_keeps_records_that_share_ids(spark, frame, tmp_path):
    rows = lambda side: frame(
        *[{"id": f"same-{i}", "source_id": str(i), "local_path": f"/{side}/{i}.png", "phash": None, "ordinal": i} for i in range(3)]
    )
    files = spark.createDataFrame([(f"file:/{s}/{i}.png", 1) for s in "ab" for i in range(3)], "path string, length bigint")
    for threshold in (None, 10):  # null hashes pass the removal of duplicates
        merged = merge_records(rows("a"), rows("b"), files, threshold).orderBy("ordinal").collect()
        assert len({r.id for r in merged}) == len({r.local_path for r in merged}) == 6
        assert [r.id for r in merged[:3]] == ["same-0", "same-1", "same-2"]
    a, b, out = (Manifest(spark, f"{tmp_path}/{n}") for n in "abo")
    a.write(rows("a"))
    b.write(rows("b"))
    counts = merge_datasets(a, b, out, str(tmp_path / "out"), files, None, copy=False)
    assert counts.accepted == out.count() == 6 and counts.missing == 0


def test_names_stay_distinct_where_the_replacement_is_taken(frame):
    names = ["x.png", "unsplash_1.png", "x.png", "x.png", "unsplash_1.png", "unsplash_2.png"]
    ids = ["0", "9", "1", "1", "2", "2"]
    rows = frame(*[{"source_id": i, "description": n, "ordinal": k} for k, (i, n) in enumerate(zip(ids, names, strict=True))])
    got = resolve_name_collision(rows.withColumnRenamed("description", "file_name")).orderBy("ordinal").collect()
    found = [r.file_name for r in got]
    assert found[:2] == names[:2] and found[5] == "unsplash_2.png" and len(set(found)) == 6
    assert all(n.endswith(".png") for n in found)


@pytest.mark.parametrize("prefix, listed", [("file:", "/"), ("file://", "file:/"), ("", "file:///")])
def test_paths_in_any_spelling(spark, frame, prefix, listed):
    rows = frame({"local_path": f"{prefix}/x/a.png", "width": None, "height": None})
    images = spark.createDataFrame(
        [(f"{listed}x/a.png", 50_000, 400, 300, 500.0, None)],
        "path string, length bigint, width int, height int, blur_score double, phash string",
    )
    assert [r.kept for r in refilter_marks(rows, images).collect()] == [True]
    run = curate(rows, rows.limit(0), images, ["unsplash"], {"min_width": 100}, dedup_threshold=None)
    assert [r.outcome for r in run.collect()] == ["accepted"]


@pytest.mark.parametrize("threshold", [None, 10])
def test_repeated_candidates_are_resumed(spark, frame, threshold):
    rows = frame(
        *[{"id": str(i), "source_id": s, "local_path": f"/x/{s}.png", "ordinal": i} for i, s in enumerate("aabca")],
        {"id": "5", "source_id": "", "local_path": None, "ordinal": 5},
        {"id": "6", "source_id": "", "local_path": None, "ordinal": 6},
    )
    images = spark.createDataFrame(
        [("/x/a.png", 9, 400, 300, 500.0, "0" * 16), ("/x/b.png", 9, 400, 300, 500.0, "f" * 16)],
        "path string, length bigint, width int, height int, blur_score double, phash string",
    )
    run = curate(rows, rows.limit(0), images, ["unsplash"], dedup_threshold=threshold).orderBy("ordinal").collect()
    assert [r.outcome for r in run] == [
        "accepted", "skipped_existing", "accepted", "failed_download", "skipped_existing", "failed_download", "failed_download",
    ]


def test_exports_keep_their_order(spark, frame, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [{"id": str(i), "source_id": str(i), "local_path": f"/x/{i}.png", "ordinal": i} for i in range(200)]
        records = frame(*rows).repartition(7)
        files = spark.createDataFrame([(f"/x/{i}.png", 1) for i in range(200)], "path string, length bigint")
        layouts.write_raw(records, f"{tmp_path}/raw", files, copy=False)
        layouts.write_csv(records, f"{tmp_path}/csv")
        layouts.write_raw(records, f"{tmp_path}/one", files, copy=False, single_file=True)
        layouts.write_coco(records, f"{tmp_path}/coco", files, copy=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def lines(folder):
        parts = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        assert len(parts) > 1
        return [line for p in parts for line in open(f"{folder}/{p}")]

    wanted = [str(i) for i in range(200)]
    assert [json.loads(x)["id"] for x in lines(f"{tmp_path}/raw/metadata.jsonl")] == wanted
    assert [x.split(",")[0] for x in lines(f"{tmp_path}/csv/dataset.csv") if not x.startswith("id,")] == wanted
    assert [json.loads(x)["id"] for x in open(f"{tmp_path}/one/metadata.jsonl")] == wanted
    data = json.load(open(f"{tmp_path}/coco/annotations/instances.json"))
    assert [x["record_id"] for x in data["images"]] == wanted and [x["id"] for x in data["images"]] == list(range(1, 201))
    assert not [n for n in os.listdir(f"{tmp_path}/coco/annotations") if "part" in n and not n.startswith(".")]


def test_scratch_folder_off_a_single_machine(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_two_writers_keep_both_batches(spark, frame, tmp_path):
    manifest = Manifest(spark, f"{tmp_path}/m")
    manifest.write(frame({"id": "a", "source_id": "a"}))
    stage, raced = manifest._stage, []

    def overtaken(records):
        staged = stage(records)
        if not raced:
            raced.append(True)
            Manifest(spark, manifest.path).upsert(frame({"id": "b", "source_id": "b"}))
        return staged

    manifest._stage = overtaken
    manifest.upsert(frame({"id": "c", "source_id": "c"}))
    assert sorted(r.id for r in manifest.read().collect()) == ["a", "b", "c"]
    assert manifest.versions() == [1, 2, 3]
    assert sorted(r.ordinal for r in manifest.read().collect()) == [0, 1, 2]


def test_what_a_dead_writer_left_does_no_harm(spark, frame, tmp_path):
    manifest = Manifest(spark, f"{tmp_path}/m")
    os.makedirs(f"{manifest.path}/v00000001")
    open(f"{manifest.path}/claim-00000001", "w").close()
    open(f"{manifest.path}/v00000001/part-0.parquet", "w").close()
    manifest.write(frame({"id": "a"}))
    assert manifest.count() == 1 and manifest.versions() == [1]


def files_of(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_few_changed_ids_rewrite_few_partitions(spark, frame, tmp_path):
    table = PartitionedManifest(spark, f"{tmp_path}/p", 16)
    assert table.read().count() == 0 and table.remove_many(frame({"id": "x"})) == 0
    table.upsert(frame(*[{"id": str(i), "source_id": str(i), "ordinal": i} for i in range(400)]))
    before = files_of(tmp_path / "p")
    assert len({os.path.dirname(f) for f in before}) == 16
    again = PartitionedManifest(spark, f"{tmp_path}/p", 99)  # the first number of partitions holds
    again.upsert(frame({"id": "7", "source_id": "7", "description": "new", "ordinal": 3}, {"id": "new", "source_id": "n", "ordinal": 5}))
    after = files_of(tmp_path / "p")
    changed = {os.path.dirname(f) for f in before ^ after}
    assert 1 <= len(changed) <= 2
    assert sum(os.path.getsize(f) for f in after - before) < 0.3 * sum(map(os.path.getsize, after))
    rows = {r.id: r for r in again.read().collect()}
    assert len(rows) == 401 and rows["7"].description == "new" and (rows["7"].ordinal, rows["new"].ordinal) == (400, 402)
    # Repeating a batch that may have been committed in part gives the same rows.
    again.upsert(frame({"id": "7", "source_id": "7", "description": "new"}))
    assert again.read().count() == 401
    assert again.remove_many(frame({"id": "7"}, {"id": "none"}, {"id": "8"})) == 2 and again.read().count() == 399
    everything = materialize(again.read().select("id"), "ids")
    assert again.remove_many(everything) == 399 and again.read().count() == 0
    again.upsert(frame({"id": "1"}, {"id": "1", "ordinal": 4, "description": "last"}))
    assert [r.description for r in PartitionedManifest(spark, f"{tmp_path}/p").read().collect()] == ["last"]


def test_label_search_reads_its_folders_only(spark, tmp_path):
    classes = spark.createDataFrame([(f"/m/{i}", f"Thing {i}") for i in range(50)], "label_name string, display_name string")
    images = spark.createDataFrame([(str(i), "u") for i in range(200)], "image_id string, original_url string")
    labels = spark.createDataFrame([(str(i), f"/m/{i % 50}") for i in range(200)], "image_id string, label_name string")
    index.write_index(classes, images, labels, f"{tmp_path}/i")
    found = index.search_index(*index.read_index(spark, f"{tmp_path}/i"), "thing 7")
    assert sorted(r.image_id for r in found.collect()) == ["107", "157", "57", "7"]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 7, 10, 100, 1000])
@pytest.mark.parametrize("val, test", [(0.0, 0.0), (0.1, 0.0), (0.29, 0.1), (0.5, 0.5), (1.0, 1.0)])
def test_split_sizes(rows, val, test):
    train, v, t = split_sizes(rows, val, test)
    assert train + v + t == rows and min(train, v, t) >= 0
    assert (t > 0) == (test > 0 and rows > 0)
    assert v > 0 or val == 0 or rows - t == 0
