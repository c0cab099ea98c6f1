"""Decisions are made on keys: whole records are not grouped, sorted or joined for them."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.plans import curate as curate_module
from framewright.plans import maintain as maintain_module
from framewright.schema import MANIFEST
from framewright.sources import images as image_source
from framewright.sources import manifest as manifest_module
from framewright.sources.manifest import Manifest
from framewright.streaming import ingest


def _records(spark, rows):
    """(id, source_id, description, ordinal) as records of the manifest."""
    given = [{f.name: None for f in MANIFEST.fields} | {"id": i, "source": "s", "source_id": k, "description": d, "ordinal": o} for i, k, d, o in rows]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in MANIFEST.fields])
    return spark.createDataFrame([[r[f.name] for f in MANIFEST.fields] for r in given], schema)


def test_an_upsert_groups_whole_rows_only_where_ids_repeat(spark, tmp_path, monkeypatch):
    manifest = Manifest(spark, f"file://{tmp_path}/m")
    grouped = []
    monkeypatch.setattr(manifest_module, "last_wins", lambda df, last=manifest_module.last_wins: grouped.append(1) or last(df))
    manifest.upsert(_records(spark, [("a", "1", "x", 0), ("b", "2", "y", 1), (None, "3", "z", 2)]))
    manifest.upsert(_records(spark, [("b", "2", "new", 7), ("c", "4", "w", 8)]))
    assert not grouped
    rows = [(r.id, r.description, r.ordinal) for r in manifest.read().orderBy("ordinal").collect()]
    assert rows == [("a", "x", 0), (None, "z", 2), ("b", "new", 3), ("c", "w", 4)]
    manifest.upsert(_records(spark, [("a", "1", "early", 0), ("a", "1", "late", 1), ("c", "4", "again", 2)]))
    assert grouped
    rows = [(r.id, r.description, r.ordinal) for r in manifest.read().orderBy("ordinal").collect()]
    assert rows == [(None, "z", 2), ("b", "new", 3), ("a", "late", 5), ("c", "again", 6)]


def test_landed_records_are_ordered_by_keys(spark, tmp_path, monkeypatch):
    sorted_columns = []

    def with_ordinal(df, *order, name, inner=ingest.with_ordinal):
        sorted_columns.append(df.columns)
        return inner(df, *order, name=name)

    monkeypatch.setattr(ingest, "with_ordinal", with_ordinal)
    page = lambda *ids: json.dumps({"results": [{"id": i, "description": f"about {i} on {n}"} for n, i in enumerate(ids)]})
    landing = tmp_path / "landing"
    landing.mkdir()
    manifest = Manifest(spark, f"file://{tmp_path}/m")
    expected = []
    for name, pages, new in (("a", [page("k", "j"), page("k", "i")], "kji"), ("b", [page("i", "h", "h"), page("g", "k")], "hg")):
        (landing / f"{name}.txt").write_text("\n".join(pages))
        ingest.incremental_ingest(
            spark, f"file://{landing}", manifest, "unsplash", f"file://{tmp_path}/state", "q"
        ).awaitTermination()
        expected += new
    assert [r.source_id for r in manifest.read().orderBy("ordinal").collect()] == expected
    told = {r.source_id: r.description for r in manifest.read().collect()}
    assert told == {"k": "about k on 0", "j": "about j on 1", "i": "about i on 1", "h": "about h on 1", "g": "about g on 0"}
    assert sorted_columns and all("description" not in columns for columns in sorted_columns)


def test_a_task_reads_many_small_images(spark):
    listed = spark.range(100_000).selectExpr("cast(id as string) path", "1000L length")
    assert image_source._scan_tasks(listed) == 98  # not 3125, of 32 files
    large = spark.range(640).selectExpr("cast(id as string) path", "64000000L length")
    assert image_source._scan_tasks(large) == -(-640 * 64_000_000 // (1 << 27))
    assert image_source._scan_tasks(listed.limit(3)) == 4 * spark.sparkContext.defaultParallelism


def test_a_run_writes_whole_records_once(spark, monkeypatch):
    written = []

    def materialize(df, name, *options, inner=curate_module.materialize):
        written.append("description" in df.columns)
        return inner(df, name, *options)

    monkeypatch.setattr(curate_module, "materialize", materialize)
    path = F.concat(F.lit("raster/"), "id", F.lit(".png"))
    rows = _records(spark, [("a", "1", "x", 0), ("b", "1", "y", 1), ("c", "2", "z", 2), ("d", "3", "w", 3)])
    candidates = rows.withColumn("local_path", path)
    known = _records(spark, [("d", "3", "kept", 0)]).withColumn("local_path", path)
    hashes = {"a": "0" * 16, "b": "0" * 8 + "f" * 8, "c": "0" * 15 + "1", "d": "f" * 8 + "0" * 8}
    images = spark.createDataFrame(
        [(f"raster/{i}.png", 5000, 64, 64, 9.0, h) for i, h in hashes.items()],
        "path string, length long, width int, height int, blur_score double, phash string",
    )
    found = curate_module.curate(candidates, known, images, sources=["s"])
    told = {r.id: (r.outcome, r.description) for r in found.collect()}
    assert told == {
        "a": ("accepted", "x"), "b": ("skipped_existing", "y"), "c": ("failed_dedup", "z"), "d": ("skipped_existing", "kept")
    }
    assert written.count(True) == 1


def test_a_refilter_judges_by_short_columns(spark, tmp_path, monkeypatch):
    written = []

    def materialize(df, name, *options, inner=maintain_module.materialize):
        written.append((name, "description" in df.columns))
        return inner(df, name, *options)

    monkeypatch.setattr(maintain_module, "materialize", materialize)
    hashes = {"a": "0" * 16, "b": "f" * 16, "c": "0" * 15 + "1", "e": "f" * 8 + "0" * 8}
    images = spark.createDataFrame(
        [(f"raster/{i}.png", 20_000, 640, 480, 1.0 if i == "b" else 900.0, h) for i, h in hashes.items()],
        "path string, length long, width int, height int, blur_score double, phash string",
    )
    rows = [("a", "1", "x", 0), ("b", "2", "blurry", 1), ("c", "3", "near a", 2), ("d", "4", "no file", 3), ("e", "5", "y", 4)]
    rows += [(None, "6", "no id", 5), ("e", "7", "no file, an id that is kept", 6)]
    records = _records(spark, rows).withColumn("local_path", F.concat(F.lit("raster/"), "id", F.lit(".png")))
    records = records.withColumn("local_path", F.when(F.col("ordinal") < 6, F.col("local_path")))
    manifest = Manifest(spark, f"file://{tmp_path}/m")
    manifest.write(records)
    counts = {"kept": 2, "removed": 5}
    assert maintain_module.refilter(manifest, images, dry_run=True, dedup_threshold=10) == counts
    assert maintain_module.refilter(manifest, images, dedup_threshold=10) == counts
    # Removal is by id: of two records of one id both go, and what has no id stays.
    left = [(r.id, r.description, r.phash) for r in manifest.read().orderBy("ordinal").collect()]
    assert left == [("a", "x", None), (None, "no id", None)]
    assert {name for name, _ in written} == {"marks", "dropped"} and not any(whole for _, whole in written)
