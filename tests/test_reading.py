"""What is read from files: formats by content, empty files, broken pages, landing order, own gates."""

import json
import os

import numpy as np
import pytest
from conftest import write_png
from pyspark.sql import functions as F

from framewright.functions.signatures import format_of
from framewright.operators.gates import Gate
from framewright.plans.curate import curate, remove_rejected_files
from framewright.schema import MANIFEST
from framewright.session import materialize
from framewright.sources.images import glob_pattern, image_signals, list_files, read_image_files
from framewright.sources.manifest import Manifest
from framewright.sources.providers import READERS, PAGE_SCHEMAS, HIT_PATHS, read_api_pages, read_records, read_rejected_pages, register
from framewright.streaming.ingest import incremental_ingest, unseen

NOISE = np.random.default_rng(7).integers(0, 256, (40, 40))


# Formats and listings


@pytest.mark.parametrize(
    ("head", "name"),
    [
        (b"\xff\xd8\xff\xe0rest", "JPEG"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"GIF87a", "GIF"), (b"GIF89a..", "GIF"),
        (b"BM....", "BMP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"RIFF\x01\x02\x03\x04WEBPVP8L", "WEBP"),
        (b"RIFF\x01\x02\x03\x04WAVE", None), (b"", None), (None, None), (b"\x89PNG", None), (b"text", None),
    ],
)
def test_format_of(spark, head, name):
    df = spark.createDataFrame([(head,)], "head binary")
    assert df.select(format_of(F.col("head"))).first()[0] == name


def test_format_is_that_of_the_content(spark, tmp_path):
    odd = tmp_path / "a b+c%20 d"
    odd.mkdir()
    write_png(odd / "p.jpg", NOISE)
    (odd / "w.png").write_bytes(b"RIFF\x01\x02\x03\x04WEBPVP8 ")
    (odd / "empty.jpg").write_bytes(b"")
    rows = {os.path.basename(r.path): r for r in image_signals(read_image_files(spark, str(tmp_path))).collect()}
    assert rows["p.jpg"].path == str(odd / "p.jpg")
    assert (rows["p.jpg"].format, rows["p.jpg"].width) == ("PNG", 40)
    assert (rows["w.png"].format, rows["w.png"].width) == ("WEBP", None)
    assert (rows["empty.jpg"].file_size_bytes, rows["empty.jpg"].format) == (0, None) and len(rows) == 3


def test_listing(spark, tmp_path):
    for name in ("a/b/c/1.png", "a/2.jpg", "3.png", "a/.hidden/4.png", "_x/5.png", "a/6.txt", "e mpty.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.startswith("e") else b"12")
    found = {(r.path, r.length) for r in list_files(spark, f"file://{tmp_path}", "*.{png,jpg}").collect()}
    assert found == {(f"{tmp_path}/{n}", 2) for n in ("a/b/c/1.png", "a/2.jpg", "3.png")} | {(f"{tmp_path}/e mpty.png", 0)}
    assert list_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    ("pattern", "name", "fits"),
    [("*", "x", True), ("*.p?g", "a.png", True), ("*.png", "aXpng", False), ("[ab]*", "bc", True), ("[!ab]*", "bc", False),
     ("{a,b}.c", "b.c", True), ("a,b", "a,b", True)],
)
def test_glob(pattern, name, fits):
    import re

    assert bool(re.fullmatch(glob_pattern(pattern), name)) == fits


# Curation of files


@pytest.fixture
def landed(spark, frame, tmp_path):
    write_png(tmp_path / "good.jpg", NOISE)
    write_png(tmp_path / "copy.jpg", NOISE)
    write_png(tmp_path / "flat.jpg", np.zeros((40, 40), int))
    write_png(tmp_path / "other.jpg", NOISE[::-1])
    (tmp_path / "empty.jpg").write_bytes(b"")
    names = ["good", "copy", "flat", "other", "empty", "missing"]
    rows = [
        {"id": n, "source_id": n, "local_path": f"{tmp_path}/{n}.jpg", "format": "said", "ordinal": i, "width": i}
        for i, n in enumerate(names)
    ]
    rows.append({"id": "again", "source_id": "again", "local_path": f"{tmp_path}/good.jpg", "ordinal": 9, "width": 9})
    return frame(*rows), read_image_files(spark, str(tmp_path), "*.jpg"), tmp_path


QUALITY = {"min_width": 8, "min_height": 8, "min_file_size": 1, "min_sharpness": 10.0}


def test_gates_of_the_user(spark, landed):
    candidates, images, path = landed
    seen = spark.createDataFrame([("other", 1)], "source_id string, banned int")
    gates = [
        Gate("list", (("never", F.lit(True), F.lit("replaced")),)),
        Gate("width", (("nine", F.col("width") == 9, F.format_string("width %d", "width")), ("null", F.lit(None) == 1, F.lit("")))),
        Gate("list", (("banned", F.col("banned") == 1, F.lit("banned")),), lambda rows: rows.join(seen, "source_id", "left"), "failed_list"),
    ]
    run = materialize(curate(candidates, spark.createDataFrame([], MANIFEST), images, ["unsplash"], QUALITY, gates=gates), "run")
    rows = {r.source_id: r for r in run.collect()}
    assert {n: (r.outcome, r.reason.split("(")[0].strip()) for n, r in rows.items()} == {
        "good": ("accepted", ""),
        "copy": ("failed_dedup", "near-duplicate detected"),
        "flat": ("failed_quality", "quality: too blurry"),
        "other": ("failed_list", "list: banned"),
        "empty": ("failed_quality", "quality: file too small"),
        "missing": ("failed_download", rows["missing"].reason.split("(")[0].strip()),
        "again": ("failed_quality", "width: width 9"),
    }
    assert rows["good"].format == "PNG" and rows["missing"].format == "said"
    # The file of "again" is that of an accepted record, and stays.
    assert remove_rejected_files(run) == 4
    assert {p.name for p in path.glob("*.jpg")} == {"good.jpg"}
    assert remove_rejected_files(run) == 0


def test_pixels_are_shipped_once(spark):
    from framewright.plans.curate import landed_signals

    images = spark.createDataFrame([], "path string, length long, head binary, height int, width int, nChannels int, data binary")
    plan = landed_signals(images, 10.0, {"min_width": 8})._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line and "data" in line for line in plan.splitlines()) == 1
    assert plan.count("ArrowEvalPython") == 1


# Broken pages


def hit(number, **more):
    return {"id": f"h{number}", "width": 5, "height": 6, "links": {"html": "u"}, **more}


PAGES = [
    json.dumps({"results": [hit(1), hit(2)]}),
    json.dumps({"results": [hit(3), hit(4, description="cut {[\\\" é")]})[:-20],
    json.dumps({"results": [hit(5)]})[:15],
    json.dumps({"errors": ["rate limit"]}),
    json.dumps({"total": 1, "results": [hit(6, width="wide")]}),
    "",
    "garbage",
    json.dumps({"results": []}),
    json.dumps({"other": [[1], {"results": [hit(7)]}], "results": [hit(8), hit(9)]})[:-2],
    "[]",
    '{"results": [' + "[" * 5000,
]


def test_broken_pages(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text("\n".join(PAGES))
    pages = read_api_pages(spark, str(tmp_path / "pages"), "unsplash")
    kept = {r.source_id: r.width for r in read_records(pages, "unsplash", "q").collect()}
    assert kept == {"h1": 5, "h2": 5, "h3": 5, "h6": 0, "h8": 5, "h9": 5}
    rows = read_rejected_pages(spark, str(tmp_path / "pages"), "unsplash").orderBy("line").collect()
    assert [(r.reason, r.rescued_hits) for r in rows] == [
        ("not_json", 1), ("not_json", 0), ("no_hits", 0), ("wrong_type", 0), ("not_json", 0), ("not_json", 2),
        ("no_hits", 0), ("not_json", 0),
    ]
    assert all(r.file.endswith("1.json") for r in rows) and rows[1].page == PAGES[2]


def test_broken_map_of_pages(spark, tmp_path):
    info = {"imageinfo": [{"url": "u", "width": 3, "height": 4, "mime": "image/png", "extmetadata": {"LicenseShortName": {"value": "CC0"}}}]}
    page = json.dumps({"query": {"pages": {str(i): {"pageid": i, "title": "t", **info} for i in (7, 8)}}})
    (tmp_path / "1.json").write_text(page[: page.rindex("imageinfo")])
    pages = read_api_pages(spark, str(tmp_path), "wikimedia")
    assert [r.source_id for r in read_records(pages, "wikimedia", "q").collect()] == ["7"]


def test_registered_source_without_hits_path(spark, tmp_path):
    register("own", "items ARRAY<STRUCT<id STRING>>", lambda pages: pages)
    try:
        (tmp_path / "1.json").write_text('{"items":[{"id":"1"}]}\n{"items":[{"id":')
        assert [len(r["items"] or []) for r in read_api_pages(spark, str(tmp_path), "own").orderBy("place").collect()] == [1, 0]
        assert [r.reason for r in read_rejected_pages(spark, str(tmp_path), "own").collect()] == ["not_json"]
    finally:
        for known in (PAGE_SCHEMAS, READERS, HIT_PATHS):
            del known["own"]


# Ingest


def test_ingest_order_rejects_and_lost_files(spark, tmp_path):
    landing, state = tmp_path / "landing", str(tmp_path / "state")
    landing.mkdir()
    manifest = Manifest(spark, str(tmp_path / "manifest"))
    listing = [spark.createDataFrame([], "path string")]

    def ingest():
        incremental_ingest(
            spark, str(landing), manifest, "unsplash", state, "q", "set", files=lambda: listing[0], rejects=str(tmp_path / "bad")
        ).awaitTermination()
        return [r.source_id for r in manifest.iterate()]

    # Landing order is not the order of the ids; the second line of the second file is broken.
    (landing / "b.json").write_text(json.dumps({"results": [hit(5), hit(1)]}) + "\n" + json.dumps({"results": [hit(0), hit(8)]})[:-9])
    (landing / "a.json").write_text(json.dumps({"results": [hit(9)]}) + "\n" + json.dumps({"results": [hit(4), hit(9)]}))
    assert ingest() == ["h9", "h4", "h5", "h1", "h0"]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [(r.reason, r.rescued_hits) for r in bad] == [("not_json", 1)]
    # Files of all but h4 are there: it is picked up again, and goes to the end.
    path = F.concat(F.lit("img/"), "source_id")
    manifest.write(manifest.read().withColumn("local_path", path))
    listing[0] = manifest.read().where("source_id <> 'h4'").select(F.col("local_path").alias("path"))
    (landing / "c.json").write_text(json.dumps({"results": [hit(4), hit(5), hit(7)]}))
    assert ingest() == ["h9", "h5", "h1", "h0", "h4", "h7"]
    assert ingest() == ["h9", "h5", "h1", "h0", "h4", "h7"]


def test_unseen(spark, frame):
    rows = frame({"id": "1", "source_id": "1", "local_path": "x"}, {"id": "2", "source_id": "2", "local_path": None})
    files = spark.createDataFrame([("x",)], "path string")
    assert unseen(rows, rows).count() == 0
    assert [r.id for r in unseen(rows, rows, files).collect()] == ["2"]
