"""Files, manifests, whole runs and layouts on small real folders."""

import csv
import json
import os

import numpy as np
import pytest
from conftest import write_png
from pyspark.sql import functions as F

from framewright.functions.pixels import gray, laplacian_variance, perceptual_hash
from framewright.operators import aggregates
from framewright.plans.curate import accepted, curate, new_records
from framewright.plans.maintain import export, merge_datasets, refilter
from framewright.schema import MANIFEST
from framewright.sinks import files as sink_files
from framewright.sinks import layouts
from framewright.sources.images import image_signals, list_files, read_image_files
from framewright.sources.manifest import Manifest
from framewright.sources.providers import parse_pages, read_records, register
from framewright.streaming.ingest import incremental_ingest

FLAT = np.full((300, 400), 120)


def noise(seed, height=300, width=400):
    return np.random.default_rng(seed).integers(0, 256, (height, width))


# Pixels


def test_laplacian_by_hand():
    pixels = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 10]])
    padded = np.pad(pixels, 1, mode="reflect")
    values = [
        padded[i - 1, j] + padded[i + 1, j] + padded[i, j - 1] + padded[i, j + 1] - 4 * padded[i, j]
        for i in range(1, 4) for j in range(1, 4)
    ]
    assert laplacian_variance(pixels) == pytest.approx(np.var(values))
    assert laplacian_variance(FLAT) == 0 and laplacian_variance(np.ones((1, 1), dtype=int)) == 0


def test_perceptual_hash():
    assert perceptual_hash(FLAT) == "8000000000000000"
    image = noise(1)
    small_change = image.copy()
    small_change[:2, :2] = 0
    distance = bin(int(perceptual_hash(image), 16) ^ int(perceptual_hash(small_change), 16)).count("1")
    other = bin(int(perceptual_hash(image), 16) ^ int(perceptual_hash(noise(2)), 16)).count("1")
    assert distance <= 6 < other
    ramp = np.tile(np.arange(64) * 4, (64, 1))
    assert perceptual_hash(ramp) == perceptual_hash(np.kron(ramp, np.ones((2, 2), dtype=int)))


def test_gray_conversion():
    weights = (1868, 9617, 4899, 14)
    white = bytes([255] * 12)
    assert (gray(2, 2, 3, white, weights) == 255).all()
    assert gray(2, 2, 3, white[:-1], weights) is None and gray(-1, 2, 3, white, weights) is None


def test_image_files(spark, tmp_path):
    write_png(tmp_path / "flat.png", FLAT)
    write_png(tmp_path / "noise.png", noise(3))
    write_png(tmp_path / "color.png", np.stack([noise(4)] * 3, axis=2))
    (tmp_path / "broken.png").write_bytes(b"x" * 50)
    rows = {
        os.path.basename(r.path): r
        for r in image_signals(read_image_files(spark, str(tmp_path))).collect()
    }
    assert rows["flat.png"].blur_score == 0 and rows["flat.png"].width == 400
    assert rows["noise.png"].blur_score > 1000 and rows["noise.png"].format == "PNG"
    assert rows["noise.png"].phash == perceptual_hash(noise(3))
    assert rows["color.png"].phash == perceptual_hash(noise(4))
    assert rows["noise.png"].gray_variance == pytest.approx(noise(3).var())
    broken = rows["broken.png"]
    assert broken.file_size_bytes == 50 and broken.width is None and broken.phash is None


# Manifest


def test_upsert_remove_and_versions(spark, frame, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "manifest"))
    assert manifest.count() == 0
    manifest.upsert(frame(*[{"id": str(i), "source_id": str(i), "ordinal": i} for i in range(5)]))
    manifest.upsert(frame({"id": "1", "source_id": "1", "description": "updated", "phash": "ab"}))
    assert manifest.count() == 5
    assert [r.id for r in manifest.iterate()] == ["0", "2", "3", "4", "1"]
    assert manifest.lookup(id="1").first().description == "updated"
    assert manifest.lookup(source="unsplash", source_id="3").count() == 1
    assert [r.phash for r in manifest.known_hashes().collect()] == ["ab"]
    ids = spark.createDataFrame([("0",), ("2",), ("4",), ("none",)], "id string")
    assert manifest.remove_many(ids) == 3 and manifest.count() == 2
    assert manifest.remove_many(ids.limit(0)) == 0
    assert manifest.versions() == [1, 2, 3]
    manifest.vacuum(1)
    assert manifest.versions() == [3] and manifest.count() == 2


def test_incomplete_version_is_ignored(spark, frame, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "manifest"))
    manifest.write(frame({"id": "1"}))
    os.makedirs(tmp_path / "manifest" / "v00000002")
    assert manifest.count() == 1
    manifest.write(frame({"id": "1"}, {"id": "2"}))
    assert manifest.versions() == [1, 2] and manifest.count() == 2


# Runs


@pytest.fixture
def folder(spark, frame, tmp_path):
    """Four images: good, a copy of it, flat, and another good one; plus a missing file."""
    content = {"good": noise(1), "copy": noise(1), "flat": FLAT, "other": noise(2)}
    for name, pixels in content.items():
        write_png(tmp_path / f"{name}.png", pixels)
    names = [*content, "missing"]
    rows = [
        {"id": n, "source_id": n, "local_path": f"{tmp_path}/{n}.png", "ordinal": i} for i, n in enumerate(names)
    ]
    return frame(*rows), read_image_files(spark, str(tmp_path), "*.png"), tmp_path


def outcomes(df):
    return {r.source_id: r.outcome for r in df.collect()}


def test_curate_and_resume(spark, folder):
    candidates, images, path = folder
    quality = {"min_file_size": 100, "min_sharpness": 10.0}
    empty = spark.createDataFrame([], MANIFEST)
    run = curate(candidates, empty, images, ["unsplash"], quality)
    assert outcomes(run) == {
        "good": "accepted", "copy": "failed_dedup", "flat": "failed_quality", "other": "accepted",
        "missing": "failed_download",
    }
    good = run.where("source_id = 'good'").first()
    assert good.phash == perceptual_hash(noise(1)) and good.blur_score > 10 and good.file_size_bytes > 100
    assert accepted(run).count() == 2
    summary = aggregates.outcome_summary(run).first()
    assert (summary.accepted, summary.failed_quality, summary.failed_dedup, summary.total) == (2, 1, 1, 5)
    log = {r.source_id: r.reason for r in aggregates.failures(run).collect()}
    assert set(log) == {"flat", "missing"} and log["flat"].startswith("quality: too blurry")

    manifest = Manifest(spark, str(path / "manifest"))
    manifest.upsert(new_records(run))
    again = curate(candidates, manifest.read(), images, ["unsplash"], quality)
    assert outcomes(again) == {
        "good": "skipped_existing", "copy": "failed_dedup", "flat": "failed_quality",
        "other": "skipped_existing", "missing": "failed_download",
    }
    # Fetched again on request: not a duplicate of itself.
    forced = curate(candidates, manifest.read(), images, ["unsplash"], quality, skip_existing=False)
    assert outcomes(forced)["good"] == "accepted"


def test_curate_options(spark, folder):
    candidates, images, _ = folder
    empty = spark.createDataFrame([], MANIFEST)
    none = curate(candidates, empty, images, [], {"min_file_size": 0})
    assert {r.reason for r in none.collect()} == {"no source adapter found"}
    plain = curate(candidates, empty, images, ["z"], None, dedup_threshold=None)
    assert outcomes(plain) == {n: "accepted" for n in ("good", "copy", "flat", "other")} | {"missing": "failed_download"}


def test_curate_by_meaning(spark, folder):
    candidates, images, _ = folder
    images = images.withColumn(
        "embedding", F.when(F.contains("path", F.lit("other")), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    )
    queries = spark.createDataFrame([("golden retriever", [1.0, 0.0])], "query string, query_embedding array<double>")
    empty = spark.createDataFrame([], MANIFEST)
    run = curate(candidates, empty, images, ["a"], {"min_file_size": 0, "min_sharpness": 10.0}, queries)
    rows = {r.source_id: r for r in run.collect()}
    assert rows["other"].outcome == "failed_quality" and rows["other"].reason.startswith("clip: CLIP similarity 0.000")
    assert rows["flat"].reason.startswith("quality: too blurry") and rows["good"].outcome == "accepted"


def test_refilter(spark, folder):
    records, images, path = folder
    manifest = Manifest(spark, str(path / "manifest"))
    manifest.write(records)
    listing = images.join(
        image_signals(images).select("path", "blur_score", "phash"), "path"
    ).drop("data", "nChannels").withColumn("length", F.lit(20000))
    dry = refilter(manifest, listing, dry_run=True, keep_files=False, min_sharpness=10.0, dedup_threshold=10)
    assert dry == {"kept": 2, "removed": 3} and manifest.count() == 5 and (path / "flat.png").exists()
    done = refilter(manifest, listing, keep_files=False, min_sharpness=10.0, dedup_threshold=10)
    assert done == dry and sorted(r.id for r in manifest.read().collect()) == ["good", "other"]
    assert not (path / "flat.png").exists() and (path / "good.png").exists()


def test_merge(spark, frame, tmp_path):
    rows = {}
    for side, pixels in (("a", noise(1)), ("b", noise(2))):
        os.makedirs(tmp_path / side)
        write_png(tmp_path / side / "same.png", pixels)
        rows[side] = frame(
            {"id": side, "source_id": f"{side}001", "local_path": f"{tmp_path}/{side}/same.png", "phash": perceptual_hash(pixels)},
            {"id": f"{side}-gone", "source_id": "gone", "local_path": f"{tmp_path}/{side}/gone.png", "ordinal": 1},
        )
    copy = frame({"id": "b-copy", "source_id": "b002", "local_path": f"{tmp_path}/a/same.png", "phash": perceptual_hash(noise(1)), "ordinal": 2})
    a, b = Manifest(spark, str(tmp_path / "ma")), Manifest(spark, str(tmp_path / "mb"))
    a.write(rows["a"])
    b.write(rows["b"].unionByName(copy))
    out = Manifest(spark, str(tmp_path / "mo"))
    files = list_files(spark, f"{tmp_path}/a").unionByName(list_files(spark, f"{tmp_path}/b"))
    counts = merge_datasets(a, b, out, str(tmp_path / "out"), files)
    assert (counts.accepted, counts.duplicates, counts.missing) == (2, 1, 2)
    assert sorted(os.listdir(tmp_path / "out" / "images")) == ["same.png", "unsplash_b001.png"]
    assert {r.id: os.path.basename(r.local_path) for r in out.read().collect()} == {"a": "same.png", "b": "unsplash_b001.png"}
    merged = Manifest(spark, str(tmp_path / "mp"))
    counts = merge_datasets(a, b, merged, str(tmp_path / "out2"), files, dedup_threshold=None, copy=False)
    assert counts.accepted == 3 and counts.duplicates == 0


# Layouts


@pytest.fixture
def dataset(spark, frame, tmp_path):
    os.makedirs(tmp_path / "src")
    rows = []
    for i in range(10):
        write_png(tmp_path / "src" / f"{i}.png", FLAT[:8, :8])
        rows.append({"id": str(i), "source_id": str(i), "local_path": f"{tmp_path}/src/{i}.png", "ordinal": i})
    os.remove(tmp_path / "src" / "3.png")
    return frame(*rows), list_files(spark, str(tmp_path / "src")), str(tmp_path / "out")


def test_raw(dataset):
    records, files, out = dataset
    layouts.write_raw(records, out, files, single_file=True)
    lines = [json.loads(line) for line in open(f"{out}/metadata.jsonl")]
    assert [x["id"] for x in lines] == [str(i) for i in range(10) if i != 3]
    assert lines[0]["local_path"] == "images/0.png" and len(lines[0]) == 22
    assert len([n for n in os.listdir(f"{out}/images") if n.endswith(".png")]) == 9


def test_raw_with_splits(dataset):
    records, files, out = dataset
    export(records, "raw", out, files, 0.2, 0.1, single_file=True)
    lines = [json.loads(line) for line in open(f"{out}/metadata.jsonl")]
    assert [x["split"] for x in lines] == ["train"] * 6 + ["val"] * 2 + ["test"]
    assert os.path.exists(f"{out}/images/test/9.png") and lines[-1]["local_path"] == "images/test/9.png"


def test_yolo(dataset):
    records, files, out = dataset
    layouts.write_yolo(records, out, files, 0.2, 0.1, ["dog", "cat"])
    assert sorted(os.listdir(f"{out}/labels/val")) == ["7.txt", "8.txt"]
    assert os.path.exists(f"{out}/images/test/9.png") and os.path.getsize(f"{out}/labels/test/9.txt") == 0
    text = open(f"{out}/dataset.yaml").read()
    assert "nc: 2" in text and "test: images/test" in text and '- "dog"' in text


def test_yolo_without_test_split(dataset):
    records, files, out = dataset
    export(records, "yolo", out, files, copy=False)
    assert sorted(n for n in os.listdir(f"{out}/labels")) == ["train", "val"]
    assert "test" not in open(f"{out}/dataset.yaml").read().replace(out, "")


def test_coco(dataset):
    records, files, out = dataset
    layouts.write_coco(records, out, files)
    data = json.load(open(f"{out}/annotations/instances.json"))
    assert set(data) == {"info", "licenses", "images", "annotations", "categories"}
    assert [x["id"] for x in data["images"]] == [1, 2, 3, 5, 6, 7, 8, 9, 10]
    assert data["images"][0]["file_name"] == "0.png" and data["images"][0]["license"] == "unsplash"


def test_coco_splits_and_parts(dataset, spark):
    records, files, out = dataset
    layouts.write_coco(records, out, files, 0.2, 0.1, copy=False)
    ids = {s: [x["id"] for x in json.load(open(f"{out}/annotations/{s}.json"))["images"]] for s in ("train", "val", "test")}
    assert ids == {"train": [1, 2, 3, 5, 6, 7], "val": [1, 2], "test": [1]}
    parts = layouts.coco_objects(records, files, object_images=4).orderBy("part").collect()
    assert [[x["id"] for x in json.loads(p.value)["images"]] for p in parts] == [[1, 2, 3], [5, 6, 7, 8], [9, 10]]


def test_coco_of_nothing(dataset):
    records, files, out = dataset
    layouts.write_coco(records.limit(0), out, files, 0.1, copy=False)
    assert json.load(open(f"{out}/annotations/val.json"))["images"] == []


def test_parquet(dataset, spark):
    records, files, out = dataset
    export(records, "huggingface", out, files, 0.2, 0.1)
    table = spark.read.parquet(out)
    assert len(table.columns) == 13 and {r.split for r in table.collect()} == {"train", "validation", "test"}
    assert table.count() == 9 and dict(table.dtypes)["width"] == "int"


def test_csv(dataset, frame):
    records, _, out = dataset
    extra = frame({"id": "q", "description": 'say "hi", twice\nand more', "tags": ["a", "b"], "ordinal": 99})
    layouts.write_csv(records.unionByName(extra), out, single_file=True)
    rows = list(csv.DictReader(open(f"{out}/dataset.csv", newline="")))
    assert len(rows) == 11 and len(rows[0]) == 22 and rows[0]["id"] == "0"
    assert rows[-1]["description"] == 'say "hi", twice\nand more' and json.loads(rows[-1]["tags"]) == ["a", "b"]
    layouts.write_csv(records.limit(0), f"{out}-empty")
    assert not os.path.exists(f"{out}-empty/dataset.csv")


def test_report_and_failures(dataset, spark):
    records, _, out = dataset
    layouts.write_report(records.withColumn("local_path", F.lit(None).cast("string")), f"{out}.csv", single_file=True)
    rows = list(csv.DictReader(open(f"{out}.csv")))
    assert len(rows) == 10 and list(rows[0])[0] == "id" and rows[0]["local_path"] == ""
    none = records.withColumns({"outcome": F.lit("failed_dedup"), "reason": F.lit("x")})
    layouts.write_failures(none, f"{out}-failures")
    assert not os.path.exists(f"{out}-failures")


def test_unknown_format(dataset):
    with pytest.raises(ValueError):
        export(dataset[0], "tfrecord", dataset[2])


def test_copies(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    plan = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/x/b"), (f"{tmp_path}/a", f"{tmp_path}/a")], "src string, dst string")
    assert {r.state: r.files for r in sink_files.copy_files(plan).collect()} == {"copied": 1, "same": 1}
    assert os.listdir(tmp_path / "x") == ["b"]
    with pytest.raises(OSError):
        sink_files.copy_files(spark.createDataFrame([(f"{tmp_path}/none", f"{tmp_path}/y")], "src string, dst string"))


# Pages


UNSPLASH = {
    "results": [
        {"id": "ph001", "width": 1920, "height": 1080, "description": "Golden retriever",
         "urls": {"regular": "https://i/r.jpg", "full": "https://i/f.jpg"}, "links": {"html": "https://u/ph001"},
         "user": {"name": "Alice Smith", "links": {"html": "https://u/alice"}},
         "tags": [{"title": "dog"}, {"title": "retriever"}]}
    ]
}
PEXELS = {"photos": [{"id": 42, "url": "https://p/42", "photographer": "Bob Jones", "width": 1600, "height": 900,
                      "alt": "A labrador", "src": {"large2x": "https://p/l.jpg"}}]}
PIXABAY = {"hits": [{"id": 777, "pageURL": "https://x/777", "largeImageURL": "https://x/l.jpg", "imageWidth": 1280,
                     "imageHeight": 720, "tags": "cat, kitten, feline", "user": "carol", "user_id": 5}]}


def wiki(pageid, name, mime="image/jpeg", artist="<a href='x'>Dan</a> "):
    return {"pageid": pageid, "title": f"File:A b {pageid}.jpg", "imageinfo": [
        {"url": f"https://w/{pageid}.jpg", "width": 10, "height": 20, "mime": mime,
         "extmetadata": {"LicenseShortName": {"value": name}, "Artist": {"value": artist}}}]}


def page(spark, source, body, **options):
    df = spark.createDataFrame([(json.dumps(body),)], "page string")
    return read_records(parse_pages(df, source), source, "find", **options).collect()


def test_provider_pages(spark):
    (row,) = page(spark, "unsplash", UNSPLASH)
    assert (row.source_id, row.width, row.tags, row.query) == ("ph001", 1920, ["dog", "retriever"], "find")
    assert row.attribution == "Photo by Alice Smith on Unsplash" and row.download_url == "https://i/r.jpg"
    (row,) = page(spark, "pexels", PEXELS)
    assert (row.source_id, row.download_url, row.description, row.tags) == ("42", "https://p/l.jpg", "A labrador", [])
    (row,) = page(spark, "pixabay", PIXABAY)
    assert row.tags == ["cat", "kitten", "feline"] and row.photographer_url == "https://pixabay.com/users/carol-5/"
    assert page(spark, "pexels", {}) == [] and page(spark, "pexels", {"photos": []}) == []


def test_wikimedia_pages(spark):
    pages = {
        "100": wiki(100, "CC0"), "200": wiki(200, "CC-BY-SA 4.0"), "300": wiki(300, "CC BY 4.0"),
        "400": wiki(400, "CC-BY-NC 4.0"), "-1": wiki(-1, "CC0"), "500": wiki(500, "CC0", "video/ogg"),
        "600": {"pageid": 600, "title": "File:x", "imageinfo": []},
    }
    body = {"query": {"pages": pages}}
    rows = {r.source_id: r for r in page(spark, "wikimedia", body)}
    assert {k: r.license_type for k, r in rows.items()} == {"100": "CC0-1.0", "400": "CC-BY-4.0"}
    assert rows["100"].photographer == "Dan" and rows["100"].description == "A b 100.jpg"
    assert rows["100"].url == "https://commons.wikimedia.org/wiki/File:A_b_100.jpg"
    assert {r.source_id for r in page(spark, "wikimedia", body, include_cc_by_sa=True)} == {"100", "200", "400"}
    assert {r.source_id for r in page(spark, "wikimedia", body, strict=True)} == {"100", "300"}


def test_ranked_pages_to_candidates(spark, tmp_path):
    """Two landed pages, the second repeating a hit, searched together with a second source."""
    from framewright.plans.search import search_all
    from framewright.sources.providers import rank_hits, read_api_pages

    def photos(*ids):
        return json.dumps({"photos": [{**PEXELS["photos"][0], "id": i} for i in ids]})

    (tmp_path / "pexels").mkdir()
    (tmp_path / "pexels" / "page-0001.json").write_text(photos(9, 4))
    (tmp_path / "pexels" / "page-0002.json").write_text(photos(4, 7, 1) + "\n" + photos(2))
    (tmp_path / "unsplash").mkdir()
    (tmp_path / "unsplash" / "page-0001.json").write_text(json.dumps(UNSPLASH))
    hits = {
        s: rank_hits(read_records(read_api_pages(spark, str(tmp_path / s), s), s, "dogs"))
        for s in ("pexels", "unsplash")
    }
    ranks = {r.source_id: r.rank for r in hits["pexels"].collect()}
    assert ranks == {"9": 0, "4": 1, "7": 2, "1": 3, "2": 4}
    found = search_all(hits, 7, "named").orderBy("ordinal").collect()
    assert [(r.source, r.source_id) for r in found] == [
        ("pexels", "9"), ("pexels", "4"), ("pexels", "7"), ("pexels", "1"), ("unsplash", "ph001"),
    ]


def test_registered_source(spark):
    def reader(pages):
        return pages.select(F.explode("found").alias("source_id"), "query")

    register("own", "found ARRAY<STRING>", reader)
    assert [r.source_id for r in page(spark, "own", {"found": ["a", "b"]})] == ["a", "b"]


def test_incremental_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    os.makedirs(landing)
    manifest = Manifest(spark, str(tmp_path / "manifest"))

    def run():
        incremental_ingest(spark, str(landing), manifest, "pexels", str(tmp_path / "state"), "dogs").awaitTermination()

    (landing / "1.json").write_text(json.dumps(PEXELS) + "\n" + json.dumps(PEXELS) + "\n")
    run()
    assert [(r.source_id, r.query) for r in manifest.read().collect()] == [("42", "dogs")]
    more = {"photos": PEXELS["photos"] + [{**PEXELS["photos"][0], "id": 43}]}
    (landing / "2.json").write_text(json.dumps(more) + "\n")
    run()
    run()
    assert [r.source_id for r in manifest.iterate()] == ["42", "43"]
