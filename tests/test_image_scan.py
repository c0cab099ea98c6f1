"""Image files are rows of a listing: the driver holds neither their names nor their sizes."""

import numpy as np
import pandas as pd
import pytest
from conftest import write_png
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks import sources_checks
from framewright.sources import images as image_source
from framewright.sources.images import image_signals, read_image_files

NOISE = np.random.default_rng(3).integers(0, 256, (40, 40))
COLOR = np.random.default_rng(4).integers(0, 256, (9, 30, 3))


def documents(spark, path):
    texts = ["one two three two", "", "four five", "six", "seven seven eight", "nine"]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{path}/documents.parquet"
    )
    return len(rows)


@pytest.mark.parametrize("query", ["image_formats", "image_files"])
def test_the_driver_has_no_index_of_the_files(spark, tmp_path, query):
    n = documents(spark, tmp_path)
    found = getattr(sources_checks, query)(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith((".jpg", ".png"))]
    assert found.count() == n


def test_pixels_are_those_of_the_image_source(spark, tmp_path):
    write_png(tmp_path / "gray.png", NOISE)
    write_png(tmp_path / "color.png", COLOR)
    (tmp_path / "none.png").write_bytes(b"no image")
    source = spark.read.format("image").load(str(tmp_path)).select(
        F.regexp_replace("image.origin", "^file:/+", "/").alias("path"),
        *[F.when(F.col("image.width") > 0, F.col(f"image.{c}")).alias(c) for c in ("height", "width", "nChannels", "data")],
    )
    ours = read_image_files(spark, str(tmp_path)).drop("length", "head")
    assert ours.columns == source.columns
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, source.collect()))


def test_files_are_read_once_and_not_for_a_listing(spark, tmp_path):
    write_png(tmp_path / "a.png", NOISE)
    images = read_image_files(spark, str(tmp_path))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    judged = plan(image_signals(images.where("width > 5")))
    assert judged.count("ArrowEvalPython [run(path") == 1 and judged.count("ImageSchema$") == 1
    assert "ArrowEvalPython" not in plan(images.select("path", "length"))


def test_names_are_those_that_spark_reads(spark, tmp_path):
    for name in ("a.png", "_b.png", ".c.png", "_k=v/d.png", "_x/e.png", "f.png._COPYING_", "sub/g.png", "h.jpg", "*.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        write_png(tmp_path / name, NOISE)
    (tmp_path / "broken_link.png").symlink_to(tmp_path / "nothing")

    def names(path, pattern="*"):
        return sorted(r.path[len(str(tmp_path)) + 1 :] for r in read_image_files(spark, str(path), pattern).collect())

    assert names(tmp_path) == ["*.png", "_k=v/d.png", "a.png", "h.jpg", "sub/g.png"]
    assert names(tmp_path, "*.{png,gif}") == ["*.png", "_k=v/d.png", "a.png", "sub/g.png"]
    assert names(tmp_path, r"\*.png") == ["*.png"]
    assert names(tmp_path / "{sub,h.jpg,s*}") == ["h.jpg", "sub/g.png"]
    assert names(f"file:{tmp_path}//sub/") == ["sub/g.png"]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_image_files(spark, str(tmp_path / "nowhere"))


def test_files_that_go(spark, tmp_path):
    write_png(tmp_path / "a.png", NOISE)
    (tmp_path / "broken.gif").write_bytes(b"GIF89a\x05\0")

    def read():
        write_png(tmp_path / "b.png", NOISE)
        images = read_image_files(spark, str(tmp_path))
        (tmp_path / "b.png").unlink()
        return sorted((r.path.rsplit("/")[-1], r.width) for r in images.collect())

    with pytest.raises(Exception, match="b.png"):
        read()
    for kind in ("Missing", "Corrupt"):
        spark.conf.set(f"spark.sql.files.ignore{kind}Files", "true")
        try:
            assert read() == [("a.png", 40), ("broken.gif", None)]
        finally:
            spark.conf.unset(f"spark.sql.files.ignore{kind}Files")


def test_a_folder_is_listed_in_parts(tmp_path, monkeypatch):
    for i in range(10):
        (tmp_path / f"{i}.png").write_bytes(b"12")
    monkeypatch.setattr(image_source, "LISTED_ROWS", 4)
    run = image_source._list_folders("*", image_source._hidden)
    parts = list(run(iter([pd.DataFrame({"path": [str(tmp_path)]})])))
    assert [len(p) for p in parts] == [4, 4, 2]
    assert sorted(pd.concat(parts)["path"]) == [f"{tmp_path}/{i}.png" for i in range(10)]
