"""Parts joined to one file by tasks."""

import json
import os

import pytest

from framewright.sinks.files import to_single_file
from framewright.sinks.layouts import write_coco


def write(df, target):
    df.select("value").write.mode("overwrite").text(target)


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_same_bytes_as_in_order(spark, tmp_path, rows):
    df = spark.range(rows).selectExpr("id AS ordinal", "concat('row é ', id) AS value").repartition(7)
    path = f"{tmp_path}/out/all.txt"
    os.makedirs(f"{tmp_path}/out")
    for _ in range(2):  # the second replaces the first
        to_single_file(df, path, write, "ordinal", "hé\n", "end\n")
    want = "hé\n" + "".join(f"row é {i}\n" for i in range(rows)) + "end\n"
    assert open(path, encoding="utf-8").read() == want
    assert [r.value for r in spark.read.text(path).collect()] == want.splitlines()  # no stale checksum
    assert [n for n in os.listdir(f"{tmp_path}/out") if not n.endswith(".crc")] == ["all.txt"]


def test_coco_object(spark, frame, tmp_path):
    records = frame(*[{"id": str(i), "source_id": str(i), "local_path": f"{i}.png", "ordinal": i} for i in range(25)])
    write_coco(records, str(tmp_path), val_split=0.2, copy=False)
    for split, count in (("train", 20), ("val", 5)):
        with open(tmp_path / "annotations" / f"{split}.json", encoding="utf-8") as file:
            assert len(json.load(file)["images"]) == count


def test_a_large_search_is_dealt_out_by_rows(spark, monkeypatch):
    """Ids that compress well do not end in a few tasks."""
    from pyspark.sql import functions as F

    from framewright.sources import index

    monkeypatch.setattr(index, "_ROWS_PER_TASK", 100)
    images = spark.range(8000).select(F.col("id").alias("image_id"), F.lit("u").alias("original_url"))
    labels = images.select("image_id", F.when(F.col("image_id") % 4 == 0, "R").otherwise("N").alias("label_name"))
    classes = spark.createDataFrame([("R", "Returned"), ("N", "New")], "label_name string, display_name string")
    found = index.search_index(classes, images, labels.unionByName(labels), "return")
    assert found.rdd.getNumPartitions() == 80
    assert sorted(r.image_id for r in found.collect()) == list(range(0, 8000, 4))
