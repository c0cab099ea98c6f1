"""The five dataset layouts and the failure log."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import base_name, record_to_json, stem
from framewright.operators.aggregates import (
    attribution_report,
    export_projection_coco,
    export_projection_parquet,
    failures,
)
from framewright.operators.ordering import assign_split, coco_image_id
from framewright.schema import ORDINAL, RECORD_COLUMNS
from framewright.session import materialize
from framewright.sinks.files import (
    copy_files,
    make_dirs,
    to_single_file,
    touch_files,
    with_image_file,
    write_text,
)


def _copies(records: DataFrame, out: str, *folders: str | Column) -> DataFrame:
    parts = [F.lit(f) if isinstance(f, str) else f for f in folders]
    return records.select(
        F.col("local_path").alias("src"),
        F.concat_ws("/", F.lit(out), *parts, base_name(F.col("local_path"))).alias("dst"),
    )


def _write_lines(lines: DataFrame, path: str, single_file: bool) -> None:
    """Text lines of (ordinal, value), in order within and across the part files."""

    def write(df, target):
        df.select("value").write.mode("overwrite").text(target)

    if single_file:
        to_single_file(lines, path, write, ORDINAL)
    else:
        write(lines.orderBy(ORDINAL), path)


def write_raw(
    records: DataFrame,
    out: str,
    files: DataFrame | None = None,
    val_split: float = 0.0,
    test_split: float = 0.0,
    copy: bool = True,
    single_file: bool = False,
) -> None:
    """images/ and metadata.jsonl; with splits, images/<split> and a split field."""
    spark = records.sparkSession
    splits = val_split > 0 or test_split > 0
    if splits:
        records = assign_split(records, val_split, test_split)
        make_dirs(spark, *[f"{out}/images/{s}" for s in ("train", "val", "test")])
    else:
        make_dirs(spark, f"{out}/images")
    valid = with_image_file(records, files)
    folder = F.concat(F.lit("images/"), "split") if splits else F.lit("images")
    if copy:
        copy_files(_copies(valid, out, folder))
    lines = valid.withColumn(
        "local_path", F.concat_ws("/", folder, base_name(F.col("local_path")))
    ).select(ORDINAL, record_to_json(("split",) if splits else ()).alias("value"))
    if splits and lines.isEmpty():
        return
    _write_lines(lines, f"{out}/metadata.jsonl", single_file)


def write_yolo(
    records: DataFrame,
    out: str,
    files: DataFrame | None = None,
    val_split: float = 0.1,
    test_split: float = 0.0,
    class_names: Sequence[str] | None = None,
    copy: bool = True,
) -> None:
    """images/<split>, an empty label file per image, and dataset.yaml."""
    spark = records.sparkSession
    names = list(class_names or ["object"])
    splits = ["train", "val"] + (["test"] if test_split > 0 else [])
    make_dirs(spark, *[f"{out}/{kind}/{s}" for kind in ("images", "labels") for s in splits])
    valid = with_image_file(assign_split(records, val_split, test_split), files)
    if copy:
        copy_files(_copies(valid, out, "images", F.col("split")))
    label = F.concat(stem(base_name(F.col("local_path"))), F.lit(".txt"))
    touch_files(
        valid.select(
            F.concat_ws("/", F.lit(out), F.lit("labels"), "split", label).alias("path")
        )
    )
    lines = ["names:", *[f"- {json.dumps(n)}" for n in names], f"nc: {len(names)}"]
    lines += [f"path: {json.dumps(out)}"]
    if test_split > 0:
        lines.append("test: images/test")
    lines += ["train: images/train", "val: images/val", ""]
    write_text(spark, f"{out}/dataset.yaml", "\n".join(lines))


def coco_objects(
    records: DataFrame,
    files: DataFrame | None = None,
    val_split: float = 0.0,
    test_split: float = 0.0,
    description: str = "dataset",
    id_key: str = "record_id",
    object_images: int = 50_000,
) -> DataFrame:
    """COCO objects as JSON text: (split, part, value).

    Image ids count within the split before files are checked, so they can have
    gaps. Each object holds the images of one id range of ``object_images``, and is
    complete by itself: a table of objects for readers in Spark. ``write_coco`` writes
    one object for each split, whatever its size.
    """
    if val_split > 0 or test_split > 0:
        records = assign_split(records, val_split, test_split)
    else:
        records = records.withColumn("split", F.lit("instances"))
    numbered = with_image_file(coco_image_id(records), files)
    image = export_projection_coco(id_key).alias("image")
    part = F.floor((F.col("image_id") - 1) / object_images).cast("int").alias("part")
    groups = (
        numbered.select("split", part, image)
        .groupBy("split", "part")
        .agg(F.sort_array(F.collect_list("image")).alias("images"))
    )
    return groups.select("split", "part", _coco_json(F.col("images"), description).alias("value"))


def _coco_json(images: Column, description: str) -> Column:
    now = datetime.datetime.now()
    info = F.struct(
        F.lit(description).alias("description"),
        F.lit("1.0").alias("version"),
        F.lit(now.year).alias("year"),
        F.lit(now.isoformat()).alias("date_created"),
    )
    empty = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            info.alias("info"),
            empty.alias("licenses"),
            images.alias("images"),
            empty.alias("annotations"),
            empty.alias("categories"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_coco(
    records: DataFrame,
    out: str,
    files: DataFrame | None = None,
    val_split: float = 0.0,
    test_split: float = 0.0,
    description: str = "dataset",
    id_key: str = "record_id",
    copy: bool = True,
) -> None:
    """images/ and annotations/<split>.json (instances.json without splits).

    Each file is one object with all images of its split in order, at any size; a
    split without images gets an object too.
    """
    spark = records.sparkSession
    splits = ["instances"]
    if val_split > 0 or test_split > 0:
        splits = ["train", "val"] + (["test"] if test_split > 0 else [])
    folders = [f"{out}/images" if s == "instances" else f"{out}/images/{s}" for s in splits]
    make_dirs(spark, f"{out}/annotations", *folders)
    placed, folder = records.withColumn("split", F.lit("instances")), ("images",)
    if splits != ["instances"]:
        placed, folder = assign_split(records, val_split, test_split), ("images", F.col("split"))
    valid = materialize(with_image_file(coco_image_id(placed), files), "coco")
    if copy:
        copy_files(_copies(valid, out, *folder))
    image = F.to_json(export_projection_coco(id_key), {"ignoreNullFields": "false"})
    firsts = {r["split"]: r["first"] for r in valid.groupBy("split").agg(F.min("image_id").alias("first")).collect()}
    shell = spark.range(1).select(_coco_json(F.array().cast("array<string>"), description)).first()[0]
    head, tail = shell.split('"images":[]')
    for split in splits:
        comma = F.when(F.col("image_id") > firsts.get(split, 0), ",").otherwise("")
        lines = valid.where(F.col("split") == split).select(
            F.col("image_id").alias(ORDINAL), F.concat(comma, image).alias("value")
        )
        to_single_file(
            lines,
            f"{out}/annotations/{split}.json",
            lambda df, target: df.select("value").write.mode("overwrite").text(target),
            ORDINAL,
            head=head + '"images":[\n',
            tail="]" + tail + "\n",
        )


def write_parquet_dataset(
    records: DataFrame,
    out: str,
    files: DataFrame | None = None,
    val_split: float = 0.0,
    test_split: float = 0.0,
) -> None:
    """Twelve typed columns as Parquet, partitioned by split (train, validation,
    test) when there are splits. Missing files are left out after splitting."""
    splits = val_split > 0 or test_split > 0
    if splits:
        records = assign_split(
            records, val_split, test_split, names=("train", "validation", "test")
        )
    valid = with_image_file(records, files)
    if splits:
        rows = export_projection_parquet(valid, "split")
        rows.write.mode("overwrite").partitionBy("split").parquet(out)
    else:
        export_projection_parquet(valid).write.mode("overwrite").parquet(out)


def write_csv(
    records: DataFrame, out: str, filename: str = "dataset.csv", single_file: bool = False
) -> None:
    """All 22 columns with a header; tags as a JSON array. Nothing when empty."""
    if records.isEmpty():
        return
    rows = records.select(
        *[F.to_json(c).alias(c) if c == "tags" else F.col(c) for c in RECORD_COLUMNS], ORDINAL
    )
    _write_csv(rows, f"{out}/{filename}", single_file)


def write_report(records: DataFrame, path: str, single_file: bool = False) -> None:
    """The attribution report as CSV."""
    _write_csv(attribution_report(records, ORDINAL), path, single_file)


def _write_csv(rows: DataFrame, path: str, single_file: bool) -> None:
    def write(df, target):
        writer = df.drop(ORDINAL).write.mode("overwrite")
        writer.option("header", not single_file).option("escape", '"').option("emptyValue", "").csv(target)

    if single_file:
        names = [c for c in rows.columns if c != ORDINAL]
        to_single_file(rows, path, write, ORDINAL, head=",".join(names) + "\n")
    else:
        write(rows.orderBy(ORDINAL), path)


def write_failures(outcomes: DataFrame, path: str) -> None:
    """One JSON line per failed row; nothing when there is none."""
    rows = failures(outcomes)
    if not rows.isEmpty():
        rows.write.mode("overwrite").json(path)
