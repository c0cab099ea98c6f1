"""Work on existing datasets: refilter, merge, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import base_name, image_path, normalize_path, spread_missing
from framewright.operators.aggregates import distinct_ids
from framewright.operators.dedup import duplicate_ordinals, near_dedup
from framewright.operators.gates import has_file, passed, quality_gate
from framewright.operators.ordering import resolve_name_collision
from framewright.operators.sets import union_datasets
from framewright.schema import MANIFEST, ORDINAL
from framewright.session import materialize
from framewright.sinks import layouts
from framewright.sinks.files import copy_files, delete_files
from framewright.sources.manifest import Manifest


def refilter_marks(
    records: DataFrame,
    images: DataFrame,
    min_width: int = 256,
    min_height: int = 256,
    min_sharpness: float = 100.0,
    dedup_threshold: int | None = None,
) -> DataFrame:
    """Every record with ``kept`` and ``reason_code``.

    ``images`` lists the files with their decoded size and known signals (path,
    length, width, height, and optionally blur_score and phash, used where the
    record has none). Duplicates are looked for among records of good quality
    only, with no hashes known beforehand.
    """
    extra = [c for c in ("blur_score", "phash") if c in images.columns]
    listing = images.select(
        normalize_path(F.col("path")).alias("__path"),
        F.col("length").alias("__length"),
        F.col("width").alias("__width"),
        F.col("height").alias("__height"),
        *[F.col(c).alias(f"__{c}") for c in extra],
    )
    path = spread_missing(normalize_path(F.col("local_path")), F.col(ORDINAL))
    joined = records.join(listing, path == F.col("__path"), "left").withColumns(
        {
            "file_exists": F.col("__path").isNotNull(),
            "__blur": F.coalesce("blur_score", *[f"__{c}" for c in extra if c == "blur_score"]),
            "__hash": F.coalesce("phash", *[f"__{c}" for c in extra if c == "phash"]),
        }
    )
    gated = quality_gate(
        joined,
        min_width,
        min_height,
        min_sharpness=min_sharpness,
        size="__length",
        width="__width",
        height="__height",
        score="__blur",
    )
    marks = gated.select(*records.columns, "__hash", "reason_code")
    if dedup_threshold is not None:
        marks = materialize(marks, "marks")
        dropped = materialize(
            duplicate_ordinals(
                marks.where(passed()).select(ORDINAL, "__hash"), dedup_threshold, hash_col="__hash"
            ),
            "dropped",
        ).withColumn("__dup", F.lit(True))
        marks = marks.join(dropped, ORDINAL, "left").withColumn(
            "reason_code", F.when(F.col("__dup"), "duplicate").otherwise(F.col("reason_code"))
        )
    return marks.select(*records.columns, "reason_code", passed().alias("kept"))


def refilter(
    manifest: Manifest,
    images: DataFrame,
    dry_run: bool = False,
    keep_files: bool = True,
    **options,
) -> dict[str, int]:
    """Remove records that fail; a dry run only counts. Returns kept and removed.

    What is judged by is a few short columns; whole records are moved by the removal only.
    """
    judged = manifest.read().select("id", "local_path", "blur_score", "phash", ORDINAL)
    marks = materialize(refilter_marks(judged, images, **options), "marks")
    counts = {r["kept"]: r["count"] for r in marks.groupBy("kept").count().collect()}
    if not dry_run and counts.get(False):
        rejected = marks.where("not kept")
        manifest.remove_many(rejected)
        if not keep_files:
            delete_files(rejected.where("local_path <> ''").select(F.col("local_path").alias("path")))
    return {"kept": counts.get(True, 0), "removed": counts.get(False, 0)}


def merge_records(
    a: DataFrame, b: DataFrame, files: DataFrame, dedup_threshold: int | None = 10
) -> DataFrame:
    """A then B: files that exist, near-duplicates removed (A wins), distinct ids and names.

    A record keeps its id unless an earlier one has it. Adds ``source_path``; ``local_path`` is the new one below images/.
    """
    both = has_file(union_datasets(a, b), files)
    if dedup_threshold is not None:
        both = near_dedup(both, dedup_threshold)
    named = distinct_ids(both).withColumn("file_name", base_name(F.col("local_path")))
    renamed = resolve_name_collision(named)
    return renamed.withColumn("source_path", F.col("local_path")).withColumn(
        "local_path", image_path(F.col("file_name"))
    ).drop("file_name")


@dataclass
class MergeCounts:
    accepted: int
    duplicates: int
    missing: int


def merge_datasets(
    a: Manifest, b: Manifest, out: Manifest, out_dir: str, files: DataFrame,
    dedup_threshold: int | None = 10, copy: bool = True,
) -> MergeCounts:
    """Write the merged dataset and copy its images."""
    first, second = a.read(), b.read()
    merged = materialize(merge_records(first, second, files, dedup_threshold), "merged")
    target = F.concat_ws("/", F.lit(out_dir), "local_path")
    if copy:
        copy_files(merged.select(F.col("source_path").alias("src"), target.alias("dst")))
    out.upsert(merged.withColumn("local_path", target).select(*MANIFEST.names))
    total = first.count() + second.count()
    listed = has_file(first, files).count() + has_file(second, files).count()
    accepted = merged.count()
    return MergeCounts(accepted, listed - accepted, total - listed)


EXPORTERS = {
    "raw": layouts.write_raw,
    "yolo": layouts.write_yolo,
    "coco": layouts.write_coco,
    "parquet": layouts.write_parquet_dataset,
    "huggingface": layouts.write_parquet_dataset,
    "csv": lambda records, out, files=None, val_split=0.0, test_split=0.0, **options: (
        layouts.write_csv(records, out, **options)
    ),
}


def export(
    records: DataFrame, fmt: str, out: str, files: DataFrame | None = None,
    val_split: float = 0.1, test_split: float = 0.0, **options,
) -> None:
    """Write a dataset in one of the layouts, by name."""
    if fmt not in EXPORTERS:
        raise ValueError(f"unknown format {fmt!r}; choose from {', '.join(sorted(EXPORTERS))}")
    EXPORTERS[fmt](records, out, files, val_split=val_split, test_split=test_split, **options)
