"""The label index: class, image and label tables, and search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.licenses import license_from_url
from framewright.operators.aggregates import with_record_defaults
from framewright.operators.ordering import first_wins
from framewright.schema import CLASSES
from framewright.session import materialize
from framewright.sources.quoted_csv import read_quoted_csv

BUCKET, LABEL_BUCKETS = "label_bucket", 64
# Images or hits that one task of a search sorts.
_ROWS_PER_TASK = 250_000

# Column names of the image table's CSV and ours.
IMAGE_COLUMNS = {
    "ImageID": "image_id",
    "OriginalURL": "original_url",
    "Thumbnail300KURL": "thumbnail_url",
    "Author": "author",
    "AuthorProfileURL": "author_url",
    "License": "license_url",
    "Title": "title",
}


def _csv(spark: SparkSession, **options):
    reader = spark.read.option("quote", '"').option("escape", '"')
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader


def read_class_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV of label and display name; the first row of a label wins."""
    rows = _csv(spark, header=False).schema(CLASSES).csv(path)
    return _first_line(rows, ["label_name"])


def read_image_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of images: seven of its columns, missing values as empty text.

    Quoted titles may hold line breaks; a file is still read by a task per range.
    """
    rows = read_quoted_csv(spark, path)
    columns = [
        (F.coalesce(name, F.lit("")) if name in rows.columns else F.lit("")).alias(alias)
        for name, alias in IMAGE_COLUMNS.items()
    ]
    return first_wins(rows.select(*columns, "place"), ["image_id"], "place").drop("place")


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of labels: the pairs whose confidence is the text ``1``."""
    rows = _csv(spark, header=True, inferSchema=False).csv(path)
    return (
        rows.where(F.col("Confidence") == "1")
        .select(
            F.coalesce("ImageID", F.lit("")).alias("image_id"),
            F.coalesce("LabelName", F.lit("")).alias("label_name"),
        )
        .distinct()
    )


def _first_line(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key by place in the files: file name, block, then line."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return first_wins(rows.withColumn("place", place), keys, "place").drop("place")


def _label_bucket() -> Column:
    return F.pmod(F.xxhash64("label_name"), F.lit(LABEL_BUCKETS)).cast("int")


def class_search(classes: DataFrame, text: str) -> DataFrame:
    """Classes whose name contains the text, whatever the case.

    ``%`` and ``_`` in the text act as wildcards. A backslash stands for itself.
    """
    pattern = "%" + text.lower().replace("\\", "\\\\") + "%"
    return classes.where(F.lower("display_name").like(pattern))


def _select(images: DataFrame, hits: DataFrame, rows: int) -> DataFrame:
    """The images with a hit. Runs of ids compress so well that adaptive execution, which goes by
    bytes, would sort too many of them in one task: large tables are dealt out by their rows."""
    tasks = -(-rows // _ROWS_PER_TASK)
    if tasks > images.sparkSession.sparkContext.defaultParallelism:
        images, hits = images.repartition(tasks, "image_id"), hits.repartition(tasks, "image_id")
    return images.join(hits, "image_id", "left_semi")


def search_index(
    classes: DataFrame,
    images: DataFrame,
    image_labels: DataFrame,
    text: str,
    count: int | None = None,
) -> DataFrame:
    """Images that carry a matching class, each once, the first ``count`` by id.

    Two semi-joins, no DISTINCT over wide rows: matched classes thin out the
    label pairs, which then select images. Neither side is hinted; the matched
    classes are written first, and broadcast while they are small.
    """
    keys = [c for c in (BUCKET, "label_name") if c in image_labels.columns and c in classes.columns]
    matched = class_search(classes, text).select(*keys)
    if BUCKET not in keys:
        # Classes of unknown size would shuffle the labels by class, a frequent one into one task.
        matched = materialize(matched, "classes")
    hits = image_labels.join(matched, keys, "left_semi").select("image_id")
    found = _select(images.where(F.col("original_url") != ""), hits, max(hits.count(), images.count()))
    return found if count is None else found.orderBy("image_id").limit(count)


def normalize_index(images: DataFrame, query: str, strict: bool = False) -> DataFrame:
    """Index images to records. ``strict`` drops images of unknown license."""
    license_type = license_from_url(F.col("license_url"), strict)
    rows = images.withColumn("license_type", license_type).where("license_type is not null")
    credit = F.when(
        F.col("author") != "",
        F.concat(
            F.lit("Photo by "), "author", F.lit(" (Open Images, "), "license_type", F.lit(")")
        ),
    ).otherwise(F.concat(F.lit("Open Images Dataset ("), "license_type", F.lit(")")))
    return with_record_defaults(
        rows.select(
            F.lit("openimages").alias("source"),
            F.col("image_id").alias("source_id"),
            F.concat(F.lit("https://www.flickr.com/photos/"), "image_id").alias("url"),
            F.col("original_url").alias("download_url"),
            "license_type",
            "license_url",
            F.col("author").alias("photographer"),
            F.col("author_url").alias("photographer_url"),
            credit.alias("attribution"),
            F.lit(0).alias("width"),
            F.lit(0).alias("height"),
            F.array(F.lit(query)).alias("tags"),
            F.col("title").alias("description"),
            F.lit(query).alias("query"),
        )
    )


def write_index(
    classes: DataFrame, images: DataFrame, image_labels: DataFrame, path: str
) -> None:
    """One-time Parquet form of the index. Label pairs lie in folders by a hash of their
    label, and classes carry the same number, so that a search reads only the folders
    of the labels it has found (pruned at run time)."""
    classes.withColumn(BUCKET, _label_bucket()).write.parquet(f"{path}/classes")
    images.write.parquet(f"{path}/images")
    # Range partitioning by both columns splits a label of any size.
    placed = image_labels.withColumn(BUCKET, _label_bucket())
    placed.repartitionByRange(BUCKET, "label_name", "image_id").sortWithinPartitions(
        BUCKET, "label_name", "image_id"
    ).write.partitionBy(BUCKET).parquet(f"{path}/image_labels")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(
        spark.read.parquet(f"{path}/{name}") for name in ("classes", "images", "image_labels")
    )
