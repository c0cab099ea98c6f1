"""Summaries of a run and of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordering import frequency_order
from framewright.schema import FAILED_DOWNLOAD, FAILED_QUALITY, ORDINAL, OUTCOMES, RECORD_COLUMNS


def outcome_summary(df: DataFrame) -> DataFrame:
    """One row: a count per outcome, and the total."""
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES]
    known = F.count_if(F.col("outcome").isin(*OUTCOMES)).alias("total")
    return df.agg(*counts, known)


def failures(df: DataFrame) -> DataFrame:
    """Log of failed rows; rejected duplicates are counted but not logged."""
    return df.where(F.col("outcome").isin(FAILED_DOWNLOAD, FAILED_QUALITY)).select(
        "source_id", "source", "reason"
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """One row: total, mean and minimum of the dimensions over non-zero values."""
    width = F.when(F.col("width") != 0, F.col("width"))
    height = F.when(F.col("height") != 0, F.col("height"))
    return df.agg(
        F.count("*").alias("total"),
        F.avg(width).alias("avg_width"),
        F.avg(height).alias("avg_height"),
        F.min(width).alias("min_width"),
        F.min(height).alias("min_height"),
    )


def counts_by(df: DataFrame, key: str, order: str = ORDINAL) -> DataFrame:
    """Counts per source, license, ..., most common first."""
    return frequency_order(df, key, order)


def attribution_report(df: DataFrame, *extra: str) -> DataFrame:
    """Ten columns for legal review; a missing path is empty text."""
    return df.select(
        "id", "attribution", "license_type", "license_url", "photographer", "photographer_url",
        "url", "source", "query", F.coalesce("local_path", F.lit("")).alias("local_path"), *extra,
    )


def export_projection_parquet(df: DataFrame, *extra: str) -> DataFrame:
    """Twelve typed columns of the training-set table."""
    return df.select(
        F.col("local_path").alias("image_path"),
        "id", "source", "license_type", "attribution", "photographer", "url",
        F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"),
        "tags", "description", "query", *extra,
    )


def export_projection_coco(id_key: str = "record_id"):
    """Image object of the COCO layout, as a struct column."""
    from framewright.functions.text import base_name

    return F.struct(
        F.col("image_id").alias("id"),
        base_name(F.col("local_path")).alias("file_name"),
        "width", "height",
        F.col("license_type").alias("license"),
        "attribution", "url",
        F.col("id").alias(id_key),
        "source",
    )


def derived_id(text: Column) -> Column:
    """A UUID that follows from a text."""
    digest = F.md5(text)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def distinct_ids(df: DataFrame, order: str = ORDINAL) -> DataFrame:
    """The first row of an id keeps it; later ones get an id derived from it and their order.

    Ids follow from what a record is, so datasets of one query share them; where
    such datasets meet, every record stays.
    """
    firsts = df.groupBy("id").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("__first"))
    new = derived_id(F.concat_ws("\u0001", F.coalesce("id", F.lit("")), F.col(order).cast("string")))
    joined = df.join(firsts, order, "left")
    return joined.withColumn("id", F.when(F.col("__first"), F.col("id")).otherwise(new)).select(*df.columns)


def with_record_defaults(
    df: DataFrame, identity: tuple[str, ...] = ("source", "source_id", "query")
) -> DataFrame:
    """Complete a projection to the full record, in schema order.

    The id is a UUID derived from ``identity``, not a random one: a task that is
    run again after a lost executor gives the same id.
    """
    known = [F.coalesce(c, F.lit("")) for c in identity if c in df.columns]
    defaults = {
        "id": derived_id(F.concat_ws("\u0001", *known)),
        "local_path": F.lit(None).cast("string"),
        "file_size_bytes": F.lit(0).cast("bigint"),
        "format": F.lit(""),
        "tags": F.array().cast("array<string>"),
        "description": F.lit(""),
        "blur_score": F.lit(None).cast("double"),
        "phash": F.lit(None).cast("string"),
        "downloaded_at": F.localtimestamp(),
        "query": F.lit(""),
        "dataset_name": F.lit(""),
    }
    optional = {"local_path", "blur_score", "phash"}
    columns = []
    for name in RECORD_COLUMNS:
        if name not in df.columns:
            value = defaults[name]
        elif name in defaults and name not in optional:
            value = F.coalesce(F.col(name), defaults[name])
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    rest = [c for c in df.columns if c not in RECORD_COLUMNS]
    return df.select(*columns, *rest)


def stamp(df: DataFrame, dataset_name: str | None = None, query: str | None = None) -> DataFrame:
    """Set the dataset name and the query on every hit."""
    values = {"dataset_name": dataset_name, "query": query}
    return df.withColumns({k: F.lit(v) for k, v in values.items() if v is not None})
