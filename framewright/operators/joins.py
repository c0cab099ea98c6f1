"""Joins of candidates with the manifest, landed bytes and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import spread_missing
from framewright.operators.gates import has_file
from framewright.operators.ordering import first_wins
from framewright.schema import ORDINAL

PAIR = ("source", "source_id")


def resume_join(
    candidates: DataFrame, manifest: DataFrame, files: DataFrame, skip_existing: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(existing, todo): a candidate is done when the manifest has its (source,
    source_id) and the file of that row is still there.

    ``existing`` holds the manifest's rows, once per candidate, with the
    candidate's ordinal; ``todo`` the remaining candidates.
    """
    if not skip_existing:
        return manifest.limit(0), candidates
    known = manifest.join(candidates.select(*PAIR), list(PAIR), "left_semi")
    done = has_file(first_wins(known, PAIR), files)
    # Which candidates are done is told by keys, without the manifest's whole rows.
    keys = has_file(first_wins(known.select(*PAIR, "local_path", ORDINAL), PAIR), files).select(*PAIR)
    order = candidates.select(*PAIR, F.col(ORDINAL).alias("__ordinal"))
    existing = done.join(order, list(PAIR)).select(
        *[F.col(c) if c != ORDINAL else F.col("__ordinal").alias(ORDINAL) for c in manifest.columns]
    )
    return existing, candidates.join(keys, list(PAIR), "left_anti")


def remove_many(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """The manifest without the given ids; duplicates and unknown ids do no harm."""
    return manifest.join(ids.select("id"), "id", "left_anti")


def removed_count(manifest: DataFrame, ids: DataFrame) -> int:
    return manifest.select("id").join(ids.select("id"), "id", "left_semi").count()


def thumbnail_fallback(
    records: DataFrame,
    landed: DataFrame,
    thumbnails: DataFrame,
    columns: Sequence[str] = ("length",),
) -> DataFrame:
    """Landed file of the original URL, else of the thumbnail of that image.

    ``landed`` has (url, path, ...), ``thumbnails`` (image_id, thumbnail_url).
    Adds ``landed_path`` and the listed columns, null when neither has landed,
    and ``landed_from``. Both look-ups have unique keys.
    """

    def files(prefix):
        return landed.select(
            F.col("url").alias(f"__{prefix}url"),
            F.col("path").alias(f"__{prefix}path"),
            *[F.col(c).alias(f"__{prefix}{c}") for c in columns],
        )

    small = files("t_").join(
        thumbnails.where(F.col("thumbnail_url") != ""),
        F.col("__t_url") == F.col("thumbnail_url"),
    )
    url = spread_missing(F.col("download_url"), F.col("source"), F.col("source_id"))
    joined = records.join(files("o_"), url == F.col("__o_url"), "left").join(
        small,
        F.col("__o_path").isNull() & (F.col("source_id") == F.col("image_id")),
        "left",
    )
    origin = F.when(F.col("__o_path").isNotNull(), "original").when(
        F.col("__t_path").isNotNull(), "thumbnail"
    )
    return joined.select(
        *records.columns,
        F.coalesce("__o_path", "__t_path").alias("landed_path"),
        *[F.coalesce(f"__o_{c}", f"__t_{c}").alias(c) for c in columns],
        origin.alias("landed_from"),
    )


def source_for(source: Column, configured: Sequence[str]) -> Column:
    """Adapter that serves a record: its own source, else the first configured
    one, else null. The list is part of the job's configuration, so this is an
    expression and no join."""
    if not configured:
        return F.lit(None).cast("string")
    return F.when(source.isin(*configured), source).otherwise(F.lit(configured[0]))


def record_source_join(records: DataFrame, configured: Sequence[str]) -> DataFrame:
    """Add ``adapter``; null means "no source adapter found"."""
    return records.withColumn("adapter", source_for(F.col("source"), configured))


def allowed_sources(df: DataFrame, names: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Rows of the named sources; unknown names are ignored, none left is an error."""
    valid = [n for n in (name.strip().lower() for name in names) if n in known]
    if not valid:
        raise ValueError("No valid sources configured.")
    return df.where(F.col("source").isin(*valid))
