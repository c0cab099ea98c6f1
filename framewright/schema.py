"""Schemas shared by every operator: records, provider pages, index tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per image.
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("download_url", T.StringType()),
        T.StructField("local_path", T.StringType()),
        T.StructField("license_type", T.StringType()),
        T.StructField("license_url", T.StringType()),
        T.StructField("attribution", T.StringType()),
        T.StructField("photographer", T.StringType()),
        T.StructField("photographer_url", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("format", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("blur_score", T.DoubleType()),
        T.StructField("phash", T.StringType()),
        T.StructField("downloaded_at", T.TimestampNTZType()),
        T.StructField("query", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
    ]
)
RECORD_COLUMNS = RECORD.names

# The order that splits, merges and deduplication depend on. A DataFrame has
# none of its own, so it travels as a column next to the record.
ORDINAL = "ordinal"
MANIFEST = T.StructType(RECORD.fields + [T.StructField(ORDINAL, T.LongType())])

# Outcomes of a curation run.
ACCEPTED = "accepted"
SKIPPED = "skipped_existing"
FAILED_DOWNLOAD = "failed_download"
FAILED_QUALITY = "failed_quality"
FAILED_DEDUP = "failed_dedup"
OUTCOMES = (ACCEPTED, SKIPPED, FAILED_DOWNLOAD, FAILED_QUALITY, FAILED_DEDUP)

# Landed provider result pages, one JSON object per page (DDL).
UNSPLASH_PAGE = (
    "results ARRAY<STRUCT<id STRING, width INT, height INT, description STRING,"
    " alt_description STRING, urls STRUCT<regular STRING, full STRING>,"
    " links STRUCT<html STRING>, user STRUCT<name STRING, links STRUCT<html STRING>>,"
    " tags ARRAY<STRUCT<title STRING>>>>, total INT, total_pages INT"
)
PEXELS_PAGE = (
    "photos ARRAY<STRUCT<id BIGINT, url STRING, photographer STRING,"
    " photographer_url STRING, width INT, height INT, alt STRING,"
    " src STRUCT<original STRING, large2x STRING>>>, next_page STRING"
)
PIXABAY_PAGE = (
    "hits ARRAY<STRUCT<id BIGINT, pageURL STRING, largeImageURL STRING,"
    " webformatURL STRING, imageWidth INT, imageHeight INT, tags STRING,"
    " user STRING, user_id BIGINT>>, totalHits INT"
)
WIKIMEDIA_PAGE = (
    "query STRUCT<pages: MAP<STRING, STRUCT<pageid BIGINT, title STRING,"
    " imageinfo ARRAY<STRUCT<url STRING, width INT, height INT, mime STRING,"
    " extmetadata STRUCT<LicenseShortName STRUCT<value STRING>,"
    " LicenseUrl STRUCT<value STRING>, Artist STRUCT<value STRING>>>>>>>"
)

# Label index tables.
CLASSES = "label_name STRING, display_name STRING"
INDEX_IMAGES = (
    "image_id STRING, original_url STRING, thumbnail_url STRING, author STRING,"
    " author_url STRING, license_url STRING, title STRING"
)
IMAGE_LABELS = "image_id STRING, label_name STRING"
