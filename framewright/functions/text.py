"""String and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.schema import MANIFEST, RECORD_COLUMNS

# Formats with a known extension, and extensions kept from a URL.
FORMAT_EXTENSIONS = {"jpeg": ".jpg", "jpg": ".jpg", "png": ".png", "webp": ".webp"}
URL_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif")


def truthy(column: Column) -> Column:
    """Null for an empty string, so that ``coalesce`` can pick the next choice."""
    return F.nullif(column, F.lit(""))


def strip(column: Column) -> Column:
    """Trim white space of every kind; ``F.trim`` takes off blanks only."""
    return F.btrim(column, F.lit(" \t\n\r\f\x0b"))


def strip_html(column: Column) -> Column:
    return strip(F.regexp_replace(column, r"<[^>]+>", ""))


def split_list(column: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty items."""
    items = F.transform(F.split(column, ","), strip)
    return F.filter(items, lambda item: item != "")


def file_extension(url: Column, fmt: Column | None = None) -> Column:
    """Extension from the format, else from the URL's last segment, else .jpg."""
    segment = F.element_at(F.split(F.element_at(F.split(url, r"\?"), 1), "/"), -1)
    suffix = F.lower(F.regexp_extract(segment, r"\.([^.]*)$", 1))
    from_url = (
        F.when(suffix == "jpeg", ".jpg")
        .when(suffix.isin(*URL_EXTENSIONS), F.concat(F.lit("."), suffix))
        .otherwise(".jpg")
    )
    if fmt is None:
        return from_url
    choice = None
    for name, extension in FORMAT_EXTENSIONS.items():
        test = F.lower(fmt) == name
        choice = F.when(test, extension) if choice is None else choice.when(test, extension)
    return choice.otherwise(from_url)


def file_name(source: Column, source_id: Column, extension: Column) -> Column:
    return F.concat(source, F.lit("_"), source_id, extension)


def image_path(name: Column, label: Column | None = None, root: str = "images") -> Column:
    """Path of an image below the dataset folder; a null label adds no folder."""
    parts = [F.lit(root), name] if label is None else [F.lit(root), label, name]
    return F.concat_ws("/", *parts)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)


def normalize_path(path: Column) -> Column:
    """One spelling for local paths: ``file:/x`` and ``file:///x`` become ``/x``."""
    return F.regexp_replace(path, r"^file:/+", "/")


def decoded_path(uri: Column) -> Column:
    """Path of a file from its URI, as file metadata give it: ``%20`` is a blank, ``+`` a plus."""
    return normalize_path(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def spread_missing(key: Column, *identity: Column) -> Column:
    """A join key whose null or empty values are spread over the partitions.

    In an outer join, all rows without a key would meet in one task. The
    replacement starts with a NUL character and so equals no real key.
    """
    filler = F.concat(F.lit("\u0000"), F.xxhash64(*identity).cast("string"))
    return F.coalesce(truthy(key), filler)


def query_label(query: Column) -> Column:
    return F.replace(query, F.lit(" "), F.lit("_"))


def record_to_json(extra: tuple[str, ...] = ()) -> Column:
    """The record as JSON text; null fields are kept."""
    return F.to_json(F.struct(*RECORD_COLUMNS, *extra), {"ignoreNullFields": "false"})


def record_from_json(column: Column) -> Column:
    return F.from_json(column, MANIFEST)
