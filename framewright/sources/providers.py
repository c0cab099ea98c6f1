"""Landed provider result pages to records.

Each reader is a DataFrame -> DataFrame function from parsed pages to records;
they are registered by source name and can be extended with ``register``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.licenses import resolve_license
from framewright.functions.text import split_list, strip_html, truthy
from framewright.operators.aggregates import with_record_defaults
from framewright.operators.ordering import first_wins, with_position
from framewright.schema import PEXELS_PAGE, PIXABAY_PAGE, UNSPLASH_PAGE, WIKIMEDIA_PAGE


def _text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _items(pages: DataFrame, items: str | Column) -> DataFrame:
    """One row per hit: the other page columns, ``rank_in_page`` and ``item``."""
    items = F.col(items) if isinstance(items, str) else items
    page_columns = {"results", "photos", "hits", "query_result", "total", "total_pages",
                    "next_page", "totalHits"}
    keep = [c for c in pages.columns if c not in page_columns]
    return pages.select(*keep, F.posexplode(items).alias("rank_in_page", "item"))


def _record(hits: DataFrame, source: str, **columns: Column) -> DataFrame:
    keep = [c for c in hits.columns if c != "item"]
    values = {"source": F.lit(source), **columns}
    return with_record_defaults(
        hits.select(*keep, *[value.alias(name) for name, value in values.items()])
    )


def normalize_unsplash(pages: DataFrame) -> DataFrame:
    hits = _items(pages, "results").where("item.id is not null")
    titles = F.transform(F.col("item.tags"), lambda tag: tag.getField("title"))
    return _record(
        hits,
        "unsplash",
        source_id=F.col("item.id"),
        url=_text("item.links.html"),
        download_url=F.coalesce("item.urls.regular", "item.urls.full", F.lit("")),
        license_type=F.lit("unsplash"),
        license_url=F.lit("https://unsplash.com/license"),
        photographer=_text("item.user.name"),
        photographer_url=_text("item.user.links.html"),
        attribution=F.concat(
            F.lit("Photo by "), F.coalesce("item.user.name", F.lit("Unknown")), F.lit(" on Unsplash")
        ),
        width=F.coalesce("item.width", F.lit(0)),
        height=F.coalesce("item.height", F.lit(0)),
        tags=F.filter(titles, lambda title: title.isNotNull()),
        description=F.coalesce(
            truthy(F.col("item.description")), truthy(F.col("item.alt_description")), F.lit("")
        ),
    )


def normalize_pexels(pages: DataFrame) -> DataFrame:
    hits = _items(pages, "photos").where("item.id is not null")
    return _record(
        hits,
        "pexels",
        source_id=F.col("item.id").cast("string"),
        url=_text("item.url"),
        download_url=F.coalesce("item.src.original", "item.src.large2x", F.lit("")),
        license_type=F.lit("pexels"),
        license_url=F.lit("https://www.pexels.com/license/"),
        photographer=_text("item.photographer"),
        photographer_url=_text("item.photographer_url"),
        attribution=F.concat(
            F.lit("Photo by "), F.coalesce("item.photographer", F.lit("Unknown")), F.lit(" on Pexels")
        ),
        width=F.coalesce("item.width", F.lit(0)),
        height=F.coalesce("item.height", F.lit(0)),
        description=_text("item.alt"),
    )


def normalize_pixabay(pages: DataFrame) -> DataFrame:
    hits = _items(pages, "hits").where("item.id is not null")
    user = F.coalesce("item.user", F.lit("Unknown"))
    user_id = _text(F.col("item.user_id").cast("string"))
    return _record(
        hits,
        "pixabay",
        source_id=F.col("item.id").cast("string"),
        url=_text("item.pageURL"),
        download_url=F.coalesce("item.largeImageURL", "item.webformatURL", F.lit("")),
        license_type=F.lit("pixabay"),
        license_url=F.lit("https://pixabay.com/service/license-summary/"),
        photographer=user,
        photographer_url=F.concat(
            F.lit("https://pixabay.com/users/"), user, F.lit("-"), user_id, F.lit("/")
        ),
        attribution=F.concat(F.lit("Image by "), user, F.lit(" on Pixabay")),
        width=F.coalesce("item.imageWidth", F.lit(0)),
        height=F.coalesce("item.imageHeight", F.lit(0)),
        tags=split_list(_text("item.tags")),
        description=_text("item.tags"),
    )


def normalize_wikimedia(
    pages: DataFrame, include_cc_by_sa: bool = False, strict: bool = False
) -> DataFrame:
    """Only pages with a real id, an image, and an accepted license become records."""
    hits = _items(pages, F.map_values(F.col("query_result.pages")))
    info = F.get(F.col("item.imageinfo"), 0)
    terms = resolve_license(
        info.getField("extmetadata").getField("LicenseShortName").getField("value"),
        include_cc_by_sa,
        strict,
    )
    hits = (
        hits.where(F.coalesce("item.pageid", F.lit(-1)) != -1)
        .where(F.startswith(info.getField("mime"), F.lit("image/")))
        .withColumn("terms", terms)
        .where("terms is not null")
    )
    artist = strip_html(_text(info.getField("extmetadata").getField("Artist").getField("value")))
    title = _text("item.title")
    records = _record(
        hits,
        "wikimedia",
        source_id=F.col("item.pageid").cast("string"),
        url=F.concat(
            F.lit("https://commons.wikimedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_"))
        ),
        download_url=_text(info.getField("url")),
        license_type=F.col("terms.license_type"),
        license_url=F.col("terms.license_url"),
        photographer=artist,
        photographer_url=F.lit(""),
        attribution=F.when(
            artist != "", F.concat(F.lit("Image by "), artist, F.lit(" via Wikimedia Commons"))
        ).otherwise("Image via Wikimedia Commons"),
        width=F.coalesce(info.getField("width"), F.lit(0)),
        height=F.coalesce(info.getField("height"), F.lit(0)),
        description=F.replace(title, F.lit("File:"), F.lit("")),
    )
    return records.drop("terms")


Reader = Callable[..., DataFrame]

PAGE_SCHEMAS: dict[str, str] = {
    "unsplash": UNSPLASH_PAGE,
    "pexels": PEXELS_PAGE,
    "pixabay": PIXABAY_PAGE,
    "wikimedia": WIKIMEDIA_PAGE,
}
READERS: dict[str, Reader] = {
    "unsplash": normalize_unsplash,
    "pexels": normalize_pexels,
    "pixabay": normalize_pixabay,
    "wikimedia": normalize_wikimedia,
}


#: Where the hits lie in a page.
HIT_PATHS: dict[str, tuple[str, ...]] = {
    "unsplash": ("results",),
    "pexels": ("photos",),
    "pixabay": ("hits",),
    "wikimedia": ("query", "pages"),
}


def register(source: str, page_schema: str, reader: Reader, hits: tuple[str, ...] = ()) -> None:
    """Add a source: the DDL of its pages, its pages -> records function, and where the hits lie
    in a page, which lets whole hits of a broken page be rescued."""
    PAGE_SCHEMAS[source] = page_schema
    READERS[source] = reader
    HIT_PATHS[source] = tuple(hits)


def parse_pages(df: DataFrame, source: str, column: str = "page") -> DataFrame:
    """Parse pages held as JSON text in a column; the other columns stay."""
    keep = [c for c in df.columns if c != column]
    parsed = df.select(F.from_json(column, PAGE_SCHEMAS[source]).alias("__page"), *keep)
    names = [f.name for f in parsed.schema["__page"].dataType.fields]
    renamed = [
        F.col(f"__page.{n}").alias("query_result" if n == "query" else n) for n in names
    ]
    return parsed.select(*keep, *renamed)


def landed_lines(text: DataFrame) -> DataFrame:
    """(place, page) of the lines of landed files; ``place`` orders them by file name, block and line."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return text.select(place.alias("place"), F.col("value").alias("page")).where(F.trim("page") != "")


def _whole_hits(text: str, path: tuple[str, ...]) -> list[str]:
    """The hits of a broken page that are whole, as JSON text (with their key, where they are an object's)."""
    decode, blank = json.JSONDecoder().raw_decode, re.compile(r"[\s,]*")
    skip = lambda at: blank.match(text, at).end()
    found: list[str] = []

    def members(at: int, path: tuple[str, ...]) -> None:
        """Read ``path`` from the container that opens at ``at``; a broken value ends it with an error."""
        opening, at = text[at], skip(at + 1)
        while text[at] not in "]}":
            start = at
            name = None
            if opening == "{":
                name, at = decode(text, at)
                at = re.compile(r"\s*:\s*").match(text, at).end()
            if path and name == path[0] and text[at] in "[{":
                return members(at, path[1:])
            value, at = decode(text, at)
            if not path and isinstance(value, dict):
                found.append(text[start:at])
            at = skip(at)

    try:
        members(skip(0), path)
    except (ValueError, IndexError, AttributeError, RecursionError):
        pass  # the place where the page is broken
    return found


def _rescue(path: tuple[str, ...]):
    """Pages that are no JSON to pages of their whole hits."""

    @F.pandas_udf("page string, hits int")
    def run(pages: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for page in pages:
            hits = _whole_hits(page, path) if page is not None and path else []
            body = ",".join(hits)
            body = f"[{body}]" if not hits or hits[0].startswith("{") else "{" + body + "}"
            for name in reversed(path):
                body = "{" + json.dumps(name) + ":" + body + "}"
            texts.append(body if hits else None)
            counts.append(len(hits))
        return pd.DataFrame({"page": pd.Series(texts, dtype=object), "hits": counts})

    return run


def checked_pages(lines: DataFrame, source: str) -> DataFrame:
    """Parsed pages of (place, page, ...) lines, with ``fault``: null for a sound page, else why it is listed
    as rejected (``not_json``, ``wrong_type`` or ``no_hits``).

    A page that is no JSON, as one that was cut off, keeps the hits before the break. One with values of
    another type keeps what could be read. Only broken pages are sent to the Python worker.
    """
    schema, path = PAGE_SCHEMAS[source], HIT_PATHS.get(source, ())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    first = lines.withColumn("__first", F.from_json("page", f"{schema}, __corrupt STRING", options))
    spoilt = F.col("__first.__corrupt").isNotNull()
    no_json = spoilt & F.try_parse_json("page").isNull()
    rescued = first.withColumn("__cut", no_json).withColumn("__rescued", _rescue(path)(F.when(F.col("__cut"), F.col("page"))))
    text = F.when(F.col("__cut"), F.col("__rescued.page")).otherwise(F.col("page"))
    parsed = rescued.withColumn("__page", F.from_json(text, schema))
    hits = F.col("__page." + ".".join(path)) if path else F.col("__page")
    fault = (
        F.when(F.col("__cut"), "not_json")
        .when(F.col("__page").isNull() | hits.isNull(), "no_hits")
        .when(F.col("__first.__corrupt").isNotNull(), "wrong_type")
    )
    names = parsed.schema["__page"].dataType.names
    # The Wikimedia envelope is called "query", like the record's search text.
    fields = [F.col(f"__page.{n}").alias("query_result" if n == "query" else n) for n in names]
    return parsed.select(
        *lines.columns, *fields, fault.alias("fault"), F.col("__rescued.hits").alias("rescued_hits")
    )


def read_api_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Pages landed as files of JSON, one page per line.

    ``place`` keeps the order of the pages: file name, block, line. A broken page comes with the hits that are
    whole; ``read_rejected_pages`` lists it.
    """
    pages = checked_pages(landed_lines(spark.read.text(path)), source)
    return pages.drop("page", "fault", "rescued_hits")


def read_rejected_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The pages that are not sound: file, block, line, reason, how many whole hits were rescued, and the text."""
    return rejected(checked_pages(landed_lines(spark.read.text(path)), source))


def rejected(pages: DataFrame) -> DataFrame:
    return pages.where("fault is not null").select(
        "place.*", F.col("fault").alias("reason"), "rescued_hits", "page"
    )


def rank_hits(records: DataFrame) -> DataFrame:
    """Replace the place of a hit (page, then place in the page) by ``rank``, dense
    per query and source. A hit that a later page repeats counts once."""
    once = first_wins(
        records.withColumn("place", F.struct("place", "rank_in_page")),
        ["query", "source", "source_id"],
        "place",
    )
    ranked = with_position(once, ["place"], within=["query", "source"], name="rank")
    return ranked.drop("place", "rank_in_page")


def read_records(pages: DataFrame, source: str, query: str | None = None, **options) -> DataFrame:
    """Records of parsed pages, with the search text they answer."""
    if query is not None:
        pages = pages.withColumn("query", F.lit(query))
    return READERS[source](pages, **options)
