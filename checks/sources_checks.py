"""Scans, provider pages, the label index and image files."""

from __future__ import annotations

import struct
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.catalog import check
from checks.standins import BLUR, PHASH, RECORDS, SIGNALS, images, records, table
from framewright.functions import text as tx
from framewright.functions.licenses import license_from_url, resolve_license
from framewright.operators import ordering
from framewright.session import scratch_path
from framewright.sources import index, providers
from framewright.sources.images import image_signals, list_files, read_image_files
from framewright.sources.manifest import Manifest, PartitionedManifest, known_hashes
from framewright.streaming.ingest import incremental_ingest

# The label index: parts are classes, orders are images, line items are labels.


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("label_name"), F.col("p_name").alias("display_name")
    )


def _index_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    terms = (
        F.when(F.col("o_orderstatus") == "F", "https://creativecommons.org/licenses/by/2.0/")
        .when(F.col("o_orderpriority") == "1-URGENT", "https://creativecommons.org/publicdomain/zero/1.0/")
        .when(F.col("o_orderpriority") == "2-HIGH", "https://creativecommons.org/licenses/BY/4.0/")
        .otherwise("https://example.org/terms")
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("image_id"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "")
        .otherwise(F.concat(F.lit("https://img.example/"), key))
        .alias("original_url"),
        F.concat(F.lit("https://thumb.example/"), key).alias("thumbnail_url"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("author"),
        F.lit("https://author.example/").alias("author_url"),
        terms.alias("license_url"),
        F.concat(F.lit('Order, "'), "o_orderstatus", F.lit('"')).alias("title"),
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("image_id"),
        F.col("l_partkey").cast("string").alias("label_name"),
    )


INDEX = """
classes AS (SELECT p_partkey::VARCHAR AS label_name, p_name AS display_name FROM part),
images AS (
  SELECT o_orderkey::VARCHAR AS image_id,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE 'https://img.example/' || o_orderkey END AS original_url,
    'https://thumb.example/' || o_orderkey AS thumbnail_url,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS author,
    'https://author.example/' AS author_url,
    CASE WHEN o_orderstatus = 'F' THEN 'https://creativecommons.org/licenses/by/2.0/'
      WHEN o_orderpriority = '1-URGENT' THEN 'https://creativecommons.org/publicdomain/zero/1.0/'
      WHEN o_orderpriority = '2-HIGH' THEN 'https://creativecommons.org/licenses/BY/4.0/'
      ELSE 'https://example.org/terms' END AS license_url,
    'Order, "' || o_orderstatus || '"' AS title
  FROM orders),
image_labels AS (SELECT l_orderkey::VARCHAR AS image_id, l_partkey::VARCHAR AS label_name FROM lineitem)"""

SEARCH = """
found AS (
  SELECT DISTINCT i.* FROM images i JOIN image_labels il ON i.image_id = il.image_id
  WHERE il.label_name IN (SELECT label_name FROM classes WHERE lower(display_name) LIKE '%red%')
    AND i.original_url <> '')"""

INDEX_RECORD = """
SELECT source, source_id, url, download_url, license_type, license_url, photographer, photographer_url,
  CASE WHEN photographer <> '' THEN 'Photo by ' || photographer || ' (Open Images, ' || license_type || ')'
    ELSE 'Open Images Dataset (' || license_type || ')' END AS attribution,
  width, height, tags, description, query
FROM (
  SELECT 'openimages' AS source, image_id AS source_id, 'https://www.flickr.com/photos/' || image_id AS url,
    original_url AS download_url,
    CASE WHEN contains(lower(license_url), 'cc0') OR contains(lower(license_url), 'publicdomain') THEN 'CC0-1.0'
      WHEN contains(lower(license_url), 'by/4.0') THEN 'CC-BY-4.0' ELSE 'CC-BY-2.0' END AS license_type,
    license_url, author AS photographer, author_url AS photographer_url,
    0 AS width, 0 AS height, 'Red' AS tags, title AS description, 'Red' AS query
  FROM found)"""


def _index_record(rows: DataFrame) -> DataFrame:
    return rows.select(
        "source", "source_id", "url", "download_url", "license_type", "license_url", "photographer",
        "photographer_url", "attribution", "width", "height",
        F.array_join("tags", ",").alias("tags"), "description", "query",
    )


@check(f"WITH {INDEX}, {SEARCH} {INDEX_RECORD}")
def index_search(spark, sf_dir):
    found = index.search_index(
        _classes(spark, sf_dir), _index_images(spark, sf_dir), _labels(spark, sf_dir), "Red"
    )
    return _index_record(index.normalize_index(found, "Red"))


@check(f"WITH {INDEX}, {SEARCH} SELECT image_id, title FROM found ORDER BY image_id LIMIT 100")
def index_search_first(spark, sf_dir):
    """Top-k report: the first 100 images by id."""
    found = index.search_index(
        _classes(spark, sf_dir), _index_images(spark, sf_dir), _labels(spark, sf_dir), "red", 100
    )
    return found.select("image_id", "title")


@check(f"WITH {INDEX} SELECT label_name, display_name FROM classes WHERE lower(display_name) LIKE '%e_ r%n%'")
def class_search(spark, sf_dir):
    return index.class_search(_classes(spark, sf_dir), "E_ R%n")


@check(f"WITH {INDEX} SELECT label_name, display_name FROM classes")
def class_csv(spark, sf_dir):
    """Header-less CSV; a second row per label, later in the file, is ignored."""
    path = scratch_path(spark, "classes.csv")
    rows = _classes(spark, sf_dir).withColumn("n", F.lit(0))
    again = rows.withColumns({"display_name": F.lit("later"), "n": F.lit(1)})
    rows.unionByName(again).repartitionByRange("n", "label_name").sortWithinPartitions(
        "n", "label_name"
    ).drop("n").write.option("escape", '"').csv(path)
    return index.read_class_csv(spark, path)


@check(f"WITH {INDEX} SELECT * FROM images")
def image_csv(spark, sf_dir):
    path = scratch_path(spark, "images.csv")
    names = {ours: theirs for theirs, ours in index.IMAGE_COLUMNS.items()}
    rows = _index_images(spark, sf_dir).withColumnsRenamed(names).withColumn("Rotation", F.lit(0))
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return index.read_image_csv(spark, path)


@check(
    "SELECT DISTINCT l_orderkey::VARCHAR AS image_id, l_partkey::VARCHAR AS label_name"
    " FROM lineitem WHERE l_returnflag = 'N'"
)
def label_csv(spark, sf_dir):
    path = scratch_path(spark, "labels.csv")
    confidence = (
        F.when(F.col("l_returnflag") == "N", "1").when(F.col("l_returnflag") == "A", "1.0").otherwise("0")
    )
    table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ImageID"),
        F.lit("verification").alias("Source"),
        F.col("l_partkey").alias("LabelName"),
        confidence.alias("Confidence"),
    ).write.option("header", True).csv(path)
    return index.read_label_csv(spark, path)


@check(f"WITH {INDEX}, {SEARCH} SELECT image_id, license_url FROM found")
def index_tables(spark, sf_dir):
    """The index as Parquet, written once and searched."""
    path = scratch_path(spark, "index")
    index.write_index(
        _classes(spark, sf_dir), _index_images(spark, sf_dir), _labels(spark, sf_dir), path
    )
    found = index.search_index(*index.read_index(spark, path), "red")
    return found.select("image_id", "license_url")


# Provider pages: each document becomes a landed page.

LICENSES = ["CC0", "Public domain", "CC-BY-SA 4.0", "CC-BY 4.0", "CC BY 4.0", "CC-BY-NC 4.0", "GFDL"]


def _pages(rows: DataFrame, key: str, item) -> DataFrame:
    return rows.select(
        F.to_json(F.struct(F.array(item).alias(key))).alias("page"), F.col("lang").alias("query")
    )


def _unsplash_pages(spark, sf_dir):
    item = F.struct(
        F.col("source_id").alias("id"),
        F.when(F.col("width") > 100, F.col("width")).alias("width"),
        "height",
        F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", F.col("description")).alias("description"),
        F.when(F.col("lang") != "es", F.col("description")).alias("alt_description"),
        F.struct(
            F.when(F.col("lang") != "en", F.col("download_url")).alias("regular"),
            F.col("url").alias("full"),
        ).alias("urls"),
        F.struct(F.col("url").alias("html")).alias("links"),
        F.struct(
            F.when(F.col("lang") != "de", F.col("source")).alias("name"),
            F.struct(F.col("url").alias("html")).alias("links"),
        ).alias("user"),
        F.array(
            F.struct(F.col("lang").alias("title")),
            F.struct(F.when(F.col("lang") != "de", F.col("source")).alias("title")),
        ).alias("tags"),
    )
    return _pages(records(spark, sf_dir).withColumn("lang", F.col("query")), "results", item)


RECORD_TEXT = (
    "source", "source_id", "url", "download_url", "license_type", "license_url", "photographer",
    "photographer_url", "attribution", "width", "height", "tags", "description", "query",
)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.array_join(c, ",").alias(c) if c == "tags" else F.col(c) for c in RECORD_TEXT]
    )


UNSPLASH = f"""
WITH {RECORDS} SELECT 'unsplash' AS source, source_id, url,
  CASE WHEN query <> 'en' THEN download_url ELSE url END AS download_url,
  'unsplash' AS license_type, 'https://unsplash.com/license' AS license_url,
  CASE WHEN query <> 'de' THEN source ELSE '' END AS photographer, url AS photographer_url,
  'Photo by ' || CASE WHEN query <> 'de' THEN source ELSE 'Unknown' END || ' on Unsplash' AS attribution,
  CASE WHEN width > 100 THEN width ELSE 0 END AS width, height,
  query || CASE WHEN query <> 'de' THEN ',' || source ELSE '' END AS tags,
  CASE WHEN query = 'es' THEN '' ELSE description END AS description, query
FROM rec"""


@check(UNSPLASH)
def pages_unsplash(spark, sf_dir):
    pages = providers.parse_pages(_unsplash_pages(spark, sf_dir), "unsplash")
    return _flat(providers.read_records(pages, "unsplash"))


@check(UNSPLASH.replace("description, query\nFROM rec", "description, 'all' AS query\nFROM rec"))
def pages_landed_as_files(spark, sf_dir):
    """The same pages, read back from landed JSON files."""
    path = scratch_path(spark, "pages")
    _unsplash_pages(spark, sf_dir).select(F.col("page").alias("value")).write.text(path)
    pages = providers.read_api_pages(spark, path, "unsplash")
    return _flat(providers.read_records(pages, "unsplash", "all"))


@check(
    f"""
WITH {RECORDS} SELECT 'pexels' AS source, source_id, url,
  CASE WHEN query <> 'en' THEN download_url ELSE url END AS download_url,
  'pexels' AS license_type, 'https://www.pexels.com/license/' AS license_url,
  CASE WHEN query <> 'de' THEN source ELSE '' END AS photographer, url AS photographer_url,
  'Photo by ' || CASE WHEN query <> 'de' THEN source ELSE 'Unknown' END || ' on Pexels' AS attribution,
  width, height, '' AS tags, description, query
FROM rec"""
)
def pages_pexels(spark, sf_dir):
    item = F.struct(
        F.col("ordinal").alias("id"), "url",
        F.when(F.col("lang") != "de", F.col("source")).alias("photographer"),
        F.col("url").alias("photographer_url"), "width", "height",
        F.col("description").alias("alt"),
        F.struct(
            F.when(F.col("lang") != "en", F.col("download_url")).alias("original"),
            F.col("url").alias("large2x"),
        ).alias("src"),
    )
    rows = records(spark, sf_dir).withColumn("lang", F.col("query"))
    pages = providers.parse_pages(_pages(rows, "photos", item), "pexels")
    return _flat(providers.read_records(pages, "pexels"))


@check(
    f"""
WITH {RECORDS} SELECT 'pixabay' AS source, source_id, url,
  CASE WHEN query <> 'en' THEN download_url ELSE url END AS download_url,
  'pixabay' AS license_type, 'https://pixabay.com/service/license-summary/' AS license_url,
  CASE WHEN query <> 'de' THEN source ELSE 'Unknown' END AS photographer,
  'https://pixabay.com/users/' || CASE WHEN query <> 'de' THEN source ELSE 'Unknown' END || '-'
    || ordinal || '/' AS photographer_url,
  'Image by ' || CASE WHEN query <> 'de' THEN source ELSE 'Unknown' END || ' on Pixabay' AS attribution,
  width, height, query || ',' || source || ',' || format AS tags,
  ' ' || query || ',, ' || source || ' ,' || format || ', ' AS description, query
FROM rec"""
)
def pages_pixabay(spark, sf_dir):
    tags = F.concat(
        F.lit(" "), "lang", F.lit(",, "), "source", F.lit(" ,"), "format", F.lit(", ")
    )
    item = F.struct(
        F.col("ordinal").alias("id"), F.col("url").alias("pageURL"),
        F.when(F.col("lang") != "en", F.col("download_url")).alias("largeImageURL"),
        F.col("url").alias("webformatURL"),
        F.col("width").alias("imageWidth"), F.col("height").alias("imageHeight"),
        tags.alias("tags"),
        F.when(F.col("lang") != "de", F.col("source")).alias("user"),
        F.col("ordinal").alias("user_id"),
    )
    rows = records(spark, sf_dir).withColumn("lang", F.col("query"))
    pages = providers.parse_pages(_pages(rows, "hits", item), "pixabay")
    return _flat(providers.read_records(pages, "pixabay"))


def _short_name(key):
    choice = None
    for i, name in enumerate(LICENSES):
        test = key % len(LICENSES) == i
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return choice


SHORT_NAMES = "[" + ", ".join(f"'{n}'" for n in LICENSES) + "]"


def _wikimedia_pages(spark, sf_dir):
    """Web pages as file pages; the HTML plays the artist's credit line."""
    key = F.col("page_id")
    value = "value"
    info = F.struct(
        F.col("url"),
        F.length("html").cast("int").alias("width"),
        F.length("url").cast("int").alias("height"),
        F.when(F.contains("url", F.lit("?")), "video/ogg").otherwise("image/jpeg").alias("mime"),
        F.struct(
            F.struct(_short_name(key).alias(value)).alias("LicenseShortName"),
            F.struct(F.when(~F.contains("url", F.lit("#")), F.col("html")).alias(value)).alias("Artist"),
        ).alias("extmetadata"),
    )
    item = F.struct(
        F.when(F.length("url") % 10 == 0, F.lit(-1)).otherwise(key).alias("pageid"),
        F.concat(F.lit("File:a b "), key.cast("string"), F.lit(".jpg")).alias("title"),
        F.when(F.length("url") % 10 == 1, F.array().cast(T.ArrayType(T.NullType())))
        .otherwise(F.array(info))
        .alias("imageinfo"),
    )
    envelope = F.struct(F.struct(F.create_map(key.cast("string"), item).alias("pages")).alias("query"))
    return table(spark, sf_dir, "pages").select(F.to_json(envelope).alias("page"))


def _wikimedia_sql(accepted: dict[str, str]) -> str:
    kind = " ".join(f"WHEN '{name}' THEN '{value}'" for name, value in accepted.items())
    return f"""
WITH p AS (
  SELECT *, {SHORT_NAMES}[(page_id % {len(LICENSES)}) + 1] AS short,
    CASE WHEN contains(url, '#') THEN ''
      ELSE trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
    END AS artist
  FROM pages WHERE length(url) % 10 > 1 AND NOT contains(url, '?')),
k AS (SELECT *, CASE short {kind} END AS license_type FROM p)
SELECT 'wikimedia' AS source, page_id::VARCHAR AS source_id,
  'https://commons.wikimedia.org/wiki/File:a_b_' || page_id || '.jpg' AS url, url AS download_url,
  license_type,
  CASE license_type WHEN 'CC0-1.0' THEN 'https://creativecommons.org/publicdomain/zero/1.0/'
    WHEN 'CC-BY-4.0' THEN 'https://creativecommons.org/licenses/by/4.0/'
    ELSE 'https://creativecommons.org/licenses/by-sa/4.0/' END AS license_url,
  artist AS photographer, '' AS photographer_url,
  CASE WHEN artist <> '' THEN 'Image by ' || artist || ' via Wikimedia Commons'
    ELSE 'Image via Wikimedia Commons' END AS attribution,
  length(html)::INT AS width, length(url)::INT AS height, '' AS tags,
  'a b ' || page_id || '.jpg' AS description, 'w' AS query
FROM k WHERE license_type IS NOT NULL"""


def _wikimedia(spark, sf_dir, **options):
    pages = providers.parse_pages(_wikimedia_pages(spark, sf_dir), "wikimedia")
    return _flat(providers.read_records(pages, "wikimedia", "w", **options))


BASE = {"CC0": "CC0-1.0", "Public domain": "CC0-1.0", "CC-BY 4.0": "CC-BY-4.0"}


@check(_wikimedia_sql({**BASE, "CC-BY-NC 4.0": "CC-BY-4.0"}))
def pages_wikimedia(spark, sf_dir):
    return _wikimedia(spark, sf_dir)


@check(_wikimedia_sql({**BASE, "CC-BY-NC 4.0": "CC-BY-4.0", "CC-BY-SA 4.0": "CC-BY-SA-4.0"}))
def pages_wikimedia_share_alike(spark, sf_dir):
    return _wikimedia(spark, sf_dir, include_cc_by_sa=True)


@check(_wikimedia_sql({**BASE, "CC BY 4.0": "CC-BY-4.0"}))
def pages_wikimedia_strict(spark, sf_dir):
    return _wikimedia(spark, sf_dir, strict=True)


@check(
    f"""
WITH n AS (SELECT page_id, {SHORT_NAMES}[(page_id % {len(LICENSES)}) + 1] AS short FROM pages)
SELECT page_id, CASE WHEN short IN ('CC0', 'Public domain') THEN 'CC0-1.0'
  WHEN short IN ('CC-BY 4.0', 'CC-BY-NC 4.0') THEN 'CC-BY-4.0' END AS license_type
FROM n"""
)
def license_short_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", resolve_license(_short_name(F.col("page_id"))).license_type.alias("license_type")
    )


@check(
    f"""
WITH {INDEX} SELECT image_id,
  CASE WHEN license_url LIKE '%publicdomain%' THEN 'CC0-1.0' WHEN license_url LIKE '%BY/4.0%' THEN 'CC-BY-4.0'
    ELSE 'CC-BY-2.0' END AS license_type,
  CASE WHEN license_url LIKE '%publicdomain%' THEN 'CC0-1.0' WHEN license_url LIKE '%BY/4.0%' THEN 'CC-BY-4.0'
    WHEN license_url LIKE '%by/2.0%' THEN 'CC-BY-2.0' END AS strict_type
FROM images"""
)
def license_urls(spark, sf_dir):
    url = F.col("license_url")
    return _index_images(spark, sf_dir).select(
        "image_id",
        license_from_url(url).alias("license_type"),
        license_from_url(url, strict=True).alias("strict_type"),
    )


# Names and paths


@check(
    """
SELECT page_id,
  CASE WHEN ext IN ('jpg', 'png', 'webp', 'gif') THEN '.' || ext ELSE '.jpg' END AS from_url,
  '.png' AS from_format,
  'images/w_x/web_' || page_id || CASE WHEN ext IN ('jpg', 'png', 'webp', 'gif') THEN '.' || ext ELSE '.jpg' END
    AS path
FROM (SELECT page_id, lower(regexp_extract(
    list_last(string_split(string_split(url, '?')[1], '/')), '\\.([^.]*)$', 1)) AS ext FROM pages)"""
)
def file_names(spark, sf_dir):
    extension = tx.file_extension(F.col("url"), F.lit(""))
    name = tx.file_name(F.lit("web"), F.col("page_id").cast("string"), extension)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        tx.file_extension(F.col("url")).alias("from_url"),
        tx.file_extension(F.col("url"), F.lit("PNG")).alias("from_format"),
        tx.image_path(name, tx.query_label(F.lit("w x"))).alias("path"),
    )


@check(
    """
SELECT conv_id, turn, trim(unnest(string_split(text, ',')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
  AS query FROM conversations"""
)
def query_lists(spark, sf_dir):
    from framewright.plans.search import explode_queries

    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "query")
    return explode_queries(rows).select("conv_id", "turn", "query")


@check("SELECT doc_id, replace(text, ' ', '_') AS label FROM documents")
def query_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.query_label(F.col("text")).alias("label")
    )


@check(
    f"""
WITH {RECORDS} SELECT id, source, coalesce(local_path, '(null)') AS local_path, width, file_size_bytes,
  array_to_string(tags, ',') AS tags, description, coalesce(phash, '(null)') AS phash,
  strftime(downloaded_at, '%Y-%m-%d %H:%M:%S') AS downloaded_at, 22 AS n_keys
FROM rec"""
)
def record_json(spark, sf_dir):
    """Lossless JSON round trip; null fields stay in the text."""
    text = records(spark, sf_dir).select(tx.record_to_json().alias("json"))
    back = text.select(
        tx.record_from_json(F.col("json")).alias("r"),
        F.size(F.json_object_keys("json")).alias("n_keys"),
    )
    return back.select(
        "r.id", "r.source", F.coalesce("r.local_path", F.lit("(null)")).alias("local_path"),
        "r.width", "r.file_size_bytes", F.array_join("r.tags", ",").alias("tags"), "r.description",
        F.coalesce("r.phash", F.lit("(null)")).alias("phash"),
        F.date_format("r.downloaded_at", "yyyy-MM-dd HH:mm:ss").alias("downloaded_at"), "n_keys",
    )


@check(
    """
SELECT count(*) AS n, count(DISTINCT source_id) AS n_ids, bool_and(true) AS shaped, 0 AS size_sum,
  0 AS n_tags, '' AS description FROM (SELECT doc_id::VARCHAR AS source_id FROM documents)"""
)
def record_defaults(spark, sf_dir):
    from framewright.operators.aggregates import with_record_defaults

    rows = with_record_defaults(records(spark, sf_dir).select("source", "source_id", *[
        "url", "download_url", "license_type", "license_url", "attribution", "photographer",
        "photographer_url", "width", "height",
    ]))
    return rows.agg(
        F.count("*").alias("n"),
        F.countDistinct("id").alias("n_ids"),
        F.bool_and(F.rlike("id", F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))).alias("shaped"),
        F.sum("file_size_bytes").alias("size_sum"),
        F.sum(F.size("tags")).alias("n_tags"),
        F.max("description").alias("description"),
    )


@check(f"WITH {RECORDS} SELECT id, 'stamped' AS dataset_name, 'asked' AS query FROM rec")
def stamp(spark, sf_dir):
    from framewright.operators.aggregates import stamp as apply

    return apply(records(spark, sf_dir), "stamped", "asked").select("id", "dataset_name", "query")


# Manifest


@check(
    f"""
WITH {RECORDS} SELECT id, source, source_id, url, coalesce(local_path, '') AS local_path, license_type,
  width, height, file_size_bytes, array_to_string(tags, ',') AS tags, description, ordinal FROM rec"""
)
def manifest_scan(spark, sf_dir):
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.write(records(spark, sf_dir))
    return manifest.read().select(
        "id", "source", "source_id", "url", F.coalesce("local_path", F.lit("")).alias("local_path"),
        "license_type", "width", "height", "file_size_bytes", F.array_join("tags", ",").alias("tags"),
        "description", "ordinal",
    )


@check(
    f"""
WITH {RECORDS}
SELECT 'source' AS looked_up, id FROM rec WHERE source = 'src1'
UNION ALL SELECT 'id', id FROM rec WHERE id = 'doc-7'
UNION ALL SELECT 'pair', id FROM rec
WHERE (source, source_id) = (SELECT (source, source_id) FROM rec ORDER BY ordinal LIMIT 1)"""
)
def manifest_lookup(spark, sf_dir):
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.write(records(spark, sf_dir))
    first = manifest.read().orderBy("ordinal").first()
    keys = {
        "source": {"source": "src1"},
        "id": {"id": "doc-7"},
        "pair": {"source": first["source"], "source_id": first["source_id"]},
    }
    parts = [
        manifest.lookup(**k).select(F.lit(name).alias("looked_up"), "id") for name, k in keys.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@check(f"WITH {PHASH} SELECT phash FROM hashes")
def manifest_hashes(spark, sf_dir):
    from framewright.functions.pixels import phash

    hashed = images(spark, sf_dir).select(phash("height", "width", "nChannels", "data").alias("phash"))
    missing = hashed.withColumn("phash", F.lit(None).cast("string"))
    return known_hashes(hashed.unionByName(missing))


UPSERTED = f"""
WITH {RECORDS}, b AS (
  SELECT r.ordinal FROM rec r JOIN labels l ON l.doc_id = r.ordinal)
SELECT id, CASE WHEN b.ordinal IS NULL THEN description ELSE 'updated' END AS description,
  CASE WHEN b.ordinal IS NULL THEN r.ordinal
    ELSE (SELECT max(ordinal) + 1 FROM rec) + r.ordinal - (SELECT min(ordinal) FROM b) END AS ordinal
FROM rec r LEFT JOIN b ON b.ordinal = r.ordinal"""


@check(UPSERTED)
def manifest_upsert(spark, sf_dir):
    """Labelled documents come a second time; the later row replaces and moves to the end."""
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    everything = records(spark, sf_dir)
    manifest.upsert(everything)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"))
    batch = everything.join(labelled, "ordinal", "left_semi").withColumn("description", F.lit("updated"))
    manifest.upsert(batch)
    return manifest.read().select("id", "description", "ordinal")


@check(
    f"""
SELECT * FROM ({UPSERTED}) WHERE id NOT IN (SELECT 'doc-' || doc_id FROM documents WHERE lang = 'fr')"""
)
def manifest_partitions(spark, sf_dir):
    """The same upsert in partitions by id, and then all French documents go."""
    manifest = PartitionedManifest(spark, scratch_path(spark, "manifest"), 16)
    everything = records(spark, sf_dir)
    manifest.upsert(everything)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"))
    manifest.upsert(everything.join(labelled, "ordinal", "left_semi").withColumn("description", F.lit("updated")))
    manifest.remove_many(everything.where(F.col("query") == "fr"))
    return manifest.read().select("id", "description", "ordinal")


@check(
    f"""
WITH {RECORDS} SELECT id, (SELECT count(*) FROM labels) AS n_removed FROM rec
WHERE ordinal NOT IN (SELECT doc_id FROM labels)"""
)
def manifest_remove(spark, sf_dir):
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.write(records(spark, sf_dir))
    ids = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id")
    )
    unknown = ids.select(F.concat(F.lit("no-"), "id").alias("id"))
    removed = manifest.remove_many(ids.unionByName(unknown).unionByName(ids))
    return manifest.read().select("id", F.lit(removed).cast("bigint").alias("n_removed"))


@check(f"WITH {RECORDS} SELECT count(*) AS n FROM rec")
def manifest_count(spark, sf_dir):
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.write(records(spark, sf_dir))
    return records(spark, sf_dir).agg(F.lit(manifest.count()).cast("bigint").alias("n"))


# Image files


@F.pandas_udf(T.StringType())
def _write_png(paths: pd.Series, pixels: pd.Series) -> pd.Series:
    from framewright.sinks.files import file_system

    for path, data in zip(paths, pixels):
        rows = b"".join(b"\0" + data[i : i + 32] for i in range(0, 1024, 32))

        def chunk(kind, body):
            return (
                struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
            )

        header = struct.pack(">IIBBBBB", 32, 32, 8, 0, 0, 0, 0)
        png = (
            b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows))
            + chunk(b"IEND", b"")
        )
        system, name = file_system(path)
        with system.open_output_stream(name) as out:
            out.write(png)
    return paths


def png_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Write one PNG per document; returns their paths."""
    from framewright.sinks.files import make_dirs

    make_dirs(spark, folder)
    path = F.concat(F.lit(folder + "/"), F.col("ordinal").cast("string"), F.lit(".png"))
    written = images(spark, sf_dir).select(_write_png(path, "data").alias("path"))
    out = scratch_path(spark, "written")
    written.write.parquet(out)
    return spark.read.parquet(out)


@check(
    f"""
WITH {SIGNALS}
SELECT ordinal, 32 AS width, 32 AS height, 'PNG' AS format, phash,
  round(blur_score, 3) AS blur_score, round(gray_variance, 3) AS gray_variance
FROM hashes JOIN sharp USING (ordinal)"""
)
def image_files(spark, sf_dir):
    """PNG files written from the documents, scanned, decoded and measured."""
    folder = scratch_path(spark, "png")
    png_files(spark, sf_dir, folder)
    signals = image_signals(read_image_files(spark, folder, "*.png"))
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")
    return signals.select(
        number.alias("ordinal"), "width", "height", "format", "phash",
        F.round("blur_score", 3).alias("blur_score"),
        F.round("gray_variance", 3).alias("gray_variance"),
    )


@check(f"WITH {BLUR} SELECT ordinal, round(blur_score, 3) AS blur_score FROM sharp")
def blur_score(spark, sf_dir):
    from framewright.functions.pixels import blur_score as score

    return images(spark, sf_dir).select(
        "ordinal", F.round(score("height", "width", "nChannels", "data"), 3).alias("blur_score")
    )


@check(f"WITH {BLUR} SELECT ordinal, round(gray_variance, 3) AS gray_variance FROM sharp")
def gray_variance(spark, sf_dir):
    from framewright.functions.pixels import gray_variance as score

    return images(spark, sf_dir).select(
        "ordinal", F.round(score("height", "width", "nChannels", "data"), 3).alias("gray_variance")
    )


@check(f"WITH {PHASH} SELECT ordinal, phash FROM hashes")
def phash(spark, sf_dir):
    from framewright.functions.pixels import phash as hashed

    return images(spark, sf_dir).select(
        "ordinal", hashed("height", "width", "nChannels", "data").alias("phash")
    )


@check("SELECT doc_id::VARCHAR AS name FROM documents")
def copied_images(spark, sf_dir):
    """Distributed copy of image files, listed at the target."""
    from framewright.sinks.files import copy_files

    source, target = scratch_path(spark, "png"), scratch_path(spark, "copy")
    paths = png_files(spark, sf_dir, source)
    copy_files(
        paths.select(
            F.col("path").alias("src"),
            F.concat(F.lit(target + "/"), tx.base_name(F.col("path"))).alias("dst"),
        )
    )
    return list_files(spark, target, "*.png").select(
        F.regexp_extract("path", r"(\d+)\.png$", 1).alias("name")
    )


@F.pandas_udf(T.StringType())
def _write_kind(paths: pd.Series, pixels: pd.Series, kinds: pd.Series) -> pd.Series:
    """Files of several contents under whatever name: PNG, BMP, the start of a WebP, text, nothing."""
    from framewright.sinks.files import file_system

    for path, data, kind in zip(paths, pixels, kinds):
        if kind == 0:
            _write_png.func(pd.Series([path]), pd.Series([data]))
            continue
        colors = b"".join(bytes((b, b, b)) for i in range(992, -1, -32) for b in data[i : i + 32])
        bmp = struct.pack("<2sIHHI", b"BM", 54 + len(colors), 0, 0, 54)
        bmp += struct.pack("<IiiHHIIiiII", 40, 32, 32, 1, 24, 0, len(colors), 0, 0, 0, 0) + colors
        body = {1: bmp, 2: b"RIFF\x10\0\0\0WEBPVP8 ", 3: b"no image at all", 4: b""}[kind]
        system, name = file_system(path)
        with system.open_output_stream(name) as out:
            out.write(body)
    return paths


def mixed_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """One file named .jpg per document, its content by doc_id."""
    from framewright.sinks.files import make_dirs

    make_dirs(spark, folder)
    path = F.concat(F.lit(folder + "/"), F.col("ordinal").cast("string"), F.lit(".jpg"))
    kind = (F.col("ordinal") % 5).cast("int")
    written = images(spark, sf_dir).select(_write_kind(path, "data", kind).alias("path"))
    written.write.parquet(scratch_path(spark, "written"))


def _number(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.[a-z]+$", 1).cast("bigint")


@check(
    """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'BMP' WHEN 2 THEN 'WEBP' END AS format,
  CASE WHEN doc_id % 5 < 2 THEN 32 END AS width, doc_id % 5 = 4 AS empty
FROM documents"""
)
def image_formats(spark, sf_dir):
    """The format is that of the content: all files are named .jpg, some are no images, some empty."""
    folder = scratch_path(spark, "mixed")
    mixed_files(spark, sf_dir, folder)
    signals = image_signals(read_image_files(spark, folder, "*.jpg"))
    return signals.select(_number().alias("doc_id"), "format", "width", (F.col("file_size_bytes") == 0).alias("empty"))


@check("SELECT doc_id FROM documents WHERE doc_id % 5 = 4")
def empty_files(spark, sf_dir):
    """Empty files, in nested folders, are listed."""
    from framewright.sinks.files import touch_files

    folder = scratch_path(spark, "empty")
    rows = table(spark, sf_dir, "documents").where("doc_id % 5 = 4")
    touch_files(
        rows.select(F.concat(F.lit(f"{folder}/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".png")).alias("path"))
    )
    return list_files(spark, folder, "*.{jpg,png}").where("length = 0").select(_number().alias("doc_id"))


# Broken pages: by doc_id, a sound page of one hit; one cut off behind a whole hit; one cut off within
# its only hit; a value of another type; an error in place of hits.


def _broken_pages(spark, sf_dir) -> DataFrame:
    page = F.col("page")
    hit = F.regexp_extract(page, r"(?s)^\{\"results\":\[(.*)\]\}$", 1)
    number = F.regexp_extract(page, r'"id":"(\d+)"', 1)
    kind = number.cast("bigint") % 5
    return _unsplash_pages(spark, sf_dir).select(
        number.cast("bigint").alias("ordinal"),
        F.when(kind == 1, F.concat(F.lit('{"total":2,"results":['), hit, F.lit(","), F.substring(hit, 1, 40)))
        .when(kind == 2, F.concat(F.lit('{"results":['), F.substring(hit, 1, 40)))
        .when(kind == 3, F.regexp_replace(page, r'"height":\d+', '"height":"tall"'))
        .when(kind == 4, F.concat(F.lit('{"errors":["limit"],"id":"'), number, F.lit('"}')))
        .otherwise(page)
        .alias("value"),
    )


@check(
    f"""
SELECT * REPLACE (CASE WHEN source_id::BIGINT % 5 = 3 THEN 0 ELSE height END AS height)
FROM ({UNSPLASH.replace("description, query", "description, 'all' AS query")}) WHERE source_id::BIGINT % 5 IN (0, 1, 3)"""
)
def pages_broken(spark, sf_dir):
    """Whole hits of broken pages are kept."""
    path = scratch_path(spark, "pages")
    _broken_pages(spark, sf_dir).select("value").write.text(path)
    return _flat(providers.read_records(providers.read_api_pages(spark, path, "unsplash"), "unsplash", "all"))


@check(
    """
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'wrong_type' WHEN 4 THEN 'no_hits' ELSE 'not_json' END AS reason,
  CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END::INT AS rescued_hits
FROM documents WHERE doc_id % 5 > 0"""
)
def pages_rejected(spark, sf_dir):
    """Every page that is not sound is listed with its reason."""
    path = scratch_path(spark, "pages")
    _broken_pages(spark, sf_dir).select("value").write.text(path)
    number = F.regexp_extract("page", r'"id":"(\d+)"', 1).cast("bigint")
    return providers.read_rejected_pages(spark, path, "unsplash").select(
        number.alias("doc_id"), "reason", "rescued_hits"
    )


# Streaming


@check(
    """
WITH d AS (SELECT doc_id, lang IN ('de', 'en') AS early FROM documents),
p AS (SELECT doc_id, early AND doc_id % 7 > 0 AS kept FROM d)
SELECT doc_id, kept, row_number() OVER (ORDER BY kept DESC, doc_id) - 1 AS place FROM p"""
)
def incremental_ingest_order(spark, sf_dir):
    """Records enter in landing order; those whose file is gone are picked up again."""
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    pages = _unsplash_pages(spark, sf_dir).select(
        F.regexp_extract("page", r'"id":"(\d+)"', 1).cast("bigint").alias("ordinal"), F.col("page").alias("value"), "query"
    ).where("ordinal is not null")
    files = table(spark, sf_dir, "documents").where("doc_id % 7 > 0").select(
        F.concat(F.lit("img/"), "doc_id", F.lit(".jpg")).alias("path")
    )
    for batch in (pages.where(F.col("query").isin("en", "de")), pages):
        batch.orderBy("ordinal").select("value").write.mode("append").text(landing, compression="gzip")
        run = incremental_ingest(spark, landing, manifest, "unsplash", state, "q", files=lambda: files)
        run.awaitTermination()
        if batch is not pages:
            path = F.concat(F.lit("img/"), "source_id", F.lit(".jpg"))
            manifest.write(manifest.read().withColumn("local_path", path))
    number = F.col("source_id").cast("bigint")
    rows = manifest.read().select(
        number.alias("doc_id"), F.col("local_path").isNotNull().alias("kept"), F.col("ordinal").alias("order")
    )
    return ordering.with_ordinal(rows, "order", name="place").select("doc_id", "kept", "place")


@check(f"SELECT source, source_id, description, 'q' AS query FROM ({UNSPLASH})")
def incremental_ingest_pages(spark, sf_dir):
    """Pages land twice, the second time with the first again; each record is kept once."""
    landing, state = scratch_path(spark, "landing"), scratch_path(spark, "state")
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    pages = _unsplash_pages(spark, sf_dir).withColumnRenamed("page", "value")
    first = pages.where(F.col("query").isin("en", "de")).select("value")
    for batch in (first, pages.select("value")):
        batch.write.mode("append").text(landing, compression="gzip")
        incremental_ingest(spark, landing, manifest, "unsplash", state, "q").awaitTermination()
    return manifest.read().select("source", "source_id", "description", "query")
