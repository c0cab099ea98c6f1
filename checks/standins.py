"""The driver's tables as image records, pages, files and pixels.

The tables hold no images. Documents play the part of images: the words of a
whole text, hashed into a 32x32 grid, are its pixels, so that near-copies of a
text are near-copies of an image. All of it is derived by Spark, and the SQL
below derives the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.session import spread

SIDE = 32
#: Images that are counted at once.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of the manifest, ordinal = doc_id."""
    text = F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), text)
    license_type = (
        F.when(F.col("lang") == "en", "CC0-1.0")
        .when(F.col("lang") == "fr", "CC-BY-2.0")
        .when(F.col("lang") == "de", "CC-BY-4.0")
        .otherwise(F.col("source"))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), text).alias("id"),
        "source",
        text.alias("source_id"),
        url.alias("url"),
        F.concat(url, F.lit(".jpg?fm="), "lang").alias("download_url"),
        F.when(
            F.col("source") != "src3",
            F.concat(F.lit("data/"), "lang", F.lit("/"), "source", F.lit(".png")),
        ).alias("local_path"),
        license_type.alias("license_type"),
        F.lit("").alias("license_url"),
        F.concat(F.lit("Photo by "), "source", F.lit(" ("), "lang", F.lit(")")).alias("attribution"),
        F.col("source").alias("photographer"),
        F.lit("").alias("photographer_url"),
        (F.col("n_chars") % 1500).cast("int").alias("width"),
        ((F.col("n_chars") * 7 + F.col("doc_id")) % 1100).cast("int").alias("height"),
        (F.col("n_chars") * 8).alias("file_size_bytes"),
        F.lit("png").alias("format"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("description"),
        F.lit(None).cast("double").alias("blur_score"),
        F.lit(None).cast("string").alias("phash"),
        F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("downloaded_at"),
        F.col("lang").alias("query"),
        F.lit("docs").alias("dataset_name"),
        F.col("doc_id").alias("ordinal"),
    )


RECORDS = """
rec AS (
  SELECT 'doc-' || doc_id AS id, source, doc_id::VARCHAR AS source_id,
    'https://' || source || '.example/' || doc_id AS url,
    'https://' || source || '.example/' || doc_id || '.jpg?fm=' || lang AS download_url,
    CASE WHEN source <> 'src3' THEN 'data/' || lang || '/' || source || '.png' END AS local_path,
    CASE lang WHEN 'en' THEN 'CC0-1.0' WHEN 'fr' THEN 'CC-BY-2.0' WHEN 'de' THEN 'CC-BY-4.0'
      ELSE source END AS license_type,
    '' AS license_url, 'Photo by ' || source || ' (' || lang || ')' AS attribution,
    source AS photographer, '' AS photographer_url,
    (n_chars % 1500)::INT AS width, ((n_chars * 7 + doc_id) % 1100)::INT AS height,
    n_chars * 8 AS file_size_bytes, 'png' AS format, [lang, source] AS tags,
    text AS description, NULL::DOUBLE AS blur_score, NULL::VARCHAR AS phash,
    TIMESTAMP '2024-01-02 03:04:05' AS downloaded_at, lang AS query, 'docs' AS dataset_name,
    doc_id AS ordinal
  FROM documents)"""


def cells(text: Column) -> Column:
    """The cell of each word of a text, from the first bits of the word's MD5."""
    words = F.split(text, " ")
    return F.transform(
        words, lambda word: F.shiftright(F.conv(F.substring(F.md5(word), 1, 3), 16, 10).cast("int"), 2).cast("smallint")
    )


@F.arrow_udf(T.BinaryType())
def raster(words: pa.Array) -> pa.Array:
    """32x32 gray pixels: words counted by cell, scaled so that the fullest is 255."""
    images = []
    for start in range(0, len(words), ROWS):
        part = words.slice(start, ROWS)
        row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
        counts = np.bincount(row * SIDE * SIDE + part.flatten().to_numpy(), minlength=len(part) * SIDE * SIDE)
        counts = counts.reshape(len(part), SIDE * SIDE)
        pixels = (255 * counts // counts.max(axis=1, keepdims=True)).astype(np.uint8)
        images += [image.tobytes() for image in pixels]
    return pa.array(images, pa.binary())


#: The first bytes of the stand-in files, by doc_id, and the formats that these say.
HEADS = ("89504E470D0A1A0A0000000D49484452", "FFD8FFE000104A464946000101000001", "52494646100000005745425056503820", "00")
FORMATS = "CASE doc_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'WEBP' ELSE 'png' END"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in images with the first bytes of files, of which those of every fourth are unknown."""
    known = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("ordinal") % 4 + 1).cast("int"))
    return images(spark, sf_dir).withColumn("head", F.unhex(known))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded pixels of every document, in the columns of Spark's image source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return spread(documents, "doc_id").select(
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("raster/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.col("n_chars").alias("length"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.lit(1).alias("nChannels"),
        raster(cells(F.col("text"))).alias("data"),
    )


RASTER = """
word AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL),
cell AS (
  SELECT doc_id, (('0x' || substr(md5(w), 1, 3))::INT >> 2) AS c, sum(n) AS n
  FROM word GROUP BY ALL),
px AS (
  SELECT doc_id, c // 32 AS r, c % 32 AS c,
    (255 * n // max(n) OVER (PARTITION BY doc_id))::INT AS v
  FROM cell)"""

HASHES = """
coef AS (
  SELECT doc_id, u, w,
    round(sum(v * 2 * cos(pi() * u * (2 * r + 1) / 64) * 2 * cos(pi() * w * (2 * c + 1) / 64)), 6) AS x
  FROM px, range(8) AS a(u), range(8) AS b(w) GROUP BY ALL),
bits AS (
  SELECT doc_id, sum(CASE WHEN x > med THEN (1::HUGEINT << (63 - (u * 8 + w))::INT) ELSE 0 END)::UBIGINT
    AS bits
  FROM (SELECT *, median(x) OVER (PARTITION BY doc_id) AS med FROM coef) GROUP BY doc_id),
hashes AS (
  SELECT doc_id AS ordinal, bits, lower(lpad(to_hex(bits), 16, '0')) AS phash FROM bits)"""

SHARP = """
grid AS (
  SELECT doc_id, list(v ORDER BY r, c) AS g FROM (
    SELECT d.doc_id, a.r, b.c, coalesce(px.v, 0) AS v
    FROM documents d, range(32) AS a(r), range(32) AS b(c)
    LEFT JOIN px ON px.doc_id = d.doc_id AND px.r = a.r AND px.c = b.c) GROUP BY doc_id),
sharp AS (
  SELECT doc_id AS ordinal, list_aggregate(g, 'var_pop') AS gray_variance,
    list_aggregate(list_transform(range(1024), lambda i:
      g[(CASE WHEN i < 32 THEN i + 32 ELSE i - 32 END) + 1]
      + g[(CASE WHEN i >= 992 THEN i - 32 ELSE i + 32 END) + 1]
      + g[(CASE WHEN i % 32 = 0 THEN i + 1 ELSE i - 1 END) + 1]
      + g[(CASE WHEN i % 32 = 31 THEN i - 1 ELSE i + 1 END) + 1]
      - 4 * g[i + 1]), 'var_pop') AS blur_score
  FROM grid)"""

PHASH = f"{RASTER},{HASHES}"
BLUR = f"{RASTER},{SHARP}"
SIGNALS = f"{RASTER},{HASHES},{SHARP}"


def greedy(nodes: str, threshold: int = 10, seeds: str | None = None, name: str = "kept") -> str:
    """CTEs for greedy removal over ``nodes`` (ordinal, bits), one row at a time.

    ``name`` becomes a table of the kept ordinals.
    """
    start = f"(SELECT coalesce(list(bits), []) FROM {seeds})" if seeds else "[]::UBIGINT[]"
    return f"""
{name}_nodes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY ordinal) AS i, ordinal, bits FROM {nodes}),
{name}_steps AS (
  SELECT 0::BIGINT AS i, {start} AS seen, []::BIGINT[] AS kept
  UNION ALL
  SELECT n.i,
    CASE WHEN near THEN seen ELSE list_append(seen, n.bits) END,
    CASE WHEN near THEN kept ELSE list_append(kept, n.ordinal) END
  FROM (
    SELECT n.i, n.bits, n.ordinal, s.seen, s.kept,
      len(list_filter(s.seen, lambda b: bit_count(xor(b, n.bits)::HUGEINT) <= {threshold})) > 0 AS near
    FROM {name}_steps s JOIN {name}_nodes n ON n.i = s.i + 1) n),
{name} AS (
  SELECT unnest(kept) AS ordinal FROM (SELECT kept FROM {name}_steps ORDER BY i DESC LIMIT 1))"""
