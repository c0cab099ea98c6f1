"""Gates, joins, order, near-duplicates, summaries, sinks and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.catalog import check
from checks.standins import FORMATS, PHASH, RECORDS, SIGNALS, greedy, heads, images, records, table
from framewright.functions import pixels
from framewright.operators import aggregates, gates, joins, ordering, sets
from framewright.operators.dedup import first_near, mark_duplicates, near_dedup, near_pairs
from framewright.operators.gates import Gate
from framewright.plans.curate import curate
from framewright.plans.maintain import merge_records, refilter
from framewright.plans.search import search_all
from framewright.session import materialize, scratch_path
from framewright.sinks import layouts
from framewright.sinks.files import stat_files
from framewright.sources.index import search_index
from framewright.sources.manifest import Manifest

# Quality


@check(
    f"""
WITH {RECORDS} SELECT id,
  CASE WHEN local_path IS NULL THEN 'no_local_file'
    WHEN query = 'es' THEN 'file_not_found'
    WHEN file_size_bytes < 10240 THEN 'file_too_small'
    WHEN height < 20 THEN 'invalid_image'
    WHEN width < 256 THEN 'width' WHEN height < 256 THEN 'height'
    WHEN greatest(width, height)::DOUBLE / greatest(least(width, height), 1) > 4.0 THEN 'aspect_ratio'
    WHEN ordinal::DOUBLE < 100.0 AND query <> 'fr' THEN 'too_blurry' ELSE '' END AS reason_code
FROM rec"""
)
def quality_gate(spark, sf_dir):
    """Signals as columns; the score of French documents is unknown."""
    rows = records(spark, sf_dir).withColumns(
        {
            "file_exists": F.col("query") != "es",
            "width": F.when(F.col("height") >= 20, F.col("width")),
            "blur_score": F.when(F.col("query") != "fr", F.col("ordinal").cast("double")),
        }
    )
    return gates.quality_gate(rows).select("id", "reason_code")


@check(
    f"""
WITH {RECORDS} SELECT id, CASE WHEN local_path IS NULL THEN 'no_local_file' WHEN width < 10 THEN 'width'
    WHEN height < 256 THEN 'height' ELSE '' END AS reason_code,
  CASE WHEN local_path IS NULL THEN 'no local file' WHEN width < 10 THEN 'width ' || width || ' < 10'
    WHEN height < 256 THEN 'height ' || height || ' < 256' ELSE '' END AS reason
FROM rec"""
)
def quality_gate_reasons(spark, sf_dir):
    rows = records(spark, sf_dir)
    return gates.quality_gate(
        rows, min_width=10, max_aspect_ratio=1e9, min_file_size=0, min_sharpness=None, exists=F.lit(True)
    ).select("id", "reason_code", "reason")


QUERY_VECTORS = """
q AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
s AS (
  SELECT e.vec_id, e.label,
    CASE WHEN e.label % 3 <> 2 THEN list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]) END AS sim
  FROM embeddings e JOIN q ON q.label = e.label)"""


@check(
    f"""
WITH {QUERY_VECTORS} SELECT vec_id, coalesce(round(sim, 6), -9) AS similarity,
  CASE WHEN sim < 0.2 THEN 'semantic' ELSE '' END AS reason_code FROM s"""
)
def semantic_gate(spark, sf_dir):
    """Vectors against the first vector of their label, which plays the query text.
    Labels without a query vector cannot be scored and pass."""
    rows = table(spark, sf_dir, "embeddings").withColumn("query", F.col("label").cast("string"))
    first = ordering.first_wins(rows.select("query", "label", "embedding", "vec_id"), ["query"], "vec_id")
    queries = first.where("label % 3 <> 2").select("query", F.col("embedding").alias("query_embedding"))
    gated = gates.semantic_gate(rows, queries, path=None, exists=None)
    return gated.select(
        "vec_id", F.coalesce(F.round("similarity", 6), F.lit(-9.0)).alias("similarity"), "reason_code"
    )


def _files(spark, sf_dir) -> DataFrame:
    """Files of the labelled documents, one path per document."""
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("file:/raster/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.col("quality").cast("bigint").alias("length"),
    )


def _with_own_path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("local_path", F.concat(F.lit("/raster/"), "ordinal", F.lit(".png")))


@check(f"WITH {RECORDS} SELECT id FROM rec WHERE ordinal IN (SELECT doc_id FROM labels)")
def files_present(spark, sf_dir):
    return gates.has_file(_with_own_path(records(spark, sf_dir)), _files(spark, sf_dir)).select("id")


@check(f"WITH {RECORDS} SELECT id, url FROM rec WHERE url <> '' AND ordinal % 3 <> 0")
def nonempty_urls(spark, sf_dir):
    """A search leaves out images without a URL: every third has none."""
    rows = records(spark, sf_dir)
    url = F.when(F.col("ordinal") % 3 == 0, "").otherwise(F.col("url"))
    images = rows.select(F.col("id").alias("image_id"), url.alias("original_url"))
    labels = rows.select(F.col("id").alias("image_id"), F.lit("/m/1").alias("label_name"))
    classes = spark.createDataFrame([("/m/1", "Thing")], "label_name string, display_name string")
    found = search_index(classes, images, labels, "thing")
    return found.select(F.col("image_id").alias("id"), F.col("original_url").alias("url"))


@check(f"WITH {RECORDS} SELECT id FROM rec WHERE source IN ('src1', 'src2')")
def source_allow_list(spark, sf_dir):
    known = [f"src{i}" for i in range(20)]
    return joins.allowed_sources(records(spark, sf_dir), [" SRC1", "src2 ", "nowhere"], known).select("id")


# Joins


@check(
    f"""
WITH {RECORDS} SELECT r.id, CASE WHEN l.quality = 1 THEN 'existing' ELSE 'todo' END AS state,
  CASE WHEN l.quality = 1 THEN 'kept' ELSE r.description END AS description
FROM rec r LEFT JOIN labels l ON l.doc_id = r.ordinal"""
)
def resume(spark, sf_dir):
    """Manifest: labelled documents. Files: those of quality 1."""
    candidates = _with_own_path(records(spark, sf_dir))
    labels = table(spark, sf_dir, "labels")
    known = labels.select(F.col("doc_id").alias("ordinal"))
    manifest = candidates.join(known, "ordinal", "left_semi").withColumn("description", F.lit("kept"))
    files = _files(spark, sf_dir).where("length = 1")
    existing, todo = joins.resume_join(candidates, manifest, files)
    return existing.select("id", F.lit("existing").alias("state"), "description").unionByName(
        todo.select("id", F.lit("todo").alias("state"), "description")
    )


@check(
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'original' WHEN 'O' THEN 'thumbnail' ELSE 'none' END AS landed_from,
  CASE o_orderstatus WHEN 'F' THEN 'a' || o_orderkey WHEN 'O' THEN 'b' || o_orderkey ELSE '' END AS landed_path
FROM orders"""
)
def thumbnail_fallback(spark, sf_dir):
    """Finished orders have landed in full, open ones as thumbnail, others not at all."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    rows = orders.select(
        "o_orderkey", F.lit("openimages").alias("source"), key.alias("source_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("u"), key)).alias("download_url"),
    )
    thumbs = orders.select(key.alias("image_id"), F.concat(F.lit("t"), key).alias("thumbnail_url"))
    done = orders.where("o_orderstatus = 'F'")
    full = done.select(F.concat(F.lit("u"), key).alias("url"), F.concat(F.lit("a"), key).alias("path"))
    small = orders.where("o_orderstatus in ('F', 'O')").select(
        F.concat(F.lit("t"), key).alias("url"), F.concat(F.lit("b"), key).alias("path")
    )
    landed = full.unionByName(small).withColumn("length", F.lit(1))
    return joins.thumbnail_fallback(rows, landed, thumbs).select(
        "o_orderkey", F.coalesce("landed_from", F.lit("none")).alias("landed_from"),
        F.coalesce("landed_path", F.lit("")).alias("landed_path"),
    )


@check(f"WITH {RECORDS} SELECT id, CASE WHEN source IN ('src4', 'src5') THEN source ELSE 'src4' END AS adapter FROM rec")
def source_adapters(spark, sf_dir):
    return joins.record_source_join(records(spark, sf_dir), ["src4", "src5"]).select("id", "adapter")


# Order


@check("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS ordinal FROM orders")
def ordinals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.with_ordinal(rows, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "ordinal")


@check(
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag"
    " ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS place FROM lineitem"
)
def positions_in_large_groups(spark, sf_dir):
    """Three groups hold all line items; none is numbered in one task."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    return ordering.with_position(
        rows, ["l_shipdate", "l_orderkey", "l_linenumber"], within=["l_returnflag"], name="place"
    ).select("l_orderkey", "l_linenumber", "place")


def split_sql(rows: str, key: str, val: float, test: float, names=("train", "val", "test")) -> str:
    return f"""
sized AS (SELECT count(*) AS n FROM {rows}),
tests AS (SELECT n, least(greatest(floor(n * {test}::DOUBLE), {1 if test > 0 else 0}), n) AS t FROM sized),
cuts AS (SELECT n, t, least(greatest(floor(n * {val}::DOUBLE), {1 if val > 0 else 0}), n - t) AS v FROM tests),
parted AS (
  SELECT r.*, CASE WHEN i < n - t - v THEN '{names[0]}' WHEN i < n - t THEN '{names[1]}' ELSE '{names[2]}' END AS split,
    i, n, t, v
  FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS i FROM {rows}) r, cuts)"""


@check(f"WITH {split_sql('orders', 'o_orderkey', 0.29, 0.05)} SELECT o_orderkey, split FROM parted")
def splits(spark, sf_dir):
    return ordering.assign_split(table(spark, sf_dir, "orders"), 0.29, 0.05, order="o_orderkey").select(
        "o_orderkey", "split"
    )


@check(
    f"WITH {split_sql('events', 'event_id * 7919 - 4000000', 0.1, 0.0)}"
    " SELECT event_id, split FROM parted"
)
def splits_of_sparse_order(spark, sf_dir):
    """Cut values of an order with gaps, found by histograms."""
    rows = table(spark, sf_dir, "events").withColumn("ordinal", F.col("event_id") * 7919 - 4000000)
    return ordering.assign_split(rows).select("event_id", "split")


def _quota_sql(count: int, sources: int) -> str:
    base, extra = divmod(count, sources)
    return f"""
WITH d AS (SELECT *, substr(source, 4)::INT AS s FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM d WHERE s < {sources})
SELECT doc_id FROM r WHERE rn <= {base} + CASE WHEN s < {extra} THEN 1 ELSE 0 END"""


def _quota(spark, sf_dir, count: int, sources: int):
    rows = table(spark, sf_dir, "documents").withColumn("query", F.col("lang"))
    names = [f"src{i}" for i in range(sources)]
    return ordering.source_quota(rows, names, count, rank="doc_id").select("doc_id")


@check(_quota_sql(47, 8))
def source_quotas(spark, sf_dir):
    return _quota(spark, sf_dir, 47, 8)


@check(
    "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus"
    " ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 4000 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"
)
def source_quotas_large(spark, sf_dir):
    """Quotas beyond the window limit use distributed positions."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("query"), "l_orderkey", "l_linenumber",
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("rank"),
    )
    return ordering.source_quota(rows, ["O", "F"], 8001).select("l_orderkey", "l_linenumber")


@check("SELECT lang, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY lang")
def first_row_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return ordering.first_wins(rows, ["lang"], "doc_id")


@check("SELECT source, max(doc_id) AS doc_id, arg_max(text, doc_id) AS text FROM documents GROUP BY source")
def last_row_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return ordering.last_wins(rows, ["source"], "doc_id")


@check(
    f"""
WITH {RECORDS}, n AS (
  SELECT *, list_last(string_split(coalesce(local_path, 'x/none.png'), '/')) AS file_name FROM rec)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY ordinal) = 1 THEN file_name
  ELSE source || '_' || source_id || '.png' END AS file_name
FROM n"""
)
def name_collisions(spark, sf_dir):
    from framewright.functions.text import base_name

    path = F.coalesce("local_path", F.lit("x/none.png"))
    rows = records(spark, sf_dir).withColumn("file_name", base_name(path))
    return ordering.resolve_name_collision(rows).select("id", "file_name")


@check("SELECT source AS key, count(*) AS \"count\", min(doc_id) AS first_seen FROM documents GROUP BY source")
def frequency_order(spark, sf_dir):
    counted = aggregates.counts_by(records(spark, sf_dir), "source")
    return counted.select(F.col("source").alias("key"), "count", "first_seen")


@check("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_first(spark, sf_dir):
    """Top-k report: the 25 longest documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ordering.limit_by(rows, 25, F.desc("n_chars"), "doc_id")


@check("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 500")
def manifest_page(spark, sf_dir):
    """The second page of 500 rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return ordering.page(rows, 500, 1, order="o_orderkey")


# Unions


@check(
    """
SELECT source, id, row_number() OVER (ORDER BY side, id) - 1 AS ordinal FROM (
  SELECT 0 AS side, 'page' AS source, page_id AS id FROM pages
  UNION ALL SELECT 1, 'document', doc_id FROM documents)"""
)
def union_of_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"))
    documents = table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"))
    return sets.union_sources(
        pages.withColumn("rank", F.col("id")), documents.withColumn("rank", F.col("id"))
    ).select("source", "id", "ordinal")


@check(
    """
SELECT source, id, CASE source WHEN 'page' THEN id - (SELECT min(page_id) FROM pages)
  ELSE (SELECT max(page_id) - min(page_id) + 1 FROM pages) + id - (SELECT min(doc_id) FROM documents) END AS ordinal
FROM (SELECT 'page' AS source, page_id AS id FROM pages UNION ALL SELECT 'document', doc_id FROM documents)"""
)
def union_of_datasets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"))
    documents = table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"))
    return sets.union_datasets(
        pages.withColumn("ordinal", F.col("id")), documents.withColumn("ordinal", F.col("id"))
    ).select("source", "id", "ordinal")


@check(
    f"""
WITH {RECORDS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY ordinal) AS rn FROM rec
  WHERE source IN ('src0', 'src1', 'src2'))
SELECT id, 'found' AS dataset_name,
  row_number() OVER (ORDER BY query = 'de', query, source, ordinal) - 1 AS ordinal
FROM r WHERE rn <= 3 + CASE WHEN source <> 'src2' THEN 1 ELSE 0 END"""
)
def search_all_sources(spark, sf_dir):
    rows = records(spark, sf_dir).withColumnRenamed("ordinal", "rank")
    hits = {name: rows.where(F.col("source") == name) for name in ("src0", "src1", "src2")}
    found = search_all(hits, 11, "found", queries=["en", "es", "fr"])
    return found.select("id", "dataset_name", "ordinal")


# Near-duplicates


def hashed(spark, sf_dir) -> DataFrame:
    """Hashes of all documents, written once: the removal reads them three times."""
    rows = images(spark, sf_dir).select(
        "ordinal", pixels.phash("height", "width", "nChannels", "data").alias("phash")
    )
    return materialize(rows, "hashed")


FIRSTS = "firsts AS (SELECT min(ordinal) AS ordinal, bits FROM hashes GROUP BY bits)"


@check(
    f"""
WITH {PHASH}, {FIRSTS} SELECT x.ordinal AS a, y.ordinal AS b FROM firsts x JOIN firsts y
ON x.ordinal < y.ordinal AND bit_count(xor(x.bits, y.bits)::HUGEINT) <= 10"""
)
def hash_pairs(spark, sf_dir):
    return near_pairs(hashed(spark, sf_dir))


@check(
    f"""
WITH RECURSIVE {PHASH}, {greedy('hashes')}, kept_hashes AS (
  SELECT ordinal AS first, bits AS kept_bits FROM hashes JOIN kept USING (ordinal))
SELECT ordinal, min(first) AS first FROM hashes JOIN kept_hashes ON bit_count(xor(bits, kept_bits)::HUGEINT) <= 10
WHERE ordinal NOT IN (SELECT ordinal FROM kept) GROUP BY ordinal"""
)
def first_neighbours(spark, sf_dir):
    """The earliest kept record that each dropped one is near to: a row per dropped record, no pairs."""
    return first_near(hashed(spark, sf_dir))


@check(f"WITH RECURSIVE {PHASH}, {greedy('hashes', 28)} SELECT ordinal FROM kept")
def near_duplicates_wide(spark, sf_dir):
    """A threshold at which most hashes are near each other."""
    return near_dedup(hashed(spark, sf_dir), 28).select("ordinal")


@check(f"WITH RECURSIVE {PHASH}, {greedy('hashes')} SELECT ordinal FROM kept")
def near_duplicates_removed(spark, sf_dir):
    return near_dedup(hashed(spark, sf_dir)).select("ordinal")


@check(
    f"""
WITH RECURSIVE {PHASH}, seeds AS (
  SELECT DISTINCT bits FROM hashes JOIN labels ON doc_id = ordinal WHERE toxic = 1),
{greedy('hashes', seeds='seeds')}
SELECT h.ordinal, k.ordinal IS NULL AS is_duplicate FROM hashes h LEFT JOIN kept k ON k.ordinal = h.ordinal"""
)
def near_duplicates_seeded(spark, sf_dir):
    """Hashes of the documents labelled toxic are known beforehand."""
    rows = hashed(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("ordinal"))
    return mark_duplicates(rows, seeds=rows.join(labels, "ordinal", "left_semi")).select("ordinal", "is_duplicate")


@check(f"WITH RECURSIVE {PHASH}, {greedy('hashes', 4)} SELECT ordinal FROM kept")
def near_duplicates_close(spark, sf_dir):
    return near_dedup(hashed(spark, sf_dir), 4).select("ordinal")


# Summaries


@check(
    """
SELECT count(*) FILTER (lang = 'en') AS accepted, count(*) FILTER (lang = 'fr') AS skipped_existing,
  count(*) FILTER (lang = 'de') AS failed_download, count(*) FILTER (lang = 'es' AND source = 'src1') AS failed_quality,
  count(*) FILTER (lang = 'es' AND source <> 'src1') AS failed_dedup,
  count(*) FILTER (lang IN ('en', 'fr', 'de', 'es')) AS total FROM documents"""
)
def outcome_summary(spark, sf_dir):
    return aggregates.outcome_summary(_outcomes(spark, sf_dir))


def _outcomes(spark, sf_dir) -> DataFrame:
    outcome = (
        F.when(F.col("query") == "en", "accepted")
        .when(F.col("query") == "fr", "skipped_existing")
        .when(F.col("query") == "de", "failed_download")
        .when((F.col("query") == "es") & (F.col("source") == "src1"), "failed_quality")
        .when(F.col("query") == "es", "failed_dedup")
    )
    return records(spark, sf_dir).withColumns({"outcome": outcome, "reason": F.col("description")})


@check(
    "SELECT source, doc_id::VARCHAR AS source_id, text AS reason FROM documents"
    " WHERE lang = 'de' OR (lang = 'es' AND source = 'src1')"
)
def failure_log(spark, sf_dir):
    path = scratch_path(spark, "failures.jsonl")
    layouts.write_failures(_outcomes(spark, sf_dir), path)
    return spark.read.schema("source string, source_id string, reason string").json(path)


@check(
    f"""
WITH {RECORDS} SELECT count(*) AS total, round(avg(nullif(width, 0)), 4) AS avg_width,
  round(avg(nullif(height, 0)), 4) AS avg_height, min(nullif(width, 0)) AS min_width,
  min(nullif(height, 0)) AS min_height FROM rec"""
)
def dataset_info(spark, sf_dir):
    return aggregates.dataset_info(records(spark, sf_dir)).withColumns(
        {"avg_width": F.round("avg_width", 4), "avg_height": F.round("avg_height", 4)}
    )


@check(
    f"WITH {RECORDS} SELECT license_type, count(*) AS \"count\", min(ordinal) AS first_seen FROM rec GROUP BY license_type"
)
def counts_by_license(spark, sf_dir):
    return aggregates.counts_by(records(spark, sf_dir), "license_type")


REPORT = f"""
WITH {RECORDS} SELECT id, attribution, license_type, license_url, photographer, photographer_url, url, source,
  query, coalesce(local_path, '') AS local_path FROM rec"""


@check(REPORT)
def attribution_report(spark, sf_dir):
    return aggregates.attribution_report(records(spark, sf_dir))


# Sinks: written, then read back


@check(REPORT)
def report_csv(spark, sf_dir):
    path = scratch_path(spark, "attribution.csv")
    layouts.write_report(records(spark, sf_dir), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


@check(
    f"""
WITH {RECORDS} SELECT id, source, url, width::VARCHAR AS width, '["' || query || '","' || source || '"]' AS tags,
  description, query, 22 AS n_columns FROM rec"""
)
def csv_export(spark, sf_dir):
    out = scratch_path(spark, "csv")
    layouts.write_csv(records(spark, sf_dir), out)
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/dataset.csv")
    return rows.select(
        "id", "source", "url", "width", "tags", "description", "query", F.lit(len(rows.columns)).alias("n_columns")
    )


OWN_PATH = "'/raster/' || ordinal || '.png'"
LISTED = "ordinal IN (SELECT doc_id FROM labels)"


@check(
    f"""
WITH {RECORDS}, {split_sql('rec', 'ordinal', 0.2, 0.1)}
SELECT id, split, 'images/' || split || '/' || ordinal || '.png' AS local_path, description
FROM parted WHERE {LISTED}"""
)
def raw_export(spark, sf_dir):
    out = scratch_path(spark, "raw")
    rows = _with_own_path(records(spark, sf_dir))
    layouts.write_raw(rows, out, _files(spark, sf_dir), 0.2, 0.1, copy=False)
    schema = "id string, split string, local_path string, description string"
    return spark.read.schema(schema).json(f"{out}/metadata.jsonl")


@check(f"WITH {RECORDS} SELECT id, 'images/' || ordinal || '.png' AS local_path FROM rec WHERE {LISTED}")
def raw_export_whole(spark, sf_dir):
    out = scratch_path(spark, "raw")
    rows = _with_own_path(records(spark, sf_dir))
    layouts.write_raw(rows, out, _files(spark, sf_dir), copy=False)
    return spark.read.schema("id string, local_path string").json(f"{out}/metadata.jsonl")


@check(
    f"""
WITH {RECORDS}, {split_sql('rec', 'ordinal', 0.1, 0.1)}
SELECT split, ordinal::VARCHAR AS stem FROM parted WHERE {LISTED}"""
)
def yolo_export(spark, sf_dir):
    """Empty label files, one per image, below their split."""
    out = scratch_path(spark, "yolo")
    rows = _with_own_path(records(spark, sf_dir))
    layouts.write_yolo(rows, out, _files(spark, sf_dir), 0.1, 0.1, ["document"], copy=False)
    folders = F.explode(F.array(*[F.lit(f"{out}/labels/{s}/") for s in ("train", "val", "test")]))
    places = rows.select(folders.alias("folder"), F.col("ordinal").cast("string").alias("stem"))
    found = stat_files(places.select(F.concat("folder", "stem", F.lit(".txt")).alias("path")))
    return found.where("length = 0").select(
        F.regexp_extract("path", r"/labels/(\w+)/", 1).alias("split"),
        F.regexp_extract("path", r"(\d+)\.txt$", 1).alias("stem"),
    )


@check(
    f"""
WITH {RECORDS}, {split_sql('rec', 'ordinal', 0.2, 0.1)}
SELECT split, CASE split WHEN 'train' THEN i WHEN 'val' THEN i - (n - t - v) ELSE i - (n - t) END + 1 AS image_id,
  ordinal || '.png' AS file_name, width, height, license_type AS license, attribution, url, id AS record_id, source
FROM parted WHERE {LISTED}"""
)
def coco_export(spark, sf_dir):
    """Annotation objects; ids count before missing files are left out."""
    out = scratch_path(spark, "coco")
    rows = _with_own_path(records(spark, sf_dir))
    layouts.write_coco(rows, out, _files(spark, sf_dir), 0.2, 0.1, copy=False)
    schema = (
        "images array<struct<id bigint, file_name string, width int, height int, license string,"
        " attribution string, url string, record_id string, source string>>"
    )
    parts = None
    for split in ("train", "val", "test"):
        part = spark.read.schema(schema).option("multiLine", True).json(f"{out}/annotations/{split}.json").select(
            F.lit(split).alias("split"), F.explode("images").alias("image")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("split", "image.*").withColumnRenamed("id", "image_id")


@check(
    f"""
WITH {RECORDS}, {split_sql('rec', 'ordinal', 0.2, 0.1)}
SELECT id, CASE split WHEN 'train' THEN i WHEN 'val' THEN i - (n - t - v) ELSE i - (n - t) END + 1 AS image_id
FROM parted"""
)
def coco_image_ids(spark, sf_dir):
    rows = ordering.assign_split(records(spark, sf_dir), 0.2, 0.1)
    return ordering.coco_image_id(rows).select("id", "image_id")


@check(
    f"""
WITH {RECORDS}, {split_sql('rec', 'ordinal', 0.2, 0.1, ('train', 'validation', 'test'))}
SELECT {OWN_PATH} AS image_path, id, source, license_type, attribution, photographer, url, width, height,
  array_to_string(tags, ',') AS tags, description, query, split
FROM parted WHERE {LISTED}"""
)
def parquet_export(spark, sf_dir):
    out = scratch_path(spark, "parquet")
    rows = _with_own_path(records(spark, sf_dir))
    layouts.write_parquet_dataset(rows, out, _files(spark, sf_dir), 0.2, 0.1)
    return spark.read.parquet(out).withColumn("tags", F.array_join("tags", ","))


# Whole runs


@check(
    f"""
WITH RECURSIVE {SIGNALS}, {RECORDS}, joined AS (
  SELECT r.id, r.ordinal, r.source, {FORMATS.replace('doc_id', 'd.doc_id')} AS format, d.n_chars, r.description, d.lang, h.bits, s.blur_score,
    l.quality, l.toxic, l.doc_id IS NOT NULL AS known
  FROM rec r JOIN documents d ON d.doc_id = r.ordinal JOIN hashes h USING (ordinal) JOIN sharp s USING (ordinal)
  LEFT JOIN labels l ON l.doc_id = r.ordinal),
staged AS (
  SELECT *, CASE
      WHEN known AND n_chars >= 100 THEN 'skipped_existing'
      WHEN n_chars < 100 THEN 'failed_download'
      WHEN n_chars < 1000 THEN 'failed_quality'
      WHEN blur_score < 3000.0 THEN 'failed_quality'
      WHEN lang = 'es' AND ordinal % 3 = 0 THEN 'failed_language' ELSE 'accepted' END AS outcome,
    CASE
      WHEN known AND n_chars >= 100 THEN ''
      WHEN n_chars < 100 THEN 'download error'
      WHEN n_chars < 1000 THEN 'quality: file too small (' || n_chars || ' < 1000)'
      WHEN blur_score < 3000.0 THEN 'quality: too blurry'
      WHEN lang = 'es' AND ordinal % 3 = 0 THEN 'language: third of es' ELSE '' END AS reason
  FROM joined),
seeds AS (SELECT DISTINCT bits FROM joined WHERE known AND n_chars >= 100),
survivors AS (SELECT ordinal, bits FROM staged WHERE outcome = 'accepted'),
{greedy('survivors', seeds='seeds')}
SELECT s.id, CASE WHEN s.outcome = 'accepted' AND k.ordinal IS NULL THEN 'failed_dedup' ELSE s.outcome END AS outcome,
  CASE WHEN s.outcome = 'accepted' AND k.ordinal IS NULL THEN 'near-duplicate' ELSE s.reason END AS reason,
  CASE WHEN s.outcome IN ('skipped_existing', 'failed_download') THEN 'png' ELSE s.format END AS format
FROM staged s LEFT JOIN kept k ON k.ordinal = s.ordinal"""
)
def curation_run(spark, sf_dir):
    """All documents as candidates; labelled ones are in the manifest already. A gate of its own stands before the
    removal of duplicates, and the format is that of the content."""
    everything = records(spark, sf_dir).withColumn(
        "local_path", F.concat(F.lit("raster/"), F.col("source_id"), F.lit(".png"))
    )
    landed = heads(spark, sf_dir).where("length >= 100").drop("ordinal")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"))
    manifest = everything.drop("phash").join(hashed(spark, sf_dir), "ordinal").join(labels, "ordinal", "left_semi")
    manifest = materialize(manifest.select(*everything.columns), "manifest")
    outcomes = curate(
        everything,
        manifest,
        landed,
        sources=["src0"],
        quality={"min_width": 32, "min_height": 32, "min_file_size": 1000, "min_sharpness": 3000.0},
        gates=[
            Gate("language", (("all", F.lit(True), F.lit("replaced by the next of its kind")),)),
            Gate(
                "language",
                (("third", (F.col("query") == "es") & (F.col("ordinal") % 3 == 0), F.lit("third of es")),),
                outcome="failed_language",
            ),
        ],
    )
    text = F.col("reason")
    return outcomes.select(
        "id", "outcome",
        F.when(F.startswith(text, F.lit("download error")), "download error")
        .when(F.startswith(text, F.lit("quality: too blurry")), "quality: too blurry")
        .when(F.startswith(text, F.lit("near-duplicate")), "near-duplicate")
        .otherwise(text)
        .alias("reason"),
        "format",
    )


@check(
    f"""
WITH RECURSIVE {SIGNALS}, {RECORDS}, passed AS (
  SELECT ordinal, bits FROM hashes JOIN sharp USING (ordinal) JOIN labels ON doc_id = ordinal
  JOIN documents USING (doc_id) WHERE n_chars >= 10240 AND blur_score >= 2500.0),
{greedy('passed')}
SELECT id FROM rec JOIN kept USING (ordinal)"""
)
def refilter_dataset(spark, sf_dir):
    """Quality and duplicates over an existing dataset; files are those of labelled documents."""
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.write(
        records(spark, sf_dir).withColumn("local_path", F.concat(F.lit("raster/"), "source_id", F.lit(".png")))
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"))
    decoded = [F.col(c) for c in ("height", "width", "nChannels", "data")]
    listing = (
        images(spark, sf_dir)
        .join(labels, "ordinal", "left_semi")
        .select(
            "path", "length", "width", "height",
            pixels.blur_score(*decoded).alias("blur_score"), pixels.phash(*decoded).alias("phash"),
        )
    )
    refilter(manifest, listing, min_width=32, min_height=32, min_sharpness=2500.0, dedup_threshold=10)
    return manifest.read().select("id")


@check(
    f"""
WITH RECURSIVE {SIGNALS}, {RECORDS}, passed AS (
  SELECT ordinal, bits FROM hashes JOIN sharp USING (ordinal) JOIN documents ON doc_id = ordinal
  WHERE lang <> 'de' AND n_chars * 40 >= 10240 AND blur_score >= 1000.0),
{greedy('passed')}
SELECT id FROM rec JOIN kept USING (ordinal)"""
)
def refilter_many(spark, sf_dir):
    """The same with limits that many records pass; German records have no file."""
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    manifest.write(
        records(spark, sf_dir).withColumn("local_path", F.concat(F.lit("raster/"), "source_id", F.lit(".png")))
    )
    landed = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("ordinal"))
    decoded = [F.col(c) for c in ("height", "width", "nChannels", "data")]
    listing = (
        images(spark, sf_dir)
        .join(landed, "ordinal", "left_semi")
        .select(
            "path", (F.col("length") * 40).alias("length"), "width", "height",
            pixels.blur_score(*decoded).alias("blur_score"), pixels.phash(*decoded).alias("phash"),
        )
    )
    refilter(
        manifest, listing, min_width=32, min_height=32, min_sharpness=1000.0, dedup_threshold=10
    )
    return manifest.read().select("id")


@check(
    f"""
WITH RECURSIVE {PHASH}, {RECORDS}, both_sets AS (
  SELECT 0 AS side, 'a-' || ordinal AS id, ordinal AS doc, source FROM rec WHERE ordinal IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 1, 'b-' || ordinal, ordinal, source FROM rec),
numbered AS (
  SELECT b.*, row_number() OVER (ORDER BY side, doc) AS ordinal, h.bits,
    source || '.png' AS file_name
  FROM both_sets b JOIN hashes h ON h.ordinal = b.doc WHERE source <> 'src3'),
{greedy('(SELECT ordinal, bits FROM numbered)')}
SELECT id, 'images/' || CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY ordinal) = 1 THEN file_name
  ELSE source || '_' || doc || '.png' END AS local_path
FROM numbered JOIN kept USING (ordinal)"""
)
def merged_datasets(spark, sf_dir):
    """Labelled documents as A, all as B; records of src3 have no file."""
    everything = records(spark, sf_dir).drop("phash").join(hashed(spark, sf_dir), "ordinal")
    everything = materialize(everything, "hashed")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"))
    key = F.col("ordinal").cast("string")
    a = everything.join(labels, "ordinal", "left_semi").withColumn("id", F.concat(F.lit("a-"), key))
    b = everything.withColumn("id", F.concat(F.lit("b-"), key))
    listing = everything.where("local_path is not null").select(
        F.col("local_path").alias("path"), F.lit(1).alias("length")
    ).distinct()
    return merge_records(a, b, listing).select("id", "local_path")


@check(
    f"WITH {RECORDS} SELECT id, query, row_number() OVER (ORDER BY query, ordinal) - 1 AS place FROM rec"
)
def accumulated_queries(spark, sf_dir):
    """One search after another into one manifest: each appends to the order."""
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    rows = records(spark, sf_dir)
    for query in ("de", "en", "es", "fr"):
        manifest.upsert(rows.where(F.col("query") == query))
    placed = ordering.with_ordinal(manifest.read().withColumnRenamed("ordinal", "order"), "order", name="place")
    return placed.select("id", "query", "place")


@check("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def deleted_files(spark, sf_dir):
    """Files of labelled documents are deleted; the others stay."""
    from checks.sources_checks import png_files
    from framewright.sinks.files import delete_files
    from framewright.sources.images import list_files

    folder = scratch_path(spark, "png")
    paths = png_files(spark, sf_dir, folder).withColumn(
        "doc_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")
    )
    delete_files(paths.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"))
    return list_files(spark, folder, "*.png").select(
        F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("doc_id")
    )


@check(
    f"""
WITH {RECORDS}, {split_sql('rec', 'ordinal', 0.1, 0.0, ('train', 'validation', 'test'))}
SELECT id, split FROM parted WHERE {LISTED}"""
)
def export_by_name(spark, sf_dir):
    from framewright.plans.maintain import export

    out = scratch_path(spark, "export")
    export(_with_own_path(records(spark, sf_dir)), "parquet", out, _files(spark, sf_dir))
    return spark.read.parquet(out).select("id", "split")


@check(
    f"""
WITH {RECORDS} SELECT
  count(*) FILTER (WHERE width >= 300 AND height >= 200 AND greatest(width, height)::DOUBLE / least(width, height) <= 4) AS kept,
  count(*) FILTER (WHERE NOT (width >= 300 AND height >= 200 AND greatest(width, height)::DOUBLE / least(width, height) <= 4))
    AS removed, (SELECT count(*) FROM rec) AS rows_after FROM rec"""
)
def refilter_preview(spark, sf_dir):
    """A dry run counts and changes nothing."""
    manifest = Manifest(spark, scratch_path(spark, "manifest"))
    rows = _with_own_path(records(spark, sf_dir))
    manifest.write(rows)
    listing = rows.select(F.col("local_path").alias("path"), F.lit(20000).alias("length"), "width", "height")
    counts = refilter(manifest, listing, dry_run=True, min_width=300, min_height=200)
    return manifest.read().agg(
        F.lit(counts["kept"]).cast("bigint").alias("kept"),
        F.lit(counts["removed"]).cast("bigint").alias("removed"),
        F.count("*").alias("rows_after"),
    )


@check("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def distinct_by_semi_join(spark, sf_dir):
    """Each image once, whatever the number of its labels, without a DISTINCT."""
    labels = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("label_name")
    )
    images = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit("u").alias("original_url")
    )
    classes = spark.createDataFrame([("R", "Returned"), ("N", "New")], "label_name string, display_name string")
    return search_index(classes, images, labels, "return").select(F.col("image_id").alias("o_orderkey"))
