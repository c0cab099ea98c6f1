"""The training-data operators over the driver's tables, as queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bit_sliced import top_k_products
from framewright.llm.collocations import mine_collocations
from framewright.llm.common import fold, table
from framewright.llm.cross_polytope import nearest_neighbours
from framewright.llm.filter_audit import audit_filters
from framewright.llm.language import identify_languages, train_languages
from framewright.llm.licence_scan import scan_licences
from framewright.llm.mixing import mix_sources
from framewright.llm.near_dedup import near_duplicate_classes
from framewright.llm.packing import pack_documents
from framewright.llm.quality import score_quality, train_quality
from framewright.llm.site_templates import extract_main_text
from framewright.llm.suffix_dedup import remove_repeats
from framewright.llm.url_model import Rule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL it has to equal."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, each a sequence of a power-of-two length."""
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query(r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (
               ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(weight * (
           SELECT first(level ORDER BY cap / weight, r) FROM f WHERE level * weight <= cap), cap) AS target
  FROM f
), e AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole,
         floor(target)::BIGINT - floor(target / greatest(source_size, 1))::BIGINT * source_size AS extra FROM t
), p AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.k) AS peers
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, source, size, source_size, target,
       (whole * size + CASE WHEN size = 0 THEN 0 WHEN upto <= extra THEN size
          WHEN upto - peers < extra THEN floor((extra - upto + peers) * size / peers) ELSE 0 END)::BIGINT AS taken
FROM p
""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents"))


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = train_languages(docs.where(~F.col("held_out")))
    return identify_languages(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of two of three folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    taught = docs.join(labels.where(fold("doc_id", 3) != 1), "doc_id")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return score_quality(docs, train_quality(taught)).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
)
def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every query vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_products(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query()
def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every query vector, as found."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query()
def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


@query()
def op3_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    rules = [Rule("net/", False), Rule("example.net/en/", True), Rule("example.com/de/", False), Rule("org/fr/", True)]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return scan_licences(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), m AS (
  SELECT part, doc_id, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x)
  JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN translate(fails, before || x, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, x) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN translate(fails, before, '') <> fails AND contains(fails, x) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, x) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, x) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM r
"""
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, per source."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM p
), n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, ws[i:i + m - 1] AS x FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
                                         FROM w, (SELECT unnest([1, 2, 3]) AS m))
), f AS (SELECT lang, x, len(x) AS m, count(*)::BIGINT AS f FROM g GROUP BY lang, x HAVING count(*) >= 10
), c AS (SELECT lang, x, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1
), s AS (
  SELECT c.lang, c.x, c.a, k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.x = c.x[1:k] JOIN f r ON r.lang = c.lang AND r.x = c.x[k + 1:c.m]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1
), h AS (
  SELECT lang, x, max(f) AS held FROM (
    SELECT lang, x[1:2] AS x, f FROM f WHERE m = 3 UNION ALL SELECT lang, x[2:3], f FROM f WHERE m = 3) GROUP BY lang, x
), t AS (
  SELECT b.lang, array_to_string(b.x, ' ') AS phrase, a, l, r, score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.x = b.x WHERE coalesce(100 * held < 50 * a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
       phrase, a, l, r, n, score
FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return mine_collocations(table(spark, sf_dir, "documents"))


@query()
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur elsewhere as well."""
    return remove_repeats(table(spark, sf_dir, "documents"))
