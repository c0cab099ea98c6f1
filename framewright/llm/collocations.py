"""Phrase collocations by set-oriented mining: sorted occurrence relations and merge joins.

An occurrence relation has one row per occurrence: document, piece, position and the words'
numbers. It is stored in buckets by document, sorted by (document, piece, position). The
relation of phrases of one word more is its merge join with itself at adjacent positions,
which needs no shuffle or sort as both sides lie in the same buckets, sorted. Group counts of the joined
rows give the frequent phrases, and only occurrences of those, by semi-join, are stored for
the next length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from framewright.session import materialize, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that end pieces, of which one stands for all in a body, and such that end words.
PIECE_ENDS, PIECE_END = ".,;:!?\x0a\x0b\x0c\x0d", "\n"
WORD_ENDS, WORD_END = "\x20\x09", " "

#: Occurrences of one bucket, and the most buckets Spark takes by default.
BUCKET_WORDS, MOST_BUCKETS = 4_000_000, 100_000

#: Frequent words or phrases are broadcast up to this size, beyond it joined by shuffling.
BROADCAST_BYTES = 64 << 20

#: Buckets by document serve joins on more columns than that, and a bucket that is one file is read as it was sorted.
CO_LOCATED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}

@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs inside, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def word_columns(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


class Relation:
    """A stored occurrence relation, bucketed by document and sorted in text order: by ``pos`` and so by ``next`` as well.

    The files have two names in the catalog, one for each of these orders, so that neither side of a join of
    neighbours is sorted again.
    """

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, self.name = rows.sparkSession, f"occurrences_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, self.name)
        rows = rows.withColumn("next", F.col("pos") + 1)
        writer = rows.write.format("parquet").bucketBy(buckets, "doc").sortBy("doc", "piece", "pos")
        writer.option("path", path).saveAsTable(self.name)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        self.spark.sql(
            f"CREATE TABLE {self.name}_next ({fields}) USING parquet"
            f" CLUSTERED BY (doc) SORTED BY (doc, piece, next) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def read_by_next(self) -> DataFrame:
        return self.spark.table(f"{self.name}_next")

    def forget(self) -> None:
        """Take the names out of the catalog; the files go with the scratch folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_next")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def folded(text: Column) -> Column:
    """A text in lower case with one sign for each end of a piece or a word, at which Java splits without a pattern."""
    ends = PIECE_END * len(PIECE_ENDS) + WORD_END * len(WORD_ENDS)
    return F.translate(text, UPPER + PIECE_ENDS + WORD_ENDS, LOWER + ends)


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, doc, piece, pos, word of every word of (lang, doc, body) rows."""
    body = F.split(folded(F.col("body")), PIECE_END)
    pieces = docs.select("lang", "doc", F.posexplode(body).alias("piece", "words"))
    words = F.array_remove(F.split("words", WORD_END), "")
    return pieces.select("lang", "doc", "piece", F.posexplode(words).alias("pos", "word"))


def adjoining(relation: DataFrame, length: int, by_next: DataFrame | None = None) -> DataFrame:
    """Occurrences of ``length`` + 1 words: the relation joined with itself one position on.

    ``by_next`` is the relation as it is sorted by ``next``.
    """
    left = (by_next or relation.withColumn("next", F.col("pos") + 1)).select(
        "doc", "piece", "next", "pos", *word_columns(length)
    )
    right = relation.select("doc", "piece", F.col("pos").alias("next"), F.col(f"w{length}").alias(f"w{length + 1}"))
    return left.hint("merge").join(right, ["doc", "piece", "next"]).select("doc", "piece", "pos", *word_columns(length + 1))


def within(rows: DataFrame, frequent: DataFrame, keys: Sequence[str], buckets: int, size: int) -> DataFrame:
    """Rows whose key is frequent: in place if the frequent ones are few, else shuffled there and back."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(frequent), list(keys))
    return rows.join(frequent.hint("merge"), list(keys)).repartition(buckets, "doc")


def count_phrases(docs: DataFrame, max_words: int, least: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words per lang, frequent words (lang, word, w1, f) and per length the frequent phrases (w1.., f).

    ``docs`` has lang and body. A row's number is given in the scan, so ``docs`` should be a
    stored table, whose lost tasks are repeated with the same numbers.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc", F.monotonically_increasing_id())
    counted = materialize(occurrences(docs).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")), "word_counts")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(counted.where(F.col("f") >= least).withColumn("w1", F.monotonically_increasing_id()), "words")
    total = counted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + 64), F.lit(0))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    buckets = min(max(2 * cores, -(-total // BUCKET_WORDS)), MOST_BUCKETS)
    dealt = docs.repartition(buckets, "doc") if size <= BROADCAST_BYTES else docs
    known = within(occurrences(dealt), words.select("lang", "word", "w1"), ["lang", "word"], buckets, size)
    counts: list[DataFrame] = [words.select("w1", "f")]
    with settings(spark, CO_LOCATED):
        relation = Relation(known.select("doc", "piece", "pos", "w1"), buckets)
        for length in range(2, max_words + 1):
            keys = word_columns(length)
            joined = adjoining(relation.read(), length - 1, relation.read_by_next())
            frequent = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)
            counts.append(materialize(frequent, f"phrases_{length}"))
            if length < max_words:
                size = counts[-1].count() * (32 + 16 * length)
                kept = within(joined, counts[-1].select(*keys), keys, buckets, size)
                longer = Relation(kept.select("doc", "piece", "pos", *keys), buckets)
                relation.forget()
                relation = longer
        relation.forget()
    return sizes, words, counts


def scored(phrases: DataFrame, length: int, counts: Sequence[DataFrame]) -> DataFrame:
    """Phrases with a, l, r and score of their lowest cut.

    The products are decimals of 38 digits: exact for up to 10^15 occurrences.
    """
    keys = word_columns(length)
    rows = phrases.withColumnRenamed("f", "a")
    exact = lambda column: F.col(column).cast("decimal(15,0)")
    rows = rows.withColumn("square", (exact("a") * exact("a") * F.lit(1_000_000)).cast("decimal(38,0)"))
    cuts = []
    for k in range(1, length):
        first = counts[k - 1].withColumnRenamed("f", f"l{k}")
        rest = counts[length - k - 1].toDF(*keys[k:], f"r{k}")
        rows = rows.join(first, keys[:k]).join(rest, keys[k:])
        rows = rows.withColumn(f"both{k}", (exact(f"l{k}") * exact(f"r{k}")).cast("decimal(38,0)"))
        cuts.append(
            F.struct(
                F.expr(f"square div both{k}").alias("score"),
                F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            )
        )
    best = F.array_min(F.array(*cuts))
    return rows.withColumn("best", best).select(*keys, "a", "best.l", "best.r", "best.score")


def outside_longer(phrases: DataFrame, length: int, counts: Sequence[DataFrame], share: int) -> DataFrame:
    """Phrases without those that a longer frequent phrase holds in ``share`` percent of their occurrences."""
    keys, holders = word_columns(length), None
    for longer in range(length + 1, len(counts) + 1):
        for start in range(longer - length + 1):
            part = [F.col(f"w{start + i + 1}").alias(key) for i, key in enumerate(keys)]
            inside = counts[longer - 1].select(*part, F.col("f").alias("held"))
            holders = inside if holders is None else holders.unionByName(inside)
    if holders is None:
        return phrases
    holders = holders.groupBy(*keys).agg(F.max("held").alias("held"))
    held = F.coalesce(F.col("held"), F.lit(0)) * 100 >= F.col("a") * share
    return phrases.join(holders, keys, "left").where(~held).drop("held")


def mine_collocations(
    docs: DataFrame,
    max_words: int = 3,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``max_words`` words.

    A-Z are lower-cased, pieces end at punctuation and line ends, words at blanks and tabs. ``a`` counts the
    phrase, ``l`` and ``r`` the two parts of the cut with the lowest floor(10^6 a a / (l r)), the smallest such cut
    of equal ones; ``n`` counts the language's words. Phrases seen fewer than ``least`` times are no candidates; a
    candidate held by a longer one in ``share`` percent of its occurrences or more is dropped. Ranks go by score,
    ``a`` (both falling) and the phrase's bytes, so that ties are decided.

    A null text is empty, a null lang is `und` and counts with it. Rows that repeat are separate documents. A
    document of any length is one sorted run of its bucket, not a group in memory. Empty tables, and such whose
    phrases are all rare, give no rows. Other columns play no part.
    """
    body = F.coalesce(F.col(text_column), F.lit(""))
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    sizes, words, counts = count_phrases(docs.select(lang.alias("lang"), body.alias("body")), max_words, least)
    found = None
    for length in range(2, max_words + 1):
        keys = word_columns(length)
        rows = outside_longer(scored(counts[length - 1], length, counts), length, counts, share)
        for key in keys:
            spelt = [F.col("w1").alias(key), F.col("word").alias(f"word_{key}")]
            rows = rows.join(words.select(*spelt, *(["lang"] if key == "w1" else [])), key)
        phrase = F.concat_ws(" ", *[f"word_{key}" for key in keys])
        rows = rows.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
        found = rows if found is None else found.unionByName(rows)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
