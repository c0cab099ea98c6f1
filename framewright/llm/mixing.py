"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, but no more than its words
times a maximum number of epochs; what is above goes to the others by weight.
Documents are then repeated whole as often as the source's ratio says, and a
seeded share of them once more, so that the words taken meet the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import prepare
from framewright.session import materialize

#: A word, as sizes count them: anything between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in its source's seeded order has this many bits, found
#: that many at a time.
KEY_BITS, LEVEL_BITS = 48, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(column: str, seed: int) -> Column:
    """48 bits of an md5 over the seed and an id, which any SQL engine can repeat."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float, source: str = "source"
) -> DataFrame:
    """Per source: ``source_size`` and ``target``, the words the mix wants of it.

    Sources in order of their code points, null last, take the weights in turn. The
    level of the water is found in one sorted pass: sources whose cap is low for
    their weight are full first. The windows see one row per source.
    """
    totals = sizes.groupBy(source).agg(F.sum("_size").alias("source_size"))
    turns = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    ranked = totals.withColumn("_rank", F.row_number().over(by_name) - 1).select(
        source,
        "source_size",
        "_rank",
        F.element_at(turns, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap"),
    )
    everything = W.partitionBy()
    filling = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    onward = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_weight").over(onward)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    return (
        ranked.withColumn("_level", level)
        .withColumn("_water", F.first(fits, ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select(
            source,
            "source_size",
            F.when(F.col("_water").isNull(), F.col("_cap"))
            .otherwise(F.least(F.col("_water") * F.col("_weight"), F.col("_cap")))
            .alias("target"),
        )
    )


def _boundaries(keyed: DataFrame, needs: DataFrame, source: str) -> DataFrame:
    """Per source: the key up to which documents are taken once more.

    ``_edge`` is the key at which the wanted words are reached, ``_left`` the words
    still wanted there, ``_group`` the words of all documents with that key. Twelve
    bits of the key are fixed by each pass: words are summed per source and bin,
    before any shuffle, and only the bin with the edge is looked into again.
    """
    edge = needs.select(source, F.col("_extra").alias("_left"), F.lit(0).cast("long").alias("_edge"))
    levels = KEY_BITS // LEVEL_BITS
    for level in range(levels):
        shift = KEY_BITS - LEVEL_BITS * (level + 1)
        inside = keyed if level == 0 else (
            keyed.join(edge.select(F.col(source).alias("_of"), "_edge"), F.col(source).eqNullSafe(F.col("_of")))
            .where(F.shiftright("_key", shift + LEVEL_BITS) == F.col("_edge"))
        )
        bins = inside.groupBy(source, F.shiftright("_key", shift).alias("_bin")).agg(F.sum("_size").alias("_words"))
        running = W.partitionBy(source).orderBy("_bin")
        bins = bins.withColumn("_upto", F.sum("_words").over(running))
        known = edge.select(F.col(source).alias("_of"), F.col("_left").alias("_wanted"))
        edge = (
            bins.join(known, F.col(source).eqNullSafe(F.col("_of")))
            .where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_words") < F.col("_wanted")))
            .select(
                source,
                (F.col("_wanted") - F.col("_upto") + F.col("_words")).alias("_left"),
                F.col("_bin").alias("_edge"),
                F.col("_words").alias("_group"),
            )
        )
        if level < levels - 1:
            edge = edge.drop("_group")
    return edge


def _plan(keyed: DataFrame, weights, share: float, max_epochs: float, source: str) -> DataFrame:
    """One row per source: its target, whole repetitions and the edge of the last one."""
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    targets = materialize(
        source_targets(keyed, weights, share, max_epochs, source)
        .withColumn("_whole", whole)
        .withColumn("_extra", F.floor("target") - F.col("_whole") * F.col("source_size")),
        "targets",
    )
    edges = materialize(_boundaries(keyed, targets.where("_extra > 0"), source), "edges")
    return targets.join(
        edges.select(F.col(source).alias("_of"), "_edge", "_left", "_group"),
        F.col(source).eqNullSafe(F.col("_of")),
        "left",
    ).select(F.col(source).alias("_from"), "source_size", "target", "_whole", "_edge", "_left", "_group")


def _taken() -> Column:
    again = (
        F.when(F.col("_key") < F.col("_edge"), F.col("_size"))
        .when(F.col("_key") == F.col("_edge"), F.floor(F.col("_left") * F.col("_size") / F.col("_group")))
        .otherwise(F.lit(0))
    )
    return (F.col("_whole") * F.col("_size") + F.coalesce(again, F.lit(0))).cast("long")


def _keyed(docs: DataFrame, columns: Sequence[str], ids: str, text: str, seed: int) -> DataFrame:
    return docs.select(*columns, word_count(F.col(text)).alias("_size"), seeded_key(ids, seed).alias("_key"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target, taken.

    ``size`` is the document's words and ``taken`` the words that the mix takes of
    it: whole repetitions of the document first, and for the documents that come
    first in a seeded order of their source one more. The document at the edge (with
    documents of the same key, as repeated rows have) is taken in part, so
    each source meets its target to the word, up to one word for each such row.

    Null and blank texts have size 0 and nothing is taken. Null sources are one source,
    the last. Null ids share one place in the seeded order. Repeated rows count each for
    itself. Other columns play no part. An empty table gives no rows. A source whose
    documents are all empty has target 0. Reruns agree whatever the partitions.

    Texts are read once; the rest works on a written table of ids and sizes. The
    windows run over one row per source, or 4096 bins per source.
    """
    prepare(docs.sparkSession)
    columns = [id_column, source_column]
    keyed = materialize(_keyed(docs, columns, id_column, text_column, seed), "sizes")
    plan = _plan(keyed, weights, share, max_epochs, source_column)
    return keyed.join(plan, F.col(source_column).eqNullSafe(F.col("_from"))).select(
        *columns, F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    length_column: str | None = None,
) -> DataFrame:
    """The mix itself: every document as often as ``mix_sources`` takes it, all columns kept.

    A last repetition in part keeps the document's first words, one blank between
    them; ``length_column``, if any, then gets the length of that text. Documents
    of which nothing is taken go. The edge cases are those of ``mix_sources``.
    """
    prepare(docs.sparkSession)
    # The document travels as one struct, so that its columns may have any names.
    size, key = word_count(F.col(text_column)).alias("_size"), seeded_key(id_column, seed).alias("_key")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    narrow = docs.select(F.col(source_column).alias("_source"), size, key)
    plan = _plan(materialize(narrow, "sizes"), weights, share, max_epochs, "_source")
    rows = (
        docs.select(whole, F.col(source_column).alias("_source"), size, key)
        .join(plan, F.col("_source").eqNullSafe(F.col("_from")))
        .withColumn("_taken", _taken())
        .where("_taken > 0")
    )
    full = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = (F.col("_taken") % F.col("_size")).cast("int")
    turns = F.concat(F.array_repeat(F.lit(0), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("_doc", F.explode(turns).alias("_first_words"))
    field = F.col("_doc").getField
    in_part = F.col("_first_words") > 0
    words = F.slice(F.regexp_extract_all(field(text_column), F.lit(WORD), F.lit(0)), 1, F.col("_first_words"))
    text = F.when(in_part, F.array_join(words, " ")).otherwise(field(text_column))
    replaced = {text_column: text}
    if length_column is not None:
        length = F.char_length(text).cast(docs.schema[length_column].dataType)
        replaced[length_column] = F.when(in_part, length).otherwise(field(length_column))
    return rows.select(*[replaced.get(c, field(c)).alias(c) for c in docs.columns])
