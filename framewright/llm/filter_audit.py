"""Interaction of filters: who removes what in every order, by paths through the subset lattice.

A state is the set of filters already applied. An edge applies one filter more and removes
the documents that pass all filters of the state and fail the new one. Counting the orders
that reach a state (forward) and that leave the next one (backward) says in how many orders
an edge lies: this weighs its removals for the Shapley sum. A step of an order is one edge,
so that all orders together read the same few edges and no order is run on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD_BREAKS = "[\\x20\\x09-\\x0D]+"


def text_checks(text: str = "text", least_words: int = 200) -> dict[str, Column]:
    """The failure conditions A to D of a text column without nulls, JVM-side."""
    words = F.array_remove(F.split(F.col(text), WORD_BREAKS), "")
    capitals = F.length(F.regexp_replace(F.col(text), "[^A-Z]+", ""))
    return {
        "A": F.size(words) < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders that lead on to the full one."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def lattice(spark: SparkSession, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The edges (state, letter, orders through it) and the steps of every order."""
    n = len(names)
    forward, backward = path_counts(n)
    edges = [
        (state, f, forward[state] * backward[state | 1 << f])
        for state in range(1 << n)
        for f in range(n)
        if not state >> f & 1
    ]
    steps = []
    for order in permutations(range(n)):
        label, state = "".join(names[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((label, step, state, f))
            state |= 1 << f
    return (
        spark.createDataFrame(edges, "state int, letter int, paths long"),
        spark.createDataFrame(steps, "filter_order string, step int, state int, letter int"),
    )


def failure_counts(
    docs: DataFrame,
    labels: DataFrame | None,
    checks: Mapping[str, Column],
    text_column: str = "text",
    id_column: str = "doc_id",
    part_column: str = "source",
    flags: Mapping[str, str] | None = None,
) -> DataFrame:
    """part, mask, n and one count per flag: the documents by the set of filters that they fail.

    Bit i of ``mask`` stands for the i-th of ``checks``; the bit after them for a text that
    is identical to a smaller id's, wherever in the table. Texts are compared by their
    SHA-256, so that only digests are shuffled, and copies are counted before they meet: a
    text that a third of all rows share becomes a few rows per part.
    """
    flags = flags or {"good": "quality", "toxic": "toxic"}
    mask = F.lit(0)
    for i, failed in enumerate(checks.values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    rows = (
        docs.select(
            F.col(id_column).cast("long").alias("id"),
            F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
            F.coalesce(F.col(text_column), F.lit("")).alias(text_column),
        )
        .select("id", "part", F.unhex(F.sha2(text_column, 256)).alias("digest"), mask.alias("mask"))
    )
    if labels is None:
        rows = rows.select("*", *[F.lit(0).alias(name) for name in flags])
    else:
        marked = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg(
            *[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(name) for name, c in flags.items()]
        )
        rows = rows.join(marked, "id", "left").fillna(0, list(flags))
    same = ["digest", "part", "mask", *flags]
    # Repeated rows of one id are told apart from copies under other ids: the least id counts how often it occurs.
    by_id = rows.groupBy(*same, "id").agg(F.count(F.lit(1)).alias("n"))
    copies = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(W.partitionBy("digest"))
    kept = F.col("without_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = copies.withColumn("first", first).withColumn("firsts", kept)
    repeat = 1 << len(checks)
    sides = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
            F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
        )
    )
    return (
        copies.select("part", *flags, sides.alias("side"))
        .groupBy("part", F.col("side.mask").alias("mask"))
        .agg(F.sum("side.n").alias("n"), *[F.sum(F.col("side.n") * F.col(name)).alias(name) for name in flags])
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame | None = None,
    checks: Mapping[str, Column] | None = None,
    repeat_name: str = "E",
    text_column: str = "text",
    id_column: str = "doc_id",
    part_column: str = "source",
    flags: Mapping[str, str] | None = None,
) -> DataFrame:
    """part, filter_order, step and what the step's filter does there, for every order of the filters.

    ``kept``: documents of the part after the step; ``removed``: by it; ``redundant``: fail its
    filter but went before; ``unique_fails``: fail this filter alone; ``<flag>_lost``: removed
    and marked 1 in ``labels``; ``shapley``: removed by this filter, summed over all orders.

    ``checks`` name failure conditions over the text column (null texts count as empty); the
    last filter, ``repeat_name``, fails a text that a smaller id has as well. Empty texts are
    identical to each other. Rows that repeat an id with its text are all firsts or all
    repeats; a null id is neither smaller nor greater, so it never fails the last filter. A
    null part is the empty string, and counts with it. Of several labels of an id the larger
    holds; documents without one are unmarked. Empty tables give no rows. Other columns play
    no part. The number of orders is the factorial of the number of filters: five give 120.
    """
    flags = flags or {"good": "quality", "toxic": "toxic"}
    checks = checks or text_checks(text_column)
    names = [*checks, repeat_name]
    counts = failure_counts(docs, labels, checks, text_column, id_column, part_column, flags)
    edges, steps = lattice(docs.sparkSession, names)
    # Every part has every edge, removals of zero included: 2^n masks meet n * 2^(n-1) edges at most.
    pairs = F.explode(F.array(*[
        F.struct(F.lit(state).alias("state"), F.lit(f).alias("letter"))
        for state in range(1 << len(names)) for f in range(len(names)) if not state >> f & 1
    ]))
    met = counts.select("*", pairs.alias("edge")).select("*", "edge.state", "edge.letter")
    fails = F.expr("(mask & shiftleft(1, letter)) != 0")
    reaches = F.expr("(mask & state) = 0")
    of = lambda condition, value="n": F.sum(F.when(condition, F.col(value)).otherwise(0))
    removals = met.groupBy("part", "state", "letter").agg(
        of(reaches & ~fails).alias("kept"),
        of(reaches & fails).alias("removed"),
        of(~reaches & fails).alias("redundant"),
        of(F.expr("mask = shiftleft(1, letter)")).alias("unique_fails"),
        *[of(reaches & fails, name).alias(f"{name}_lost") for name in flags],
    )
    shapley = (
        removals.join(F.broadcast(edges), ["state", "letter"])
        .groupBy("part", "letter")
        .agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    )
    lost = [f"{name}_lost" for name in flags]
    return (
        removals.join(shapley, ["part", "letter"])
        .join(F.broadcast(steps), ["state", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")
    )
