"""URL filter by the ratio of two character language models, in DataFrame operations.

Rules on host and path accept or reject some URLs outright. The URLs that they decide
teach two smoothed Markov models of variable order, one of accepted and one of rejected
URLs; every other URL is judged by the difference of its log-likelihoods under the two,
divided by its length, against a threshold calibrated on the decided URLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.session import materialize

#: Longest gram: a character and the characters before it that may predict it.
ORDER = 4
#: Stands before a URL's first character.
PAD = "\u0002"
#: Weight of the shorter context's guess, in counts.
PRIOR = 2.0
#: Characters that a first guess takes to be possible.
ALPHABET = 96
#: Bins of the calibration, and the greatest difference that they tell apart.
BINS, WIDEST = 1600, 8.0
#: A gram table of at most this many rows (some 20 MB) is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """``name`` is host and path in one, as ``example.org/en/``; ``allow`` is the verdict."""

    name: str
    allow: bool

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of ``address``: the gram of ORDER characters that ends there."""
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col("address"))
    places = F.sequence(F.lit(1), F.char_length("address"))
    rows = urls.where(F.char_length("address") > 0).withColumn("_at", F.explode(places))
    return rows.withColumn("gram", F.substring(padded, F.col("_at"), F.lit(ORDER)))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """``gram`` and ``ratio``: log of its last character's chance if accepted over if rejected.

    ``grams`` has one row per gram with the times it was seen in ``accepted`` and
    ``rejected`` URLs, which may be none. A context's own counts are mixed with the guess of the next
    shorter context, so that long contexts speak only as far as they were seen.
    """
    kinds = ("accepted", "rejected")
    guess = None
    for order in range(1, ORDER + 1):
        seen = grams.groupBy(F.substring("gram", ORDER - order + 1, order).alias("g")).agg(
            *[F.sum(k).alias(k) for k in kinds]
        )
        seen = seen.withColumn("c", F.substring("g", 1, order - 1))
        context = seen.groupBy("c").agg(*[F.sum(k).alias(f"all_{k}") for k in kinds])
        both = seen.join(context, "c")
        if guess is None:
            both = both.withColumns({f"p_{k}": F.lit(1.0 / ALPHABET) for k in kinds})
        else:
            shorter = guess.withColumnRenamed("g", "s")
            both = both.withColumn("s", F.substring("g", 2, order - 1)).join(shorter, "s")
        chance = [
            ((F.col(k) + PRIOR * F.col(f"p_{k}")) / (F.col(f"all_{k}") + PRIOR)).alias(f"p_{k}") for k in kinds
        ]
        guess = materialize(both.select("g", *chance), "chances")
    return guess.select(F.col("g").alias("gram"), (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Least difference to allow, by the best balanced accuracy on decided URLs.

    One row per bin is compared; ties go to the bin nearest to 0.
    """
    place = F.floor((F.least(F.greatest("score", F.lit(-WIDEST)), F.lit(WIDEST)) + WIDEST) / (2 * WIDEST) * BINS)
    bins = scored.groupBy(place.alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    told = bins.select(
        "bin",
        (1 - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)).alias("kept"),
        (F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)).alias("gone"),
    )
    best = told.orderBy(F.desc_nulls_last(F.col("kept") + F.col("gone")), F.abs(F.col("bin") - BINS / 2), "bin").first()
    if best is None or best["kept"] is None or best["gone"] is None:
        return 0.0
    return best["bin"] / BINS * 2 * WIDEST - WIDEST


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """page id, host, path, rule, verdict and score (null where a rule decides) of every row.

    Rules decide first, the longest that fits. The models learn from every decided URL's host and path, equal
    URLs counted as often as they occur, and judge the host and path of the others. Null URLs and such without ``://`` have an
    empty host and path; nothing speaks against them, and they are allowed, as all are if the
    rules do not yield both kinds of URLs. Repeated rows each give a row; null ids stay; other columns play no part; an
    empty table gives no rows. Long URLs are read whole.
    """
    host, path = url_host(F.col(url_column)), url_path(F.col(url_column))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    allowed = [r.name for r in rules if r.allow]
    address = F.concat("host", "path")
    urls = materialize(
        rows.groupBy(address.alias("address"), "rule")
        .agg(F.count("*").alias("n"))
        .select(
            "address",
            F.when(F.col("rule").isin(allowed), F.col("n")).otherwise(0).alias("accepted"),
            F.when(F.col("rule").isNotNull() & ~F.col("rule").isin(allowed), F.col("n")).otherwise(0).alias("rejected"),
        ),
        "addresses",
    )
    grams = materialize(
        _grams(urls).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams"
    )
    ratios = materialize(gram_ratios(grams), "ratios")
    table = F.broadcast(ratios) if ratios.count() <= BROADCAST_ROWS else ratios
    scores = materialize(
        _grams(urls)
        .join(table, "gram")
        .groupBy("address", "accepted", "rejected")
        .agg(F.avg("ratio").alias("score")),
        "scores",
    )
    least = _threshold(scores.where((F.col("accepted") > 0) | (F.col("rejected") > 0)))
    by_address = scores.where((F.col("accepted") == 0) & (F.col("rejected") == 0)).select(
        F.col("address").alias("_address"), "score"
    )
    verdict = (
        F.when(F.col("rule").isin(allowed), "allow")
        .when(F.col("rule").isNotNull(), "block")
        .when(F.coalesce(F.col("score"), F.lit(least)) >= least, "allow")
        .otherwise("block")
    )
    open_address = F.when(F.col("rule").isNull(), address)
    return rows.join(by_address, open_address == F.col("_address"), "left").select(
        id_column, "host", "path", "rule", verdict.alias("verdict"), "score"
    )
