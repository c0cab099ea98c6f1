"""Gates: each adds ``reason_code`` and ``reason`` (empty on a pass).

A gate never drops rows, so that every candidate keeps an outcome; filter on
``passed()`` to continue. The first failing test is the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import normalize_path, spread_missing
from framewright.functions.vectors import cosine_similarity
from framewright.schema import FAILED_QUALITY, ORDINAL

CODE, REASON = "reason_code", "reason"

# The codes, texts and default limits of the rules below are fixed values.
Rule = tuple[str, Column, Column]


def passed() -> Column:
    return F.col(CODE) == ""


def apply_rules(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add the code and text of the first rule (code, failing test, text) that holds."""
    code = reason = None
    for name, fails, text in rules:
        code = F.when(fails, name) if code is None else code.when(fails, name)
        reason = F.when(fails, text) if reason is None else reason.when(fails, text)
    return df.withColumns({CODE: code.otherwise(""), REASON: reason.otherwise("")})


@dataclass(frozen=True)
class Gate:
    """A gate of the user's own for the curation run.

    ``rules`` are (code, failing test, text) as elsewhere; the first that holds is the reason,
    with ``kind`` in front. A test that is null passes. ``prepare`` may add columns that the tests need, by
    expressions or joins, and has to keep every row once. ``outcome`` is what a rejected
    row gets.
    """

    kind: str
    rules: tuple[Rule, ...]
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows
    outcome: str = FAILED_QUALITY

    def coded_rules(self) -> list[Rule]:
        prefix = F.lit(f"{self.kind}: ")
        return [
            (f"{self.kind}:{code}", F.coalesce(fails, F.lit(False)), F.concat(prefix, text))
            for code, fails, text in self.rules
        ]


def gates_by_kind(gates: Iterable[Gate]) -> list[Gate]:
    """One gate per kind, in the order in which the kinds came first; the last of a kind replaces the others."""
    return list({gate.kind: gate for gate in gates}.values())


def file_rules(path: Column, exists: Column) -> list[Rule]:
    missing_path = path.isNull() | (path == "")
    return [
        ("no_local_file", missing_path, F.lit("no local file")),
        ("file_not_found", ~F.coalesce(exists, F.lit(False)), F.lit("file not found")),
    ]


def header_rules(
    size: Column,
    width: Column,
    height: Column,
    min_width: int = 256,
    min_height: int = 256,
    max_aspect_ratio: float = 4.0,
    min_file_size: int = 10 * 1024,
) -> list[Rule]:
    """Tests that need no pixels: file size and decoded dimensions."""
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    undecodable = width.isNull() | height.isNull() | (width < 0) | (height < 0)
    return [
        (
            "file_too_small",
            size < min_file_size,
            F.format_string(f"file too small (%d < {min_file_size})", size),
        ),
        ("invalid_image", undecodable, F.lit("invalid image")),
        ("width", width < min_width, F.format_string(f"width %d < {min_width}", width)),
        ("height", height < min_height, F.format_string(f"height %d < {min_height}", height)),
        (
            "aspect_ratio",
            aspect > max_aspect_ratio,
            F.format_string(f"aspect ratio %.2f > {max_aspect_ratio}", aspect),
        ),
    ]


def sharpness_rule(score: Column, min_sharpness: float | None = 100.0) -> list[Rule]:
    """Reject a known score below the minimum; a null score or minimum passes."""
    if min_sharpness is None:
        return []
    return [
        (
            "too_blurry",
            F.coalesce(score < min_sharpness, F.lit(False)),
            F.format_string(f"too blurry (score=%.1f < threshold={min_sharpness})", score),
        )
    ]


def quality_gate(
    df: DataFrame,
    min_width: int = 256,
    min_height: int = 256,
    max_aspect_ratio: float = 4.0,
    min_file_size: int = 10 * 1024,
    min_sharpness: float | None = 100.0,
    path: str = "local_path",
    exists: str | Column = "file_exists",
    size: str = "file_size_bytes",
    width: str = "width",
    height: str = "height",
    score: str = "blur_score",
) -> DataFrame:
    """All quality tests in order, over signals that are already columns.

    ``width`` and ``height`` are the decoded dimensions; null or negative means
    that the file could not be decoded. Comparisons are strict: a value equal to
    its limit passes.
    """
    exists = F.col(exists) if isinstance(exists, str) else exists
    return apply_rules(
        df,
        file_rules(F.col(path), exists)
        + header_rules(
            F.col(size), F.col(width), F.col(height),
            min_width, min_height, max_aspect_ratio, min_file_size,
        )
        + sharpness_rule(F.col(score), min_sharpness),
    )


def semantic_gate(
    df: DataFrame,
    queries: DataFrame,
    threshold: float = 0.2,
    embedding: str = "embedding",
    query: str = "query",
    query_embedding: str = "query_embedding",
    path: str | None = "local_path",
    exists: str | Column | None = "file_exists",
) -> DataFrame:
    """Reject records whose embedding lies too far from that of their query.

    ``queries`` holds one row per query text: (query, query_embedding). It is
    not hinted: Spark broadcasts it while it is below the session's threshold,
    and splits the hot side of a skewed query otherwise. A record that cannot be
    scored passes; one without a file is rejected.
    """
    rules: list[Rule] = []
    if path is not None:
        exists = F.col(exists) if isinstance(exists, str) else exists
        rules += file_rules(F.col(path), exists)
    lookup = queries.select(
        F.col(query).alias("__query"), F.col(query_embedding).alias("__query_embedding")
    )
    scored = df.join(lookup, F.coalesce(query, F.lit("")) == F.col("__query"), "left").withColumn(
        "similarity", cosine_similarity(F.col(embedding), F.col("__query_embedding"))
    )
    rules.append(
        (
            "semantic",
            F.coalesce(F.col("similarity") < threshold, F.lit(False)),
            F.format_string(f"CLIP similarity %.3f < threshold {threshold}", F.col("similarity")),
        )
    )
    return apply_rules(scored, rules).drop("__query", "__query_embedding")


def has_file(df: DataFrame, files: DataFrame, path: str = "local_path") -> DataFrame:
    """Records whose file is in the listing (a DataFrame with a ``path`` column)."""
    listing = files.select(normalize_path(F.col("path")).alias("__path"))
    return df.join(listing, normalize_path(F.col(path)) == F.col("__path"), "left_semi")


def mark_files(df: DataFrame, files: DataFrame, path: str = "local_path") -> DataFrame:
    """Add ``file_exists`` and, from the listing, ``file_length``."""
    listing = files.select(
        normalize_path(F.col("path")).alias("__path"), F.col("length").alias("file_length")
    )
    identity = [ORDINAL] if ORDINAL in df.columns else df.columns
    key = spread_missing(normalize_path(F.col(path)), *[F.col(c) for c in identity])
    return (
        df.join(listing, key == F.col("__path"), "left")
        .withColumn("file_exists", F.col("__path").isNotNull())
        .drop("__path")
    )
