"""The curation run: one outcome per candidate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import pixels
from framewright.functions.signatures import format_of
from framewright.functions.text import normalize_path, spread_missing, truthy
from framewright.operators.dedup import duplicate_ordinals
from framewright.operators.gates import (
    CODE,
    REASON,
    Gate,
    apply_rules,
    gates_by_kind,
    header_rules,
    passed,
    semantic_gate,
    sharpness_rule,
)
from framewright.operators.joins import resume_join, source_for
from framewright.schema import (
    ACCEPTED,
    FAILED_DEDUP,
    FAILED_DOWNLOAD,
    FAILED_QUALITY,
    MANIFEST,
    ORDINAL,
    SKIPPED,
)
from framewright.session import materialize
from framewright.sinks.files import delete_files

FETCH_CODES = ("no_adapter", "not_landed")


def landed_signals(
    images: DataFrame,
    min_sharpness: float | None = 100.0,
    quality: Mapping | None = None,
    with_hash: bool = True,
) -> DataFrame:
    """Signals of landed files as narrow rows: the pixels stay where they are read.

    Cheap tests come first. A file that fails on its size or dimensions hands no
    pixels to the worker: null goes there, and nothing is decoded or shipped. One
    function measures sharpness and hash, and leaves the hash out where the sharpness
    fails. Signals that are columns already are used as they are. The format is that of
    the first bytes (``head``), else of the column ``format``.
    """
    columns = set(images.columns)
    df = images
    for name, kind in (("blur_score", "double"), ("phash", "string")):
        if name not in columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    good = F.lit(True)
    if quality is not None:
        rules = header_rules(F.col("length"), F.col("width"), F.col("height"), **quality)
        for _, fails, _ in rules:
            good = good & ~F.coalesce(fails, F.lit(False))
    if "data" in columns and (quality is not None or with_hash):
        scored = quality is not None
        open_signals = F.lit(False)
        if scored:
            open_signals = open_signals | F.col("blur_score").isNull()
        if with_hash:
            open_signals = open_signals | F.col("phash").isNull()
        measure = pixels.measure(min_sharpness if scored else None, with_score=scored, with_hash=with_hash)
        data = F.when(good & open_signals, F.col("data"))
        shape = [F.col(c) for c in ("height", "width", "nChannels")]
        df = df.withColumn("__signals", measure(*shape, data, F.col("blur_score"), F.col("phash")))
        df = df.withColumns({name: F.col(f"__signals.{name}") for name in ("blur_score", "phash")})
    if "head" in columns:
        df = df.withColumn("__format", format_of(F.col("head")))
    elif "format" in columns:
        df = df.withColumn("__format", F.col("format"))
    else:
        df = df.withColumn("__format", F.lit(None).cast("string"))
    return df.select(
        normalize_path(F.col("path")).alias("__path"),
        F.col("length").alias("landed_length"),
        F.col("width").alias("img_width"),
        F.col("height").alias("img_height"),
        F.col("blur_score").alias("img_blur_score"),
        F.col("phash").alias("img_phash"),
        F.col("__format").alias("img_format"),
        *[c for c in ("embedding",) if c in columns],
    )


def curate(
    candidates: DataFrame,
    manifest: DataFrame,
    images: DataFrame,
    sources: Sequence[str],
    quality: Mapping | None = None,
    queries: DataFrame | None = None,
    clip_threshold: float = 0.2,
    dedup_threshold: int | None = 10,
    skip_existing: bool = True,
    measured_size: bool = False,
    gates: Sequence[Gate] = (),
) -> DataFrame:
    """Resume, landed bytes, quality, meaning, near-duplicates: records with
    ``outcome`` and ``reason``.

    ``images`` describes the landed files, one row per path: path, length and
    either decoded pixels (height, width, nChannels, data) or signals that are
    known already (width, height, blur_score, phash). ``embedding`` in it is
    needed when ``queries`` is given. Candidates name their file in
    ``local_path``. ``quality=None`` leaves the quality gate out, and
    ``dedup_threshold=None`` the removal of duplicates. A candidate that an earlier one
    of the run, with the same source and source_id, was accepted for is resumed from it. ``measured_size`` stores
    the decoded dimensions in the record, and the format is that of the file's content where it is known.

    ``gates`` are the user's own, in order, after quality and meaning and before the removal of
    duplicates; see ``gates.Gate``. Each sees all columns of the rows, and decides those that have passed so far.
    """
    existing, todo = resume_join(candidates, manifest, images.select("path"), skip_existing)
    columns = list(MANIFEST.names)
    options = dict(quality or {})
    sharp = options.pop("min_sharpness", 100.0)
    landed = landed_signals(
        images, sharp, None if quality is None else options, dedup_threshold is not None
    )
    adapter = source_for(F.col("source"), list(sources))
    path = spread_missing(normalize_path(F.col("local_path")), F.col(ORDINAL))
    joined = todo.join(landed, path == F.col("__path"), "left").withColumns(
        {
            "file_size_bytes": F.coalesce("landed_length", "file_size_bytes"),
            "blur_score": F.coalesce("img_blur_score", "blur_score"),
            "phash": F.coalesce("img_phash", "phash"),
            "format": F.coalesce("img_format", "format"),
        }
    )
    fetch = [
        ("no_adapter", adapter.isNull(), F.lit("no source adapter found")),
        (
            "not_landed",
            F.col("__path").isNull(),
            F.concat(F.lit("download error: no landed file for "),
                     F.coalesce(truthy(F.col("download_url")), F.lit("(no url)"))),
        ),
    ]
    cheap = []
    if quality is not None:
        cheap = header_rules(
            F.col("file_size_bytes"), F.col("img_width"), F.col("img_height"), **options
        )
    staged = apply_rules(joined, fetch + cheap)
    if quality is not None:
        staged = _and_then(staged, sharpness_rule(F.col("blur_score"), sharp))
    staged = staged.withColumn(
        REASON,
        F.when(passed(), "")
        .when(F.col(CODE).isin(*FETCH_CODES), F.col(REASON))
        .otherwise(F.concat(F.lit("quality: "), F.col(REASON))),
    )
    if queries is not None:
        before = staged.select(
            "*", F.col(CODE).alias("__code"), F.col(REASON).alias("__reason")
        ).withColumn("embedding", F.when(passed(), F.col("embedding")))
        gated = semantic_gate(
            before.drop(CODE, REASON), queries, clip_threshold, path=None, exists=None
        )
        staged = gated.withColumns(
            {
                REASON: F.when(F.col("__code") != "", F.col("__reason"))
                .when(passed(), "")
                .otherwise(F.concat(F.lit("clip: "), F.col(REASON))),
                CODE: F.when(F.col("__code") != "", F.col("__code")).otherwise(F.col(CODE)),
            }
        )
    own_gates = gates_by_kind(gates)
    for gate in own_gates:
        staged = _and_then(gate.prepare(staged), gate.coded_rules())
    if measured_size:
        staged = staged.withColumns(
            {"width": F.coalesce("img_width", "width"), "height": F.coalesce("img_height", "height")}
        )
    outcome = F.when(passed(), ACCEPTED).when(F.col(CODE).isin(*FETCH_CODES), FAILED_DOWNLOAD)
    for gate in own_gates:
        outcome = outcome.when(F.startswith(CODE, F.lit(f"{gate.kind}:")), gate.outcome)
    outcome = outcome.otherwise(FAILED_QUALITY)
    staged = staged.select(*columns, outcome.alias("outcome"), REASON)
    # The pixels are read once; all that follows works on what is written here, and asks for whole records last.
    staged = materialize(staged, "signals", "zstd")
    if dedup_threshold is not None:
        survivors = staged.where(F.col("outcome") == ACCEPTED)
        # A row that is fetched again is not a duplicate of itself.
        own = todo.select("source", "source_id")
        seeds = manifest.join(own, ["source", "source_id"], "left_anti")
        dropped = materialize(
            duplicate_ordinals(survivors, dedup_threshold, seeds), "dropped"
        ).withColumn("__dup", F.lit(True))
        staged = staged.join(dropped, ORDINAL, "left").select(
            *columns,
            F.when(F.col("__dup"), FAILED_DEDUP).otherwise(F.col("outcome")).alias("outcome"),
            F.when(
                F.col("__dup"),
                F.concat(F.lit("near-duplicate detected (phash="), F.col("phash"), F.lit(")")),
            ).otherwise(F.col(REASON)).alias(REASON),
        )
    if skip_existing:
        staged = _resumed_in_run(staged)
    resumed = existing.select(*columns, F.lit(SKIPPED).alias("outcome"), F.lit("").alias(REASON))
    return staged.unionByName(resumed)


def remove_rejected_files(outcomes: DataFrame) -> int:
    """Delete the landed files of the candidates that a gate or the removal of duplicates rejected.

    For after a run whose ``outcomes`` are stored. A file that an accepted or resumed record has
    as well stays; so do those of failed downloads, which never landed under their name.
    Returns how many files went.
    """
    named = outcomes.where("local_path is not null and local_path <> ''").withColumn(
        "path", normalize_path(F.col("local_path"))
    )
    used = named.where(F.col("outcome").isin(ACCEPTED, SKIPPED)).select("path")
    rejected = named.where(~F.col("outcome").isin(ACCEPTED, SKIPPED, FAILED_DOWNLOAD)).select("path")
    return delete_files(rejected.distinct().join(used, "path", "left_anti"))


def _resumed_in_run(staged: DataFrame) -> DataFrame:
    """Skip candidates whose (source, source_id) was accepted earlier in the run.

    ``staged`` is read twice, and the first time only its keys are: nothing that it costs may be lazy but joins.
    """
    keys = ["source", "source_id"]
    firsts = (
        staged.where((F.col("outcome") == ACCEPTED) & F.col("source").isNotNull() & F.col("source_id").isNotNull())
        .groupBy(*keys)
        .agg(F.min(ORDINAL).alias("__first"))
    )
    keyed = spread_missing(F.col("source_id"), F.col(ORDINAL))
    firsts = firsts.select(F.col("source").alias("__source"), F.col("source_id").alias("__id"), "__first")
    joined = staged.join(firsts, (F.col("source") == F.col("__source")) & (keyed == F.col("__id")), "left")
    again = F.col(ORDINAL) > F.col("__first")
    return joined.select(
        *MANIFEST.names,
        F.when(again, SKIPPED).otherwise(F.col("outcome")).alias("outcome"),
        F.when(again, "").otherwise(F.col(REASON)).alias(REASON),
    )


def _and_then(df: DataFrame, rules) -> DataFrame:
    """Apply further rules to the rows that have passed so far."""
    code, reason = F.col(CODE), F.col(REASON)
    for name, fails, text in rules:
        still = passed() & fails
        df = df.withColumns(
            {CODE: F.when(still, name).otherwise(code), REASON: F.when(still, text).otherwise(reason)}
        )
    return df


def accepted(outcomes: DataFrame) -> DataFrame:
    """Accepted rows, those resumed from the manifest included."""
    return outcomes.where(F.col("outcome").isin(ACCEPTED, SKIPPED)).select(*MANIFEST.names)


def new_records(outcomes: DataFrame) -> DataFrame:
    """Rows to add to the manifest."""
    return outcomes.where(F.col("outcome") == ACCEPTED).select(*MANIFEST.names)
