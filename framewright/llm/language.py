"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes a unit vector of hashed letter n-grams weighted by TF-IDF; each
language has several centroids, from spherical k-means, and the nearest one
by cosine names the language. A text that is farther from it than the
language's own texts of its length are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import prepare, text_slices, unit_hash, unused

BUCKETS = 4096
#: Characters of texts turned into vectors at a time.
SLICE_CHARS = 400_000
#: Shortest texts, in n-grams, of the bands of length that have limits of their own.
BANDS = np.array([0, 64, 128, 256, 512, 1024, 2048, 4096])
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a blank; upper case is folded before.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte n-grams (one to three bytes) as rows of ``BUCKETS`` columns."""
    raw = [b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" " for text in texts]
    counts = np.empty((len(raw), BUCKETS), np.float32)
    for i, line in enumerate(raw):
        x = np.frombuffer(line, np.uint8).astype(np.uint32)
        pairs = x[:-1] << np.uint32(8) | x[1:]
        triples = pairs[:-1] << np.uint32(8) | x[2:]
        both = np.concatenate([pairs + np.uint32(1 << 24), triples])
        keys = (both * np.uint32(2654435761)) >> np.uint32(20)
        counts[i] = np.bincount(keys, minlength=BUCKETS)
    return counts


def packed(row: np.ndarray) -> bytes:
    """A row of counts without its zeros: the numbers of the terms (16 bits), then their counts."""
    terms = np.flatnonzero(row)
    return terms.astype("<u2").tobytes() + row[terms].astype("<f4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The row of counts that ``packed`` was given."""
    n = len(raw) // 6
    row = np.zeros(BUCKETS, np.float32)
    row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return row


def bands_of(counts: np.ndarray) -> np.ndarray:
    """Place of each row's number of n-grams among ``BANDS``."""
    return np.searchsorted(BANDS, counts.sum(axis=1), "right") - 1


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids with their languages, IDF weights, and the least cosine accepted per centroid and band."""

    languages: tuple[str, ...]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language, cosine with its nearest centroid, whether rejected."""
        counts = term_counts(texts)
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        cosine = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)
        return self.of[best], cosine, cosine < self.least[best, bands_of(counts)]


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started with points far from each other."""
    chosen = [0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centroids = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = unit_rows(sums)
    return centroids


def _limits(own: list[np.ndarray], others: list[np.ndarray], loose: float) -> np.ndarray:
    """Least cosine accepted per band: halfway between a language's own low cosines and the others' high ones.

    Where these cross, the own texts stay. The band of the shortest texts, and bands that none of the
    language's own texts reach, have the limit of the band before, at first the ``loose`` one.
    """
    limits = [loose]
    for mine, theirs in zip(own[1:], others[1:], strict=True):
        if not len(mine):
            limits.append(limits[-1])
            continue
        low = np.quantile(mine, 0.01)
        high = np.quantile(theirs, 0.99) if len(theirs) else 0.5 * low
        limits.append((low + high) / 2 if high < low else 0.95 * low)
    return np.array(limits)


def document_frequencies(docs: DataFrame, text_column: str) -> tuple[int, np.ndarray]:
    """Documents, and documents per term, over all rows; summed per task before a shuffle."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for part in text_slices(batches, text_column, SLICE_CHARS):
            seen += (term_counts(part[text_column].tolist()) > 0).sum(axis=0)
            rows += len(part)
        yield pd.DataFrame({"term": np.arange(-1, BUCKETS), "n": np.concatenate([[rows], seen])})

    totals = (
        docs.select(text_column).mapInPandas(partial, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    )
    found = np.zeros(BUCKETS + 1, np.int64)
    for row in totals.collect():  # BUCKETS + 1 rows at most
        found[row["term"] + 1] = row["n"]
    return int(found[0]), found[1:]


def train_languages(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    id_column: str = "doc_id",
    per_language: int = 300,
    clusters: int = 4,
    slack: float = 0.2,
    seed: int = 5,
) -> LanguageModel:
    """Learn centroids from the labelled rows of ``docs``.

    Document frequencies count every labelled row. The clusters are fitted on a
    seeded sample of about ``per_language`` rows of each language (all of a rare one), the only
    rows that reach the driver, as their counts without zeros (``packed``). Every third row of the sample is left out of
    the clusters; cut to the shortest length of each of ``BANDS``, these rows set the least cosine of a language
    between its own low ones and those of the other languages' rows (``_limits``). The shortest texts, which
    show too little, need ``slack`` times the first percentile of the whole rows.

    Rows with a null language, or no letter in the text, teach nothing. Without
    any labelled row there are no languages, and every text is ``und``.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    rows, frequency = document_frequencies(known, text_column)
    idf = (np.log((1 + rows) / (1 + frequency)) + 1).astype(np.float32)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_column).count().collect()}  # one row a language

    share = F.lit(0.0)
    for language, size in sizes.items():
        share = F.when(F.col(lang_column) == language, F.lit(per_language / size)).otherwise(share)
    sample = known.where(unit_hash(seed, id_column) < share).select(
        F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).alias("text"),
        (unit_hash(seed + 1, id_column) < 1 / 3).alias("held"),
    )

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_slices(batches, "text", SLICE_CHARS):
            whole = term_counts(part["text"].tolist())
            held = part["held"].astype(bool)
            out = [(lang, -2 if h else -1, packed(row)) for lang, h, row in zip(part["lang"], held, whole, strict=True)]
            for lang, text in part.loc[held, ["lang", "text"]].itertuples(index=False):
                raw = text.encode("utf-8", "replace")
                for band in range(1, len(BANDS)):
                    # n bytes, with a blank at each end, make 2 n + 1 n-grams
                    piece = raw[: BANDS[band] // 2 + 2].decode("utf-8", "ignore")
                    counts = term_counts([piece])
                    if bands_of(counts)[0] == band:
                        out.append((lang, band, packed(counts[0])))
            yield pd.DataFrame(out, columns=["lang", "band", "v"])

    found = sample.mapInPandas(vectors, "lang string, band int, v binary").collect() if sizes else []
    languages = tuple(sorted({r["lang"] for r in found}))
    rows_of: dict[tuple[str, int], list[bytes]] = {}
    while found:
        r = found.pop()
        rows_of.setdefault((r["lang"], r["band"]), []).append(bytes(r["v"]))

    def vector(language: str, band: int) -> np.ndarray:
        """Unit vectors of one language and band, the only ones that are unpacked at a time."""
        if (language, band) not in rows_of:
            return np.empty((0, BUCKETS), np.float32)
        counts = np.stack([unpacked(v) for v in rows_of[language, band]])
        # rows come in any order: sort, so that the model is the same each time
        order = sorted(range(len(counts)), key=lambda i: counts[i].tobytes())
        return unit_rows(np.log1p(counts[order]) * idf)

    centroids, of, least, few, loose = [], [], [], [], []
    for place, language in enumerate(languages):
        fitted, held = vector(language, -1), vector(language, -2)
        both = np.concatenate([fitted, held])
        few.append(len(fitted) < clusters)
        own = _clusters(both if few[-1] else fitted, clusters)
        loose.append(slack * np.quantile((both @ own.T).max(axis=1), 0.01))
        centroids.append(own)
        of += [place] * len(own)
    # Cosines per centroids' language, band and texts' language.
    near: dict[tuple[int, int, int], np.ndarray] = {}
    for band in range(1, len(BANDS)):
        for other, language in enumerate(languages):
            rows = vector(language, band)
            for place, own in enumerate(centroids):
                x = rows[: 0 if place == other and few[place] else None]
                near[place, band, other] = (x @ own.T).max(axis=1)
    for place, own in enumerate(centroids):
        mine, theirs = [np.empty(0)], [np.empty(0)]
        for band in range(1, len(BANDS)):
            mine.append(near[place, band, place])
            theirs.append(np.concatenate([near[place, band, o] for o in range(len(languages)) if o != place] or [np.empty(0)]))
        least += [_limits(mine, theirs, loose[place])] * len(own)
    stacked = np.concatenate(centroids) if centroids else np.zeros((1, BUCKETS), np.float32)
    return LanguageModel(languages, np.asarray(of or [0]), stacked.astype(np.float32), idf, np.asarray(least or [np.full(len(BANDS), 2.0)]))


def identify_languages(
    docs: DataFrame, model: LanguageModel, text_column: str = "text", prefix: str = ""
) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``, each name after ``prefix``.

    ``score`` is the cosine with the nearest centroid, from 0 to 1. A text that is
    null or has no letter is ``und`` with score 0 and rejected. ``rejected`` also marks
    texts too far from every centroid; ``lang_pred`` still names the nearest one.
    Ties go to the first centroid. Every row gives one row with all its columns; columns
    that already have one of the new names are replaced. Whole texts count.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    kept = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers for each centroid

    @F.pandas_udf(
        T.StructType(
            [
                T.StructField("lang_pred", T.StringType()),
                T.StructField("score", T.DoubleType()),
                T.StructField("rejected", T.BooleanType()),
            ]
        )
    )
    def predict(text: pd.Series) -> pd.DataFrame:
        found = shared.value
        out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "rejected": True}, index=text.index)
        named = text[[has_letter(t) for t in text]] if found.languages else text.iloc[:0]
        for part in text_slices([pd.DataFrame({"text": named})], "text", SLICE_CHARS):
            of, cosine, rejected = found.predict(part["text"].tolist())
            out.loc[part.index, "lang_pred"] = [found.languages[i] for i in of]
            out.loc[part.index, "score"] = cosine.astype(float)
            out.loc[part.index, "rejected"] = rejected
        return out

    result = unused("_told", kept.columns)
    told = kept.withColumn(result, predict(F.col(text_column)))
    return told.select(*kept.columns, *[F.col(result).getField(n[len(prefix) :]).alias(n) for n in names])

