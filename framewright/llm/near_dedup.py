"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles. Each of several hash
functions picks the two smallest shingles, equal ones told apart by their occurrence,
and keeps them in text order, so that equal sketch entries speak for equal
order as well as equal content. Entries are banded; documents that share a band
are candidates. A candidate pair is similar if the shingles that an alignment
inside a diagonal band matches, whichever occurrence they are, make up at least 0.8 of
all shingles of both. No alignment matches more than the shingles with their occurrences
that both have, so that counting these rules pairs out without loss.

Similar documents form classes, the connected components. Within a bucket of
candidates no list of pairs is made: one leader is compared with all members,
and members that are in one component already need no further look. Pairs that share a
rare shingle are few and meet directly; members with too few other shingles for
any partner are then left out. Leaders that have met every other component of a bucket
leave it, until one component is left.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import byte_slices, prepare, text_slices
from framewright.session import materialize

SHINGLE = 5
FUNCTIONS, PER_BAND = 32, 2
#: Bits of a shingle's place in the numbers that are compared.
PLACE_BITS = 26
#: A bucket with several components sends out this many times the leaders of the round before.
MORE_LEADERS = 16
#: Shingles of no more nodes than this are rare: the pairs that they make are few, and are listed.
RARE = 8
#: Equal places of two texts that are listed, and columns of the table that is used beyond them.
MOST_PLACES, BLOCK_BITS = 10_000_000, 1 << 14
SLICE_CHARS, SLICE_BYTES = 400_000, 1 << 20
CACHED_WORDS = 100_000
_WORD = re.compile(r"\w+")
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(11).integers(1, 2**63, FUNCTIONS, dtype=np.uint64)
_LAST = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words_of(text: str) -> list[str]:
    """Lower-case words; punctuation and blanks play no part."""
    return _WORD.findall(text.lower())


def shingles(words: np.ndarray) -> np.ndarray:
    """Numbers of the word windows of a flat array of word numbers."""
    x = words.astype(np.uint64)
    out = x[: len(x) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        out = out * _B + x[i : len(x) - SHINGLE + 1 + i]
    return _mix(out)


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key has occurred before, in order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    runs = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    out = np.empty(len(keys), np.uint64)
    out[order] = runs
    return out


def sketch(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bands of each text's Order MinHash, and its number of shingles.

    ``texts`` are arrays of word numbers, none empty. Texts shorter than a shingle
    are filled up and have one.
    """
    filled = [np.pad(w, (0, max(0, SHINGLE - len(w)))) for w in texts]
    lengths = np.array([len(w) for w in filled])
    flat = np.concatenate(filled)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.ones(len(flat) - SHINGLE + 1, bool)
    for back in range(1, SHINGLE):
        across = begins[1:] - back
        inside[across] = False
    counts = lengths - SHINGLE + 1
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    found = shingles(flat)[inside]
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    found = _mix(found + occurrences(_mix(found ^ (text * _B))) * _A)
    place = np.arange(len(found), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    entries = np.empty((len(texts), FUNCTIONS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        values = (_mix(found ^ seed) & ~low) | place
        least = np.minimum.reduceat(values, starts)
        values[starts + (least & low).astype(np.int64)] = _LAST
        second = np.minimum.reduceat(values, starts)
        turned = (second & low) < (least & low)
        a = np.where(turned, second, least) | low
        b = np.where(turned, least, second) | low
        entries[:, i] = _mix(a + _mix(b) * _A)
    bands = np.empty((len(texts), FUNCTIONS // PER_BAND), np.uint64)
    for j in range(bands.shape[1]):
        key = np.full(len(texts), np.uint64(j + 1))
        for i in range(j * PER_BAND, (j + 1) * PER_BAND):
            key = _mix(key * _A + entries[:, i])
        bands[:, j] = key
    return bands.view(np.int64), counts


def labelled(words: np.ndarray) -> np.ndarray:
    """A text's shingles as numbers, equal ones told apart by their occurrence."""
    found = shingles(np.pad(words, (0, max(0, SHINGLE - len(words)))))
    return _mix(found + occurrences(found) * _A)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of shingles that an alignment of equal occurrences matches: matched / (all - matched).

    ``a`` and ``b`` are word numbers. Equal shingles of equal occurrence can be
    matched, in the same order in both. If the share is ``least`` or more, a matched
    shingle's place differs by no more than the unmatched shingles in the texts, so
    that matches outside this band are left out without loss. Where passages recur inside a
    text this is less than ``alignment_share``, and never more.
    """
    x, y = labelled(a), labelled(b)
    total = len(x) + len(y)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    band = int(total * (1 - least) / (1 + least)) + 1
    near = np.abs(at - to) <= band
    order = np.argsort(at[near])
    to = to[near][order]
    if len(to) > 1 and not (np.diff(to) > 0).all():
        tails: list[int] = []  # longest rising subsequence
        for place in to.tolist():
            k = bisect_left(tails, place)
            tails[k : k + 1] = [place]
        matched = len(tails)
    else:
        matched = len(to)
    return matched / max(total - matched, 1)


def _bit_length(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, by the quadratic table in blocks of ``BLOCK_BITS`` columns."""
    keys, carries, missing = y.tolist(), [0] * len(y), 0
    for start in range(0, len(x), BLOCK_BITS):
        block = x[start : start + BLOCK_BITS]
        bits: dict[int, int] = {}
        for key in np.intersect1d(block, y).tolist():
            packed = np.packbits(block == np.uint64(key), bitorder="little")
            bits[key] = int.from_bytes(packed.tobytes(), "little")
        whole = (1 << len(block)) - 1
        row = whole  # a bit is unset where the length rises
        for j, key in enumerate(keys):
            equal = row & bits.get(key, 0)
            if equal or carries[j]:
                added = row + equal + carries[j]
                carries[j] = added >> len(block)
                row = (added & whole) | (row - equal)
        missing += row.bit_count()
    return len(x) - missing


def common_length(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence, among those whose places differ by ``band`` at most.

    The equal places are listed and their longest rising subsequence is taken; where repeats make
    more equal places than rows of bits cost, the quadratic table is worked off as bits, without a band.
    """
    order = np.argsort(y, kind="stable")
    ordered = y[order]
    first, last = np.searchsorted(ordered, x), np.searchsorted(ordered, x, "right")
    if int((last - first).sum()) > min(len(y) * (16 + len(x) // 1000), MOST_PLACES):
        return _bit_length(x, y)
    at = np.repeat(np.arange(len(x)), last - first)
    to = order[np.arange(len(at)) - np.repeat(np.cumsum(last - first) - last, last - first)]
    near = np.abs(at - to) <= band
    at, to = at[near], to[near]
    to = to[np.lexsort((-to, at))]  # the places of one shingle in falling order: only one of them can rise
    if (np.diff(to) > 0).all():
        return len(to)
    tails: list[int] = []  # longest rising subsequence
    for place in to.tolist():
        k = bisect_left(tails, place)
        tails[k : k + 1] = [place]
    return len(tails)


def alignment_share(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of shingles that an alignment matches: matched / (all - matched).

    ``a`` and ``b`` are word numbers. Equal shingles can be matched, whichever occurrence they
    are, in the same order in both. If the share is ``least`` or more, a matched
    shingle's place differs by no more than the unmatched shingles in the texts, so
    that matches outside this band are left out without loss. What both texts begin and end with
    is matched at once, which loses nothing either. A share under ``least`` can be told too low.
    """
    x, y = (shingles(np.pad(w, (0, max(0, SHINGLE - len(w))))) for w in (a, b))
    total = len(x) + len(y)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    keys, times = np.unique(x, return_counts=True)
    others, other_times = np.unique(y, return_counts=True)
    _, at, to = np.intersect1d(keys, others, assume_unique=True, return_indices=True)
    most = int(np.minimum(times[at], other_times[to]).sum())  # no order matches more
    if most < (least - 1e-9) * (total - most):
        return 0.0
    band = int(total * (1 - least) / (1 + least)) + 1
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    begin = int(differ[0]) if len(differ) else short
    x, y = x[begin:], y[begin:]
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - short :][::-1] != y[len(y) - short :][::-1])
    end = int(differ[0]) if len(differ) else short
    matched = begin + end
    if short > end:
        matched += common_length(x[: len(x) - end], y[: len(y) - end], band)
    return matched / max(total - matched, 1)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether ``alignment_share`` reaches ``least``; most pairs that do are told by equal occurrences."""
    return aligned(a, b, least) >= least or alignment_share(a, b, least) >= least


def _sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per document: id, node (a digest of its words), shingles, bands, words (16 bits each).

    A text without words is a node of its own, named by its id, and has no bands.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_slices(batches, "text", SLICE_CHARS):
            rows, numbers, alone = [], [], []
            for name, text in zip(part["id"], part["text"], strict=True):
                words = words_of(text or "")
                if words:
                    digest = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16)
                    rows.append((name, digest.hexdigest()))
                    numbers.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
                else:
                    alone.append((name, f"-{name}", 0, [], b""))
            if rows:
                bands, counts = sketch(numbers)
                yield pd.DataFrame(
                    {
                        "id": [name for name, _ in rows],
                        "node": [node for _, node in rows],
                        "shingles": counts,
                        "bands": list(bands),
                        "words": [(w >> np.uint64(48)).astype(np.uint16).tobytes() for w in numbers],
                    }
                )
            if alone:
                yield pd.DataFrame(alone, columns=["id", "node", "shingles", "bands", "words"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.where("id is not null").mapInPandas(
        run, f"id {kind}, node string, shingles long, bands array<long>, words binary"
    )


def _similar(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in byte_slices(batches, ["words_a", "words_b"], SLICE_BYTES):
            keep = [
                similar(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), least)
                for x, y in zip(batch["words_a"], batch["words_b"], strict=True)
            ]
            yield batch.loc[keep, ["a", "b"]]

    first = words.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    second = words.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(second, "b").join(first, "a").mapInPandas(run, "a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): node and comp, the smallest node that it reaches.

    Labels sink to the least label of the neighbours, and then to that label's own
    label, so that long chains shorten fast. Every step is a written table.
    """
    both = materialize(
        edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
        .union(edges.select("b", "a"))
        .distinct(),
        "links",
    )
    labels = both.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("comp"))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("next"), "comp"), "next")
            .groupBy("node")
            .agg(F.min("comp").alias("low"))
        )
        sunk = labels.join(around, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp")
        )
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = materialize(
            sunk.join(jump, "comp", "left").select(
                "node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")
            ),
            "labels",
        )
        labels = moved.select("node", "comp")
        if moved.where("comp <> was").isEmpty():
            return labels


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges: components of the components they join."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    joined = (
        edges.join(of("a"), "a", "left")
        .join(of("b"), "b", "left")
        .select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    joined = materialize(joined, "joined")
    if joined.isEmpty():
        return labels
    found = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return materialize(
        labels.join(found, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "labels"
    )


def _bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, shingles) of the bands that more than one node has."""
    rows = nodes.select("node", "shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.join(shared, "key", "left_semi")


def _open_members(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    open_keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return members.join(open_keys.select("key"), "key", "left_semi")


def _shingle_rows(words: DataFrame) -> DataFrame:
    """(shingle, node) of all nodes, equal shingles of a node told apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in byte_slices(batches, ["words"], SLICE_BYTES):
            found = [labelled(np.frombuffer(w, np.uint16)) for w in batch["words"]]
            keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
            nodes = np.repeat(batch["node"].to_numpy(), [len(x) for x in found])
            yield pd.DataFrame({"shingle": keys.view(np.int64), "node": nodes})

    return words.mapInPandas(run, "shingle long, node string")


def _rare(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shingles that at most RARE of these nodes have: their number per node, and the pairs they make.

    The pairs (a, b, shared) are those of nodes with a rare shingle in common, and how many. Shingles with
    the same nodes, as one edit leaves several, are put together before their pairs are made.
    """
    rows = materialize(_shingle_rows(words), "shingles")
    few = rows.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    rare = materialize(rows.join(few, "shingle").select("shingle", "n", "node"), "rare")
    numbers = rare.groupBy("node").agg(F.count("*").alias("rare"))
    sets = (
        rare.where("n > 1")
        .groupBy("shingle")
        .agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # RARE nodes at most
        .groupBy("nodes")
        .agg(F.count("*").alias("w"))
    )
    first = sets.select("nodes", "w", F.posexplode("nodes").alias("at", "a"))
    pairs = first.select("a", "w", F.explode(F.slice("nodes", F.col("at") + 2, RARE)).alias("b"))
    return numbers, pairs.groupBy("a", "b").agg(F.sum("w").alias("shared"))


def _rare_links(pairs: DataFrame, nodes: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links between nodes with rare shingles in common, where numbers alone don't rule them out."""
    of = lambda side: nodes.select(
        F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("shingles", "common", "comp")]
    )
    most = F.least("a_common", "b_common") + F.col("shared")
    could = most >= (least - 1e-9) * (F.col("a_shingles") + F.col("b_shingles") - most)
    told = pairs.join(of("a"), "a").join(of("b"), "b")
    return _similar(told.where((F.col("a_comp") != F.col("b_comp")) & could).select("a", "b"), words, least)


def _prune(rows: DataFrame, least: float) -> DataFrame:
    """Members of open buckets that could still have a link there.

    All pairs with rare shingles in common have been met, so that a node can share only its
    ``common`` shingles with any other, and a partner has at least as many shingles as the
    bucket's smallest member. Where that can't reach ``least``, leaving the node out loses nothing.
    """
    smallest = rows.groupBy("key").agg(F.min("shingles").alias("smallest"))
    best = F.col("common") / (F.greatest("smallest", "common") + F.col("shingles") - F.col("common"))
    kept = rows.join(smallest, "key").where(best >= least - 1e-9).drop("smallest")
    return materialize(_open_members(kept), "open")


def _linked(words: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Components of nodes: leaders of each bucket meet its members until one component is left.

    The first leader of a bucket is any member, which joins most of a group. Then all pairs with rare
    shingles in common meet, whatever their buckets. Further leaders are those with the largest share of
    shingles that are not rare, which are likely near to most others. A leader meets all members of other
    components that could be similar to it, and then leaves the bucket for good. Each round
    sends more leaders out, for those that are left have few members they could be similar to.
    """
    labels = materialize(members.select("node", F.col("node").alias("comp")).distinct(), "labels")
    rows = members.withColumn("comp", F.col("node")).withColumn("common", F.col("shingles"))
    turns = 1
    while True:
        order = W.partitionBy("key").orderBy(F.desc(F.col("common") / F.col("shingles")), "node")
        leaders = materialize(
            rows.withColumn("_turn", F.row_number().over(order))
            .where(F.col("_turn") <= turns)
            .select(
                "key",
                F.col("node").alias("a"),
                F.col("shingles").alias("a_n"),
                F.col("common").alias("a_common"),
                F.col("comp").alias("a_comp"),
            ),
            "leaders",
        )
        most = F.least("a_common", "common")
        could = most >= (least - 1e-9) * (F.col("a_n") + F.col("shingles") - most)
        pairs = (
            rows.join(leaders, "key")
            .where((F.col("comp") != F.col("a_comp")) & could)
            .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
            .distinct()
        )
        labels = _merge(labels, _similar(pairs, words, least))
        left = rows.select("key", "node", "shingles", "common").join(
            leaders.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti"
        )
        rows = materialize(_open_members(left.join(labels, "node")), "open")
        if rows.isEmpty():
            return labels
        if turns == 1:
            inside = rows.select("node", "shingles").distinct()
            numbers, pairs = _rare(words.join(inside, "node", "left_semi"))
            nodes = inside.join(numbers, "node", "left").join(labels, "node").select(
                "node", "shingles", "comp", (F.col("shingles") - F.coalesce("rare", F.lit(0))).alias("common")
            )
            nodes = materialize(nodes, "common")
            labels = _merge(labels, _rare_links(pairs, nodes, words, least))
            rows = rows.select("key", "node", "shingles").join(nodes.select("node", "common"), "node")
            rows = rows.join(labels, "node")
        rows = _prune(rows, least)
        if rows.isEmpty():
            return labels
        turns *= MORE_LEADERS


def near_duplicate_classes(
    docs: DataFrame, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document: id, ``class_id`` (the smallest id of its class), ``class_size`` in rows.

    Exact copies (the same words in the same order) are one node, so that copies are
    never paired. A null or wordless text is a class of its own. Rows with a null id
    give nulls. Ids that occur twice take the class of each row's text. Texts of under
    five words are similar only if equal. Other columns play no part, whole texts
    count, and an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sketches = materialize(_sketches(docs, id_column, text_column), "sketches")
    nodes = materialize(
        sketches.groupBy("node").agg(
            F.min("id").alias("first"),
            F.count("*").alias("copies"),
            F.first("shingles").alias("shingles"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    members = materialize(_bucket_members(nodes), "members")
    inside = members.select("node").distinct()
    words = materialize(
        sketches.select("node", "words")
        .join(inside, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("words").alias("words")),
        "words",
    )
    labels = _linked(words, members, least)
    told = nodes.select("node", "first", "copies").join(labels, "node", "left")
    told = told.withColumn("comp", F.coalesce("comp", "node"))
    classes = told.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    of_node = materialize(told.join(classes, "comp").select("node", "class_id", "class_size"), "node_classes")
    found = sketches.select("id", "node").join(of_node, "node")
    nameless = docs.where(F.col(id_column).isNull()).select(
        id_column, F.col(id_column).alias("class_id"), F.lit(None).cast("long").alias("class_size")
    )
    return found.select(F.col("id").alias(id_column), "class_id", "class_size").union(nameless)


def drop_near_duplicates(
    docs: DataFrame, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each class of ``near_duplicate_classes``: one with the smallest id.

    All columns are kept. Rows with a null id all stay, for they cannot be told apart.
    """
    classes = near_duplicate_classes(docs, least, id_column, text_column)
    kept = classes.where(F.col(id_column) == F.col("class_id")).select(id_column).distinct()
    named = docs.join(kept, id_column, "left_semi").dropDuplicates([id_column])
    return named.union(docs.where(F.col(id_column).isNull()))
