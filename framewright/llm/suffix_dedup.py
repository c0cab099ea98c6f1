"""Repeated byte strings by suffix arrays, built linearly over groups of Lyndon prefixes.

Every window of ``length`` bytes has one anchor: the byte gram in it with the least hash, the
leftmost of equal ones. Equal windows have equal anchors at equal places, so windows can only
repeat among the segments (the neighbouring windows of one anchor, as one string) that share
an anchor. Equal segments are one entry with a count: a window of a segment that occurs twice
repeats. Segments that differ are cut into pieces, which meet by the core, the bytes that all
windows of a piece hold. A piece is then a string of the bytes before the core, the core as
one symbol, and the bytes behind it; the pieces of a core are suffix-sorted together, and a
window repeats if its neighbour in the suffix array begins with the same window. No key
gathers more than a bounded group: pieces of a larger one are halved, which makes the core
longer, until it tells them apart or is the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import prepare
from framewright.session import materialize

#: Bytes of an anchor gram, for windows that are longer.
GRAM = 64

#: Pieces of one core that are sorted together at most, and symbols of one suffix array.
GROUP_PIECES, SORT_SYMBOLS = 2000, 1 << 17

#: Pieces that a task sorts, some seconds of work.
TASK_PIECES = 20_000

#: Windows of a piece at first.
SPAN = 64

PIECE = "anchor long, segment long, n long, high int, span int, core binary, before binary, behind binary"
PIECE_COLUMNS = ["anchor", "segment", "n", "high", "span", "core", "before", "behind"]
WINDOWS = "anchor long, segment long, first int, last int"

#: Bytes of texts that a Python worker holds at once, or one longer text.
SLICE_BYTES = 1 << 23

#: Grams of a long document that are hashed at once: their number fits into the low bits of a key.
CHUNK_BITS = 20

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; a chunk bounds how many there are."""
    if len(_POWERS.get("up", ())) < n:
        most = max(n, 1 << 14)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(most, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes, by differences of running sums."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of every ``width`` neighbours, the leftmost of equal ones."""
    n = len(values)
    mask = np.uint64((1 << CHUNK_BITS) - 1)
    keys = (values & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[width - 1 : n]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1]
    return (np.minimum(ahead, behind) & mask).astype(np.int64)


def segments(data: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's place, its hash, first and last window) for the windows of each anchor.

    A long document is read in chunks; windows of one anchor on both sides of a cut are two
    segments, which are compared like those of different documents.
    """
    last = len(data) - length
    step = (1 << CHUNK_BITS) - length
    for begin in range(0, last + 1, step):
        chunk = np.frombuffer(data, np.uint8, min(step + length - 1, len(data) - begin), begin)
        hashes = gram_hashes(chunk, gram)
        anchors = leftmost_least(hashes, length - gram + 1)
        cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        firsts = np.concatenate(([0], cuts))
        lasts = np.concatenate((cuts - 1, [len(anchors) - 1]))
        places = anchors[firsts]
        yield from zip(
            (places + begin).tolist(),
            hashes[places].view(np.int64).tolist(),
            (firsts + begin).tolist(),
            (lasts + begin).tolist(),
            strict=True,
        )


def segment_id(data: bytes, place: int, first: int, last: int, length: int) -> int:
    """Digest of a segment's bytes and of where its anchor lies; with the anchor's hash 128 bits."""
    salt = (place - first).to_bytes(8, "little")
    digest = hashlib.blake2b(data[first : last + length], digest_size=8, salt=salt).digest()
    return int.from_bytes(digest, "little", signed=True)


def core_id(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def suffix_array(text: np.ndarray) -> list[int]:
    """Starts of the suffixes of a string of numbers in ascending order, the end being the least.

    First suffixes are grouped by their Lyndon prefix. Groups start as equal first symbols and
    are taken in descending order: when one is taken, its members' prefixes are final. Each
    member points to the previous suffix of a lower group, whose prefix grows by the group's;
    those that grow move up within their group, the higher the more often. Then suffixes are
    emitted in ascending order: whoever's Lyndon prefix ends where the emitted suffix starts
    is the next of its group.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, group, place = order.tolist(), group.tolist(), place.tolist()
    size = [0] * n
    for start, count in zip(starts.tolist(), sizes.tolist(), strict=True):
        size[start] = count
    previous = [-1] * n

    def rise(members: list[int]) -> None:
        """Move members to the upper end of their groups, as groups of their own."""
        taken: dict[int, int] = {}
        for p in members:
            g = group[p]
            count = taken.get(g, 0) + 1
            taken[g] = count
            at = g + size[g] - count
            q, here = sa[at], place[p]
            sa[here], sa[at] = q, p
            place[q], place[p] = here, at
        taken = {g: count for g, count in taken.items() if count < size[g]}
        for p in members:
            g = group[p]
            if g in taken:
                group[p] = g + size[g] - taken[g]
        for g, count in taken.items():
            size[g] -= count
            size[g + size[g]] = count

    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            s = sa[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                g = group[p]
                if size[g] > 1:  # the one member that grows becomes the group above the rest
                    size[g] -= 1
                    at = g + size[g]
                    q, here = sa[at], place[p]
                    sa[here], sa[at] = q, p
                    place[q], place[p] = here, at
                    group[p], size[at] = at, 1
        else:
            times: dict[int, int] = {}
            for s in sorted(sa[start:end]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                most = max(times.values())
                if most == 1:
                    rise(list(times))
                else:
                    by_times: dict[int, list[int]] = {}
                    for p, count in times.items():
                        by_times.setdefault(count, []).append(p)
                    for count in sorted(by_times, reverse=True):
                        rise(by_times[count])
        end = start

    out, free, emitted = [0] * n, group, bytearray(n + 1)
    # ``group[s]`` is where the group starts; the next free place of a group is kept at its start.
    following = list(range(n))
    s = n - 1
    while s >= 0:
        g = free[s]
        out[following[g]] = s
        following[g] += 1
        emitted[s] = 1
        s = previous[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not emitted[s]:
            g = free[s]
            out[following[g]] = s
            following[g] += 1
            emitted[s] = 1
            s = previous[s]
    return out


def repeated_windows(pieces: list[tuple[bytes, bytes, bytes, int]]) -> list[set[int]]:
    """Per (core, left, right, span) piece: for which numbers of left bytes its windows occur in two pieces.

    Pieces of a core have one span, which is also a window's length in symbols. Equal pieces are sorted as one:
    all their windows repeat. A piece is left out if no other of its core can share a window: of the bytes that
    a window has besides the core, half are to the left or half to the right.
    """
    alike: dict[tuple[bytes, bytes, bytes, int], list[int]] = {}
    for i, piece in enumerate(pieces):
        alike.setdefault(piece, []).append(i)
    sides: dict[tuple, int] = {}

    def halves(piece: tuple[bytes, bytes, bytes, int]) -> list[tuple]:
        core, left, right, span = piece
        half = span // 2
        whole = [(core, "left", left[len(left) - half :])] if len(left) >= half else []
        return whole + ([(core, "right", right[:half])] if len(right) >= half else [])

    for piece in alike:
        for side in halves(piece):
            sides[side] = sides.get(side, 0) + 1
    met = [piece for piece in alike if any(sides[side] > 1 for side in halves(piece))]
    found: list[set[int]] = [set() for _ in pieces]
    for piece, lefts in zip(met, _repeated_in_several(met), strict=True):
        for i in alike[piece]:
            found[i] = lefts
    for (_, left, right, span), places in alike.items():
        if len(places) > 1:
            # A window starts at the core or before it, and ends within the piece.
            every = set(range(max(0, span - 1 - len(right)), min(len(left), span - 1) + 1))
            for i in places:
                found[i] = every
    return found


def _repeated_in_several(pieces: list[tuple[bytes, bytes, bytes, int]]) -> list[set[int]]:
    """``repeated_windows`` of different pieces, by their suffix array."""
    cores: dict[bytes, int] = {}
    symbols, owner, spans, starts = [], [], [], []
    for i, (core, left, right, span) in enumerate(pieces):
        starts.append(len(symbols))
        symbols += left
        symbols.append(256 + cores.setdefault(core, len(cores)))
        symbols += right
        symbols.append(-1)
        size = len(left) + len(right) + 2
        owner += [i] * size
        # A window starts at the core or before it, and ends within the piece.
        whole = max(min(len(left), size - 1 - span) + 1, 0)
        spans += [span] * whole + [0] * (size - whole)
    found: list[set[int]] = [set() for _ in pieces]
    text = np.asarray(symbols, np.int64) + 1
    raw = text.astype("<u4").tobytes()
    before = -1
    for s in suffix_array(text):
        span = spans[s]
        if not span:
            continue
        if before >= 0 and spans[before] == span and raw[4 * s : 4 * (s + span)] == raw[4 * before : 4 * (before + span)]:
            for place in (before, s):
                i = owner[place]
                found[i].add(len(pieces[i][1]) - (place - starts[i]))
        before = s
    return found


def cut_segments(length: int, gram: int):
    """Batches of (doc, data) to the distinct segments of each document with all their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in data_slices(batches):
            rows = []
            for doc, data in zip(batch["doc"].tolist(), batch["data"], strict=True):
                found: dict[tuple, list[int]] = {}
                for place, anchor, first, last in segments(data, length, gram):
                    key = anchor, segment_id(data, place, first, last, length), place - first, last - first
                    found.setdefault(key, []).append(first)
                rows += [(doc, *key, firsts) for key, firsts in found.items()]
            yield pd.DataFrame(rows, columns=["doc", "anchor", "segment", "ahead", "extent", "firsts"])

    return run


def data_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut batches of texts so that few bytes are worked on at once."""
    for batch in batches:
        sizes = np.cumsum([len(x) for x in batch["data"]]) // SLICE_BYTES
        for number in np.unique(sizes):
            yield batch[sizes == number]


def cut_pieces(length: int, span: int):
    """Batches of (data, asked segments) to their pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in data_slices(batches):
            rows = []
            for data, asked in zip(batch["data"], batch["asked"], strict=True):
                for part in asked:
                    first, ahead, extent = part["first"], part["ahead"], part["extent"]
                    if segment_id(data, first + ahead, first, first + extent, length) != part["segment"]:
                        continue  # another document with the same number
                    place, last = first + ahead, first + extent
                    # Windows start at distances 0, 1, ... before the anchor; a piece holds the span's share.
                    for number in range((place - last) // span, (place - first) // span + 1):
                        high, low = place - number * span, place - number * span - span + 1
                        begin, end = max(low, first), min(high, last)
                        core = core_id(number.to_bytes(4, "little"), data[high : low + length])
                        left, right = data[begin:high], data[low + length : end + length]
                        rows.append((part["anchor"], part["segment"], part["n"], -number * span, span, core, left, right))
            yield pd.DataFrame(rows, columns=PIECE_COLUMNS)

    return run


def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece as the two pieces of its upper and lower windows, with longer cores."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            low = r.span // 2
            high = r.span - low
            left, right = r.before, r.behind
            if len(right) >= low:
                kept = left[max(len(left) - high + 1, 0) :]
                rows.append((r.anchor, r.segment, r.n, r.high, high, core_id(b"R", r.core, right[:low]), kept, right[low:]))
            if low and len(left) >= high:
                core = core_id(b"L", r.core, left[len(left) - high :])
                rows.append((r.anchor, r.segment, r.n, r.high - high, low, core, left[: len(left) - high], right[: low - 1]))
        yield pd.DataFrame(rows, columns=PIECE_COLUMNS)


def sort_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffix-sort the pieces, which come sorted by core, some whole cores at a time."""

    def ranges(rows: list) -> pd.DataFrame:
        out = []
        found = repeated_windows([(r.core, r.before, r.behind, r.span) for r in rows])
        for r, lefts in zip(rows, found, strict=True):
            if r.n == 1 and lefts:
                places = np.sort(r.high - np.fromiter(lefts, np.int64))
                cut = np.flatnonzero(np.diff(places) > 1)
                begins = places[np.concatenate(([0], cut + 1))]
                ends = places[np.concatenate((cut, [len(places) - 1]))]
                out += [(r.anchor, r.segment, int(a), int(b)) for a, b in zip(begins, ends, strict=True)]
        return pd.DataFrame(out, columns=["anchor", "segment", "first", "last"])

    held, symbols = [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            if symbols > SORT_SYMBOLS and held[-1].core != r.core:
                yield ranges(held)
                held, symbols = [], 0
            held.append(r)
            symbols += len(r.before) + len(r.behind) + 2
    if held:
        yield ranges(held)


def repeated_in_pieces(pieces: DataFrame) -> DataFrame:
    """Windows (as distances from the anchor) of the pieces' segments that other pieces hold as well."""
    found = []
    whole = F.col("high") - F.length("before"), F.col("high") - F.col("span") + 1 + F.length("behind")
    while True:
        cores = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("in_core")).where("in_core > 1")
        met = materialize(pieces.join(cores, "core"), "pieces")
        small = met.where(F.col("in_core") <= GROUP_PIECES).drop("in_core")
        # The number of tasks is that of the work: sorting takes far longer than its bytes tell.
        tasks = max(small.sparkSession.sparkContext.defaultParallelism, -(-small.count() // TASK_PIECES))
        sorted_by_core = small.repartition(tasks, "core").sortWithinPartitions("core")
        found.append(sorted_by_core.mapInPandas(sort_pieces, WINDOWS))
        large = met.where(F.col("in_core") > GROUP_PIECES).drop("in_core")
        if large.isEmpty():
            break
        same = ["core", "before", "behind"]
        copies = large.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
        alike = large.join(copies.where("copies > 1"), same).where("n = 1")
        found.append(alike.select("anchor", "segment", whole[0].cast("int").alias("first"), whole[1].cast("int").alias("last")))
        pieces = large.dropDuplicates(same).mapInPandas(halve, PIECE)
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    return union


def remove(length: int):
    """Batches of (id, data, begins, ends) to what is left of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in data_slices(batches):
            rows = []
            for name, data, parts in zip(batch["id"], batch["data"], batch["parts"], strict=True):
                gone = np.zeros(len(data) + 1, np.int32)
                for part in parts if parts is not None else ():
                    ahead, extent = part["ahead"], part["extent"]
                    for first in part["firsts"].tolist():
                        if segment_id(data, first + ahead, first, first + extent, length) != part["segment"]:
                            continue  # another document with the same number
                        windows = part["windows"]
                        if windows is None:
                            windows = [{"first": -ahead, "last": extent - ahead}]
                        for w in windows:
                            gone[first + ahead + w["first"]] += 1
                            gone[first + ahead + w["last"] + length] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                spans = int(covered[:1].sum()) + int((covered[1:] & ~covered[:-1]).sum())
                left = np.frombuffer(data, np.uint8)[~covered].tobytes() if spans else data
                rows.append((name, len(data), int(covered.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(
    docs: DataFrame,
    length: int = 400,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every document without its repeated strings.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else as well, in the same document or
    in another; strings are judged on the input. Runs of removed bytes are spans. ``with_text`` adds ``kept``, the
    bytes left, which may split a character. A null text is empty; texts shorter than ``length`` stay as they are.
    Repeated rows are documents of their own, so that from ``length`` bytes on they go whole; ids may be null or
    repeated. An empty table gives no rows. Other columns play no part.
    """
    gram = min(GRAM, max(length // 2, 1))
    spark = docs.sparkSession
    prepare(spark)
    id_type = docs.schema[id_column].dataType.simpleString()
    data = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).alias("id"), data.alias("data"))
    rows = rows.withColumn("doc", F.xxhash64("id", "data"))  # rows that agree in it are told apart by digests
    long_enough = rows.where(F.length("data") >= length).select("doc", "data")
    cut = "doc long, anchor long, segment long, ahead int, extent int, firsts array<int>"
    found = materialize(long_enough.mapInPandas(cut_segments(length, gram), cut), "segments")

    key = ["anchor", "segment"]
    shared = found.groupBy("anchor").agg(F.sum(F.size("firsts")).alias("n")).where("n > 1").select("anchor")
    shared = materialize(found.join(shared, "anchor"), "shared_segments")
    kinds = shared.groupBy(*key).agg(F.sum(F.size("firsts")).alias("n"), F.min("doc").alias("doc"))
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("once"))
    differing = kinds.join(anchors.where("kinds > 1 and once > 0").select("anchor"), "anchor")
    asked = shared.join(differing, [*key, "doc"]).select(
        "doc", F.struct(*key, "n", "ahead", "extent", F.col("firsts")[0].alias("first")).alias("part")
    )
    asked = asked.groupBy("doc").agg(F.collect_list("part").alias("asked"))
    pieces = long_enough.join(asked, "doc").select("data", "asked").mapInPandas(cut_pieces(length, min(SPAN, length - gram)), PIECE)
    # Repeated rows of one document ask for the same segments.
    pieces = materialize(pieces.dropDuplicates([*key, "high"]), "pieces")

    windows = repeated_in_pieces(pieces).groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    whole = kinds.where("n > 1").select(*key, F.lit(None).cast("array<struct<first:int,last:int>>").alias("windows"))
    repeats = shared.join(windows.unionByName(whole), key).select(
        "doc", F.struct("segment", "ahead", "extent", "firsts", "windows").alias("part")
    )
    repeats = repeats.groupBy("doc").agg(F.collect_list("part").alias("parts"))
    kept = rows.join(repeats, "doc", "left").select("id", "data", "parts")
    out = kept.mapInPandas(
        remove(length), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    return out.select(F.col("id").alias(id_column), *columns)
