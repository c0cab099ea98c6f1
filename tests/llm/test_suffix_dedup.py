"""Repeated strings against counting every window, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from framewright.llm import suffix_dedup
from framewright.llm.suffix_dedup import leftmost_least, remove_repeats, segments, suffix_array

SCHEMA = "doc_id long, text string, doc string, data string, n int, anchor int"


def brute(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    counts = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for name, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((name, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, docs, length):
    df = spark.createDataFrame([(*d, "", "", 0, 1) for d in docs], SCHEMA)
    return sorted((tuple(r) for r in remove_repeats(df, length).collect()), key=repr)


def made(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeénst") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(length // 3) for _ in range(4)]
    docs = [(i, prose(rng.randrange(length))) for i in range(20)]
    for i in range(20, 60):  # passages in other surroundings, whole or cut anywhere, sometimes twice in a text
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [prose(rng.randrange(40)), p[a : rng.randrange(a, len(p))] if rng.random() < 0.5 else p]
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (None, prose(length)), (62, "a" * (3 * length)), (63, "ab" * (2 * length) + "b")]
    docs += [(64, "x" * (length - 1)), (65, "y" * length), (66, "z" * (length + 1)), (67, "é" * length), (67, docs[5][1])]
    base = docs[30][1]
    docs += [(70 + i, base) for i in range(5)] + docs[40:43]  # copies, and repeated rows
    for i in range(15):  # near copies
        words = base.split(" ")
        words[rng.randrange(len(words))] = word()
        docs.append((100 + i, " ".join(words)))
    return docs


@pytest.mark.parametrize(("seed", "length"), [(1, 60), (2, 200), (3, 400)])
def test_against_all_windows(spark, seed, length):
    docs = made(seed, length)
    assert got(spark, docs, length) == brute(docs, length)


def test_large_groups_are_halved(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_PIECES", 3)
    docs = made(4, 120)
    assert got(spark, docs, 120) == brute(docs, 120)


def test_long_text_is_read_in_chunks(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    cut = (1 << 20) - 400
    long = long[: cut - 350] + passage + long[cut + 350 :]
    rows = got(spark, [(1, long), (2, "x" + passage + "y"), (3, "no")], 400)
    kept = long.replace(passage, "").encode()
    assert rows[0][:4] == (1, len(long), 700, 1) and rows[0][4] == hashlib.sha256(kept).hexdigest()
    assert rows[1][:4] == (2, 702, 700, 1) and rows[2][1:4] == (2, 0, 0)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "k" + "ab" * 300), (2, "ab" * 300)], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(df, with_text=True).collect()} == {1: b"k", 2: b""}


@pytest.mark.parametrize("symbols", [1, 2, 3, 300])
def test_suffix_array(symbols):
    rng = random.Random(symbols)
    for _ in range(300):
        text = [rng.randrange(symbols) for _ in range(rng.randrange(60))]
        assert suffix_array(np.asarray(text, np.int64)) == sorted(range(len(text)), key=lambda i: text[i:])


def test_every_window_has_one_anchor_that_its_copies_have_too():
    rng = random.Random(9)
    shared = bytes(rng.randrange(256) for _ in range(900))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + shared + b"tail" * n for n in (3, 500)]
    anchored = []
    for text in texts:
        own = {}
        for place, anchor, first, last in segments(text, 400, 64):
            for w in range(first, last + 1):
                assert w not in own and w <= place <= w + 400 - 64
                own[w] = place - w, anchor
        assert len(own) == len(text) - 399
        at = text.index(shared)
        anchored.append([own[at + i] for i in range(501)])
    assert anchored[0] == anchored[1]


def test_leftmost_least():
    values = np.random.default_rng(1).integers(0, 4, 500, dtype=np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(values[i : i + 37])) for i in range(500 - 36)]
    assert leftmost_least(values, 37).tolist() == want


def test_documents_table(spark):
    from framewright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op12_suffix_dedup"](spark, sf).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute(docs, 400)
    assert sum(r["n_removed"] > 0 for r in rows) > 10


def test_equal_and_strange_pieces_are_not_sorted(monkeypatch):
    """Copies of a piece are one entry of the suffix array, and pieces that share no half of a window none."""
    rng = random.Random(7)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    pieces = []
    for core in (b"x" * 16, b"y" * 16):
        pieces += [(core, some(rng.randrange(8)), some(rng.randrange(8)), 8) for _ in range(150)]
        pieces += [(core, b"ccccccc", b"ddddddd", 8)] + [(core, b"eeeeee", b"fffffff", 8)] * 40
    # Pieces of another span, which are too short for a window or have one byte of it at most.
    pieces += [(b"z" * 16, b"", b"", 2), (b"z" * 16, b"", b"", 2), (b"w" * 16, b"", b"", 1), (b"w" * 16, b"", b"", 1)]
    counts = Counter()
    windows = []
    for core, left, right, span in pieces:
        mine = {i: (core, left[len(left) - i :], right[: span - 1 - i]) for i in range(len(left) + 1) if 0 <= span - 1 - i <= len(right)}
        windows.append(mine)
        counts.update(mine.values())
    want = [{i for i, w in mine.items() if counts[w] > 1} for mine in windows]
    sorted_symbols = []
    plain = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sorted_symbols.append(len(text)) or plain(text))
    assert suffix_dedup.repeated_windows(pieces) == want
    assert any(want) and not all(want)
    different = {p for p in pieces if p[1] not in (b"ccccccc", b"eeeeee")}
    assert sum(sorted_symbols) <= sum(len(p[1]) + len(p[2]) + 2 for p in different)
