"""Packing by power-of-two decomposition: no sequence holds two documents.

Every document's tokens are cut into pieces whose lengths are powers of two:
as many of the longest length as fit, then the binary digits of the rest. Each
piece is a sequence of its own, without padding, and sequences of one length
form a bucket, from which batches of one shape can be drawn.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import prepare, tokenizer_path

#: Letters beyond Latin and blanks that tools class differently.
_ODD = re.compile("[^\x00-\x84\x86-\x9f\xa1-\u024f]")
#: ASCII that tools class differently, and the start of a special token.
_MARKS = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: How the tokenizer cuts a word; fixed values of its file.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words kept with their ids by one worker; beyond this the later half is forgotten.
CACHED_WORDS = 1_000_000
#: Token ids sent in one Arrow batch.
BATCH_TOKENS = 1_000_000


def _is_odd(text: str) -> bool:
    return any(mark in text for mark in _MARKS) or (not text.isascii() and _ODD.search(text) is not None)


class WordEncoder:
    """Ids of whole texts by a word-level BPE tokenizer, remembering words.

    The tokenizer lower-cases, splits at white space and encodes each part of a
    word alone, so that a text's ids are its words' ids in a row. Texts for which
    this is not evident (other scripts, odd blanks, special tokens) go through
    the tokenizer whole.
    """

    def __init__(self, path: str, most_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.most_words = most_words
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if _is_odd(text) else text.lower().split() for text in texts]
        if len(self.words) > self.most_words:
            # Frequent words are met early: those that were met first stay.
            self.words = dict(islice(self.words.items(), self.most_words // 2))
        self._learn(set(filterfalse(self.words.__contains__, chain.from_iterable(filter(None, split)))))
        of = self.words.__getitem__
        odd = iter(self._whole([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [next(odd) if words is None else b"".join(map(of, words)) for words in split]

    def _learn(self, fresh: set[str]) -> None:
        # Most words are one part, and most parts of the others are words that are known.
        cut = {word: _PARTS.findall(word) for word in fresh if not word.isalpha()}
        of: dict[str, bytes] = {}
        fresh.difference_update(cut)
        parts = fresh.union(*cut.values()) if cut else fresh
        lacking = list(filterfalse(self.words.__contains__, parts))
        for first in range(0, len(lacking), 4096):
            some = lacking[first : first + 4096]
            # The way without character offsets, which nothing here needs.
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                raw, ends = ids.tobytes(), (4 * at).tolist()
                of.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                of.update(zip(some, self._whole(some), strict=True))
        # A part that is no word of its own is not remembered.
        of.update((part, self.words[part]) for part in parts if part not in of)
        self.words.update((word, of[word]) for word in fresh)
        self.words.update((word, b"".join([of[part] for part in found])) for word, found in cut.items())

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]


@functools.lru_cache(maxsize=2)
def encoder(path: str, most_words: int) -> WordEncoder:
    return WordEncoder(path, most_words)


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Powers of two that add up to ``tokens``, the longest first."""
    rest = tokens % longest
    bits = [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]
    return [longest] * (tokens // longest) + bits


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    max_tokens: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
    most_words: int = CACHED_WORDS,
) -> DataFrame:
    """One row per piece, which is a sequence: id, start, length, ids, doc_tokens, …

    ``ids`` holds the piece's token ids, ``ids_crc32`` their checksum as
    little-endian unsigned 32-bit numbers, ``doc_tokens`` the document's tokens
    with the closing ``end_id``, ``sequence_id`` a number of the sequence and
    ``offset`` the place in it, which is 0. The bucket is ``length``; writers can
    partition by it. There is no shuffle: each document is cut where it is read.

    Null and empty texts give the closing id alone. Null ids stay null, repeated
    rows are packed each for itself, other columns are left out, and an empty
    table gives no rows. Texts of any length are taken whole. A worker remembers the ids of
    ``most_words`` words or little more: fewer take less memory and more time.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens has to be a power of two")
    prepare(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    end = np.asarray([end_id], "<u4").tobytes()
    id_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField(id_column, id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )

    def batch_of(names, rows, found) -> pa.RecordBatch:
        start, length, crc, total, place = (np.asarray(x, np.int64) for x in zip(*rows, strict=True))
        values = pa.array(np.frombuffer(b"".join(found), "<i4"))
        offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(place)),
                pa.array(start),
                pa.array(length),
                pa.ListArray.from_arrays(offsets, values),
                pa.array(crc),
                pa.array(total),
            ],
            names=[f.name for f in schema],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, most_words)
        for batch in batches:
            names, rows, found, tokens = batch.column(0), [], [], 0
            for first in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(first, 256).to_pylist()]
                for place, ids in enumerate(words.encode(texts), first):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length in piece_lengths(total, max_tokens):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((start, length, zlib.crc32(piece), total, place))
                        found.append(piece)
                        start += length
                        tokens += length
                        if tokens >= BATCH_TOKENS:
                            yield batch_of(names, rows, found)
                            rows, found, tokens = [], [], 0
            if rows:
                yield batch_of(names, rows, found)

    return (
        docs.select(id_column, text_column)
        .mapInArrow(cut, schema)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )
