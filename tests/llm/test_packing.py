import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from framewright.llm.common import tokenizer_path
from framewright.llm.packing import WordEncoder, pack_documents, piece_lengths

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "", None, "Hello, WORLD! it's 3½ x²y  ...", "tab\tand\nline\r\nÄÖÜ ßtraße éÉ", "ΑΣ ΟΔΟΣ", "日本語 text",
    "a <|endoftext|> b", "nb sp \u0085 \x1c\x1d z", "é combining", "word " * 5000, "x" * 30000, "İstanbul",
]


@pytest.mark.parametrize("tokens", [0, 1, 2, 3, 2047, 2048, 2049, 6000, 123457])
def test_piece_lengths(tokens):
    lengths = piece_lengths(tokens, 2048)
    assert sum(lengths) == tokens
    assert all(n & (n - 1) == 0 and n <= 2048 for n in lengths)
    assert lengths == sorted(lengths, reverse=True)
    assert len({n for n in lengths if n < 2048}) == len([n for n in lengths if n < 2048])


def test_word_encoder_equals_tokenizer():
    plain = Tokenizer.from_file(PATH)
    words = WordEncoder(PATH)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # fresh words, then remembered ones
        for text, got in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark):
    rows = [(i, t, "clash", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "", 1), (0, "twice", "", 2), (0, "twice", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    got = pack_documents(docs).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted([(i is None, i or 0, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows])
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in got)
    assert all(zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    once = [r for r in got if r["doc_id"] != 0]
    back = {}
    for r in sorted(once, key=lambda r: r["start"]):
        ids = back.setdefault(r["doc_id"], [])
        assert len(ids) == r["start"]
        ids += r["ids"]
    assert sorted((k is None, k or 0, v) for k, v in back.items()) == [w for w in want if w[:2] != (False, 0)]
    assert sum(r["length"] for r in got if r["doc_id"] == 0) == sum(len(w[2]) for w in want if w[:2] == (False, 0))


def test_empty_table_and_other_names(spark):
    docs = spark.createDataFrame([], "key string, body string")
    assert pack_documents(docs, id_column="key", text_column="body").count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, max_tokens=1000, id_column="key", text_column="body")


def test_forgotten_words_are_learned_again(monkeypatch):
    from framewright.llm import packing

    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    words = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [f"the word{i % 11} of it, and number {i % 7}." for i in range(60)]
    for i in range(0, 60, 3):
        for text, ids in zip(texts[i : i + 3], words.encode(texts[i : i + 3]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(words.words) <= 5 + 40


def test_a_small_memory_of_words_changes_no_row(spark):
    """A pipeline's workers hold other models too: their memory of words is bounded by its caller."""
    texts = [" ".join(f"w{chr(97 + i % 26)}{j}" for j in range(i * 40, i * 40 + 60)) for i in range(600)]
    words = WordEncoder(PATH, 500)
    for first in range(0, 600, 20):
        words.encode(texts[first : first + 20])
        assert len(words.words) <= 500 + 20 * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    few, many = (sorted(pack_documents(docs, **kw).select(*columns).collect()) for kw in ({"most_words": 500}, {}))
    assert few == many


def test_frequent_words_stay_when_the_memory_is_full(monkeypatch):
    words = WordEncoder(PATH, most_words=40)
    plain = Tokenizer.from_file(PATH)
    asked = []
    learn = WordEncoder._learn
    monkeypatch.setattr(WordEncoder, "_learn", lambda self, fresh: asked.append(set(fresh)) or learn(self, fresh))
    for i in range(30):
        text = "the of, and " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}x{'.' * (j % 2)}" for j in range(20))
        (got,) = words.encode([text])
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        if not i:
            words.words = {w: words.words[w] for w in sorted(words.words, key=lambda w: w not in {"the", "of,", "and"})}
        assert len(words.words) <= 40 + 23
    assert sum("of," in fresh for fresh in asked) == 1
