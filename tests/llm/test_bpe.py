"""BPE by the trie against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scrubframe.llm import bpe, queries
from tests.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n\r\x0b\x0c", "The quick brown fox's isn't they'll 'tis I'm", "a\xa0b \xa0 c d   \x85 e\x1cf", "Ärger été ́x ﬁ Å ΑΣ σας ΑΣ. İstanbul ẞ",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|endof text|> <|ENDOFTEXT|> <|<|endoftext|>", "12345 3.14 ½ ² ٣٤ 一二三 你好，世界！ こんにちは 한국어", "😀👍🏽 ‍ ﻿​ zero",
    "a" * 5000, "ab" * 700 + "!" * 999, "İ" * 30, "''s 's's 'S'LL 'Ll", "\x00\x01\x7f ퟿\U0010ffff", "тест Ёлка ЙОГ й", "हिन्दी ไทย עברית العربية",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_edge_texts_against_the_library(spark, library):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, TEXTS[3], "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, ids int")
    got = bpe.encoded(frame, PATH, decode=True).collect()
    assert len(got) == len(rows) and bpe.encoded(frame.limit(0), PATH).count() == 0
    again = bpe.decoded(bpe.encoded(frame, PATH), PATH)
    back = {r["doc_id"]: r["decoded"] for r in again.collect()}
    for r in got:
        ids, text = expected(library, "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids), r["doc_id"]
        assert r["decoded"] == text == back[r["doc_id"]]


def test_random_words_against_the_library(library):
    own = bpe.Codec(open(PATH, encoding="utf-8").read())
    rng = np.random.default_rng(2)
    pieces = [w.replace("</w>", "") for w in list(own.merges.vocab)[::7] if w.isascii()]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 6))) for _ in range(20_000)] + ["".join(rng.choice(list("abe'1.é "), 12)) for _ in range(5000)]
    texts += [w.replace("</w>", "") for w in own.merges.vocab]
    ids, begins = own.encode([t.encode() for t in texts])
    for k, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[begins[k]:begins[k + 1]].tolist() == found.ids, texts[k]


def test_memory_bounds_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "NODES", 5)
    own = bpe.Codec(open(PATH, encoding="utf-8").read())
    for _ in range(2):
        for text in TEXTS:
            ids, _begins = own.encode([(text or "").encode()])
            assert ids.tolist() == expected(library, text)[0]


def test_unknown_numbers_are_left_out(spark, library):
    ids = np.array([320, 1 << 31, 99_999, 49407], "<u4")
    got = bpe.decoded(spark.createDataFrame([(bytearray(ids.tobytes()),), (None,)], "ids binary"), PATH).collect()
    assert [r["decoded"] for r in got] == [library.decode(ids.tolist(), skip_special_tokens=False), ""]


def test_query_against_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids, text = expected(library, r["text"])
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want
