"""Ids and decoded texts equal to the library's, text by text."""

import hashlib
import random

import numpy as np
import pytest
from frames import SF, no_documents, odd_documents
from tokenizers import Tokenizer

from plumbline.llm import bpe
from plumbline.llm.queries import QUERIES
from plumbline.llm.tables import table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def same(df, found, library):
    want = sorted(((d, *expected(library, t)) for d, t in df.select("doc_id", "text").collect()), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_odd_documents(spark, library):
    docs = odd_documents(spark)
    same(docs, bpe.digests(bpe.decoded(bpe.encoded(docs))), library)
    same(docs, bpe.digests(bpe.encoded(docs, with_text=True)), library)


def test_empty_table(spark):
    assert bpe.digests(bpe.decoded(bpe.encoded(no_documents(spark)))).collect() == []


def test_query_on_the_whole_table(spark, library):
    same(table(spark, SF, "documents"), QUERIES["op12_bpe_words"](spark, SF), library)


def words_and_ids(text):
    coder = bpe.coder_of(bpe.default_tokenizer())
    return [i for w in coder.words(text) for i in coder.ids(w.encode("utf-8", "surrogateescape"))]


def test_every_short_character_in_context(library):
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f"1{c}{c}2 ", f"'{c}s.{c}"):
            assert words_and_ids(text) == library.encode(text, add_special_tokens=False).ids


def test_random_unicode_and_special_tokens(library):
    rng = random.Random(3)
    signs = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "'s", "'LL", "é", "́", "Å", "İ", "ΑΣ", "ς", " ", "\x1c", "\x85", "　", "日本", "🙂", "½", "٣", " ", "\n", "\x00", "﻿", "_", "É"]
    for _ in range(3_000):
        text = "".join(rng.choice(signs) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(12)))
        assert words_and_ids(text) == library.encode(text, add_special_tokens=False).ids


def test_blocks_and_ranges_in_any_number(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    docs = odd_documents(spark)
    same(docs, bpe.digests(bpe.decoded(bpe.encoded(docs))), library)


def test_each_distinct_word_is_encoded_once():
    coder = bpe.coder_of(bpe.default_tokenizer())
    block = bpe.Block(["a b a", None, "b  A <|endoftext|>"], coder, 4)
    sent = [w for _, words in block.requests() for w in words.split(b"\xfe")]
    assert sorted(sent) == [b"a", b"b", b"\xff<|endoftext|>"]
    assert [n.tolist() for n in block.numbers] == [[0, 1, 0], [], [1, 0, 2]]


def test_ids_without_pieces(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([49407, 70_000, 320], "<u4").tobytes())), (2, bytearray()), (3, None)], "doc_id long, ids binary")
    found = {r["doc_id"]: r["text"] for r in bpe.decoded(rows).collect()}
    library = Tokenizer.from_file(bpe.default_tokenizer())
    assert found == {1: library.decode([49407, 70_000, 320], skip_special_tokens=False), 2: "", 3: ""}


def test_other_kinds_of_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))
