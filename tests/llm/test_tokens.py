"""Identifiers against the public library, offsets and round trips."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tideline.llm import tokens  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    ids, at = tokens.encode_texts(texts, tokens.VOCABULARY)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


SPECIAL = ["", " ", "  ", "\n", "it's we'll they've I'd 'tis ''s '''s 'll'd", " 's  's\n's", "<|endoftext|> </s> <pad>", "a\0b\0", "½²Ⅷ 12ab", "naïve café ﬁﬂſ", "新聞 第三面", "صحيفة الصباح", "zero​width ﻿", "\x1c\x1d\x85\xa0x", "😀👩‍👩‍👧", "ᲊ𖵰", "é", "a" * 3000, " " * 500 + "x", "''" * 200, "'l 'v 'r 'e"]


def test_special_texts(reference):
    assert ours(SPECIAL) == reference(SPECIAL)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(reference, seed):
    rng = random.Random(seed)
    alphabet = "ab1 '  \n\tsltvremd é新²!.-_’​\x85😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert ours(texts) == reference(texts)


def test_scan_is_the_automaton():
    generators, together, table = tokens.monoid()
    rng = np.random.default_rng(0)
    sym = rng.integers(0, 8, 5000).astype(np.uint8)
    state, expected = tokens.FRESH, []
    for s in sym:
        state = tokens.step(int(s), state)
        expected.append(state)
    for n in (0, 1, 63, 64, 65, 5000):
        assert table[:, tokens.FRESH][tokens.prefix(generators[sym[:n]], together)].tolist() == expected[:n]


def test_long_piece_and_portions(reference):
    texts = ["x" * 300_000, "ab" * 100_000, "word " * 300_000]
    assert ours(texts) == reference(texts)


def test_cache_is_bounded(monkeypatch):
    enc = tokens.Encoder(tokens.VOCABULARY)
    monkeypatch.setattr(tokens.Encoder, "LIMIT", 10)
    for i in range(5):
        enc.encode([f"w{i}a w{i}b w{i}c w{i}d w{i}e"])
    assert len(enc.cached) <= 20


def test_encoded(spark):
    data = [(1, "Hello world's 新聞"), (2, None), (3, ""), (3, ""), (None, "x y")]
    df = spark.createDataFrame([(*r, "z") for r in data], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids, r.offsets) for r in tokens.encoded(df).collect()), key=str)
    assert len(got) == 5 and [x[1] for x in got if x[0] in (2, 3)] == [[], [], []]
    first = next(x for x in got if x[0] == 1)
    raw, enc = "Hello world's 新聞".encode(), tokens.encoder(tokens.VOCABULARY)
    for i, start in zip(first[1], first[2]):
        assert raw[start:].startswith(enc.tokens[i])
    back = {r.doc_id: r.text for r in tokens.decoded(tokens.encoded(df)).collect()}
    assert back[1] == "Hello world's 新聞" and back[2] == "" and back[None] == "x y"
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}[1] == len(first[1])
    assert tokens.encoded(df.limit(0)).count() == 0


def test_the_vocabulary_goes_along(spark, tmp_path, monkeypatch):
    """Workers that lack the file read the copy that was sent with the plan."""
    import os
    import shutil

    from tideline.llm import tokens

    copy = str(tmp_path / "vocabulary_of_this_test.tiktoken")
    shutil.copy(tokens.VOCABULARY, copy)
    df = spark.createDataFrame([(1, "The mill burned.")], "doc_id long, text string")
    there = [r.ids for r in tokens.encoded(df, copy, offsets=False).collect()]
    tokens.ship_with(spark, copy)
    os.remove(copy)
    again = spark.createDataFrame([(1, "The mill burned.")], "doc_id long, text string").repartition(2)
    run = tokens._mapped(again, copy, "doc_id", "text", "n long", lambda keys, texts: __import__("pyarrow").RecordBatch.from_arrays([keys, __import__("pyarrow").array([len(tokens.Encoder(tokens.located(copy)).encode(texts)[0])] * len(texts))], ["doc_id", "n"]))
    assert [r.n for r in run.collect()] == [len(there[0])]
