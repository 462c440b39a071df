"""Token counts and packing against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import packing as P
from quire.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    letters = "abrevlstmd'' '  \n\t1 2!?éñ 　中٣-ReLL "
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    out += ["a<|endoftext|>b <|endoftext|><|endoftext|>", "", "<|endoftext|>", " " * 3000, "-" * 999 + "=" * 300, "ab" * 4000,
            "I'll we've don't 'tis ''s ' re'", "\U0001f600\U0001f469‍\U0001f469 ok\x00", "ᲊ x Ɤ"]
    return out


def test_splits_like_the_pattern(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 8)
    splitter = T.counter().splitter
    pattern = regex.compile(public_tokenizers.PATTERN)
    some = [t for t in texts() if "ᲊ" not in t]
    for text, at in zip(some, splitter.piece_starts(some)):
        assert at.tolist() == [m.start() for m in pattern.finditer(text)]


def test_state_maps_compose(monkeypatch):
    """Any cut of a text into chunks gives the same pieces."""
    some = texts()[:400]
    splitter = T.counter().splitter
    want = [a.tolist() for a in splitter.piece_starts(some)]
    for size in (1, 3, 17):
        monkeypatch.setattr(T, "CHUNK", size)
        assert [a.tolist() for a in splitter.piece_starts(some)] == want


def test_counts_equal_the_library(library, monkeypatch):
    some = texts()
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert T.counter().count(some).tolist() == want
    monkeypatch.setattr(T, "PART", 50)  # long texts in parts
    monkeypatch.setattr(T, "MAX_STATES", 50)
    assert T.counter().count(some).tolist() == want


def test_token_counts_rows(spark):
    rows = [(1, None), (2, ""), (3, "hello world" * 500), (3, "é"), (None, "x")]
    got = T.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 0, False), (2, 0, False), (3, 5500, False), (3, 2, False), (None, 1, False)]
    assert got[0]["n_tokens"] == 0 and T.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_covers_every_id_once(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[::3])] + [(5000, None), (5001, "long " * 5000), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("key", F.monotonically_increasing_id())
    df = df.select("key", "text", "doc_id").checkpoint()
    texts_of = {r["key"]: r["text"] for r in df.collect()}
    out = P.pieces(df, "key").collect()
    place, total = {}, 0
    for r in sorted(out, key=lambda r: (r["key"], r["start"])):
        at = place.get(r["key"], 0)
        ids = library.encode(texts_of[r["key"]] or "", add_special_tokens=False).ids + [0]
        assert r["start"] == at and r["doc_tokens"] == len(ids)
        part = np.array(ids[at:at + r["length"]], "<u4").tobytes()
        assert part == bytes(r["ids"])
        place[r["key"]] = at + r["length"]
        total += r["length"]
    at = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(at) == list(range(len(at))) and len(at) == -(-total // 1024)
    assert all(n == 1024 for s, n in at.items() if s != len(at) - 1)


def test_sequences_are_padded_except_at_powers_of_two(spark):
    for tokens, size in ((3, 1024), (4, 4)):
        df = spark.createDataFrame([(1, 0, tokens, bytes(4 * tokens), 0, 0)],
                                   "doc_id long, start long, length long, ids binary, sequence_id long, offset long")
        assert len(P.sequences(df).first()["ids"]) == 4 * size
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pieces(empty).collect() == []
