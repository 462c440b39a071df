"""Importance resampling against plain Python, and odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import importance_resampling as I
from quire.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, target):
    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))

    rows = []
    for d, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    for k, r in enumerate(able[:25 * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, schema="doc_id long, text string"):
    df = spark.createDataFrame(docs, schema)
    out = I.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_query_over_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, sf_dir).collect()
    want = [(d, n, w, s, r) for d, _, n, w, s, r in plain(docs, target)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("group", [64, I.GROUP_BYTES])
def test_blocks_cut_no_feature(group, monkeypatch):
    """Long texts in blocks that carry one word over give the features of the whole."""
    monkeypatch.setattr(I, "GROUP_BYTES", group)
    texts = [" ".join(f"w{i * i % 97}é" for i in range(500)), None, "", "One two,THREE-two 2", "x" * 400, " ".join("ab" * 90)]
    head = I.Head([b"w1\xc3\xa9", b"two", b"a"], [b"a b", b"b a", b"two 2"], 10000)
    found = [[] for _ in texts]
    for rows, words, skip in I._groups([t.encode() if t is not None else None for t in texts]):
        buckets, counts = head.features(words, skip)
        for row, part in zip(rows, np.split(buckets, np.cumsum(counts)[:-1])):
            found[row] += part.tolist()
    assert [Counter(x) for x in found] == [Counter(features(t)[1]) for t in texts]


def test_head_never_changes_a_feature():
    words = [[b"a", b"b", b"a", b"b", b"zz"], [], [b"b"], [b"a", b"zz"]]
    heads = [I.Head([], [], 10000), I.Head([b"a", b"b"], [b"a b"], 10000), I.Head([b"zz", b"b", b"a"], [b"b a", b"a zz", b"q r"], 10000)]
    found = [h.features(words) for h in heads]
    for buckets, counts in found:
        assert counts.tolist() == [9, 0, 1, 3]
        assert buckets.tolist() == found[0][0].tolist()


def test_odd_input(spark):
    long_text = " ".join(f"word{i % 5000}" for i in range(300_000))
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, long_text), (5, "Tie " * 30), (5, "Tie " * 30), (None, "Ünï " * 25),
            (None, None), (6, "the cat sat " * 9), (7, "THE CAT SAT " * 9)] + [(i, f"filler {i} " * 12) for i in range(8, 30)]
    got = run(spark, docs, ["the cat sat", None, ""])
    assert got == plain(docs, ["the cat sat", None, ""])
    assert sum(r[5] is not None for r in got) == 25 * sum(r[1] >= 20 for r in got) // 100


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], ["a b"]) == []
    docs = [(i, f"some words here {i} " * 6, 1, "n") for i in range(9)]
    got = run(spark, docs, [], "doc_id long, text string, n int, buckets string")
    assert got == plain([d[:2] for d in docs], [])


def test_drawn_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(i, f"one two three {i} " * 6, "x") for i in range(40)], "doc_id long, text string, rank string")
    out = I.drawn_rows(df, spark.createDataFrame([("one two",)], "text string"))
    assert out.columns == df.columns and out.count() == 10


def test_drawing_leans_towards_the_target(spark):
    docs = [(i, ("apple pear plum " if i % 2 else "bolt screw nail ") * 10) for i in range(400)]
    out = I.resample(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame([("apple pear plum " * 50,)], "text string"))
    drawn = [r["doc_id"] % 2 for r in out.where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(drawn) > 80
