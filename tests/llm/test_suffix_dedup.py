"""Suffix arrays, common prefixes and removal against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import suffix_dedup as D


@pytest.mark.parametrize("letters", [2, 26])
def test_suffix_array_and_common_prefixes(letters):
    rng = np.random.default_rng(letters)
    parts = sorted({bytes(rng.integers(97, 97 + letters, rng.integers(1, 76)).astype(np.uint8)) for _ in range(40)})
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    text[begins + sizes] = 0
    order = D.suffix_array(text)
    plain = text.tolist()
    assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    prefix = D.common_prefixes(text, order, begins, begins + sizes, 50)
    for a, b in zip(order[1:].tolist(), order[:-1].tolist()):
        n = 0
        while n < 50 and max(a, b) + n < len(plain) and plain[a + n] == plain[b + n]:
            n += 1
        assert plain[a] == 0 or prefix[a] == n


def test_end_marks_that_differ():
    """With the places' ends given, suffixes are ordered as if each end mark were a symbol of its own."""
    rng = np.random.default_rng(8)
    base = bytes(rng.integers(97, 99, 70).astype(np.uint8))
    parts = [base[a:a + k] for a, k in zip(rng.integers(0, 20, 60), rng.integers(0, 70, 60))]
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8) + np.uint8(1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = begins + sizes
    text[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))
    order = D.suffix_array(text, left)
    plain = text.tolist()
    assert order.tolist() == sorted(range(len(plain)), key=lambda i: (plain[i:i + left[i]], i + left[i]) if left[i] else ([], i))
    prefix = D.common_prefixes(text, order, begins, ends - 20 + 1, 20)
    for a, b in zip(order[1:].tolist(), order[:-1].tolist()):
        if left[a] >= 20:
            assert (prefix[a] == 20) == (left[b] >= 20 and plain[a:a + 20] == plain[b:b + 20])


def test_shards_merge_by_binary_search():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, 76).astype(np.uint8)) for _ in range(10)] * 3
    ids = np.arange(30)
    one = D.Shard(parts, ids, ids, 50)
    several = [D.Shard(parts[a:a + 7], ids[a:a + 7], ids[a:a + 7], 50) for a in range(0, 30, 7)]
    D.merged([one])
    D.merged(several)
    want = {bytes(h): (a, b) for h, a, b in zip(one.heads, one.low, one.high)}
    for shard in several:
        for h, a, b in zip(shard.heads, shard.low, shard.high):
            assert want[bytes(h)] == (a, b)


def brute(rows, length=50):
    low = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - length + 1):
                low[t[k:k + length]] = min(low.get(t[k:k + length], i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        if i is not None:
            for k in range(len(t) - length + 1):
                if low[t[k:k + length]] < i:
                    gone[k:k + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def case():
    rng = np.random.default_rng(0)
    passages = [" ".join(rng.choice(["ab", "the", "é", "zzz", "x"], rng.integers(10, 60))) for _ in range(12)]
    rows = []
    for i in range(200):
        text = " ".join([str(rng.integers(0, 10**9)), *rng.choice(passages, rng.integers(0, 4)), str(rng.integers(0, 10**9))])
        rows.append((i if i % 17 else None, text if i % 13 else None))
    rows += [(5, passages[0]), (5, passages[0]), (5, passages[1] + passages[2]), (1000, "a" * 3000), (1001, "a" * 500),
             (1002, "ab" * 900), (1003, "b" + "ab" * 300), (1004, ""), (-3, passages[3])]
    return rows


def digests(df):
    return sorted((tuple(r) for r in D.repeated_passages(df).selectExpr(
        "doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()), key=str)


def test_equals_brute_force(spark):
    rows = case()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_long_texts_in_overlapping_parts(monkeypatch):
    rows = [t.encode() for _, t in case() if t]
    whole = {(r, int(s) + k) for _, _, row, start, n, _ in D.segments(rows) for r, s, c in zip(row, start, n) for k in range(c)}
    monkeypatch.setattr(D, "PART_BYTES", 64)
    parts = [(r, int(s) + k) for _, _, row, start, n, _ in D.segments(rows) for r, s, c in zip(row, start, n) for k in range(c)]
    assert set(parts) == whole and len(parts) == len(whole)


def test_busy_seed_is_not_left_to_one_bucket(spark, monkeypatch):
    """A short phrase in many contexts: its segments are split by window, and nothing is lost."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    phrase = "terms of use apply to all pages"
    rows = [(i, f"{word(60)}{phrase}{word(60)}" if i % 3 else f"{word(9)} {phrase} see the notice below {word(40)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    docs = df.select(F.col("doc_id").alias("doc"), F.struct(F.col("text").alias("t")).alias("row"))
    total = sum(len(t) for _, t in rows)
    monkeypatch.setattr(D, "BUSY_BYTES", 5000)
    busy = D.busy_seeds(docs, total)
    assert len(busy)
    wide = D._with_seeds(docs.withColumn("gone", F.lit(None).cast("array<string>")),
                         D.shared_seeds(docs.withColumn("gone", F.lit(None).cast("array<string>")), 16))
    most = lambda b: D._bucketed(wide, 16, b, D.LENGTH).groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    assert most(busy) * (2 * D.LENGTH - D.SEED) < 3 * D.BUSY_BYTES < most(busy[:0]) * (2 * D.LENGTH - D.SEED)
    assert digests(df) == brute([(i, t.encode()) for i, t in rows])


def test_query_equals_brute_force(spark, sf_dir):
    from quire.llm import queries
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op7_suffix_array_dedup"](spark, sf_dir).collect()), key=str)
    assert got == brute([(r[0], r[1].encode()) for r in docs])


def test_without_repeats_keeps_columns(spark):
    a, b = "one passage of more than fifty bytes, found in two documents ", "é own text"
    df = spark.createDataFrame([(1, a + b, 5, "m"), (2, b + a, 6, "m"), (3, a, 7, "m"), (4, None, 8, "m"), (5, "short", 9, "m")],
                               "doc_id long, text string, n_chars int, kept string")
    got = sorted(map(tuple, D.without_repeats(df, size_col="n_chars").collect()), key=lambda r: r[0])
    assert got[0] == (1, a + b, 5, "m") and got[1] == (2, b, len(b), "m")
    assert [r[0] for r in got] == [1, 2, 4, 5] and got[2] == (4, None, 8, "m")


def test_empty_table(spark):
    assert D.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_large_groups_of_copies(spark, monkeypatch, share):
    """Groups of copies told by broadcast, by join, or some by each."""
    monkeypatch.setattr(D, "HOT_SHARE", share)
    a, b, c = ("".join(chr(97 + (i * k) % 23) for i in range(90)) for k in (3, 5, 7))
    rows = [(i, a) for i in range(60)] + [(100 + i, b) for i in range(3)] + [(200, c), (100, c), (None, a), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digests(df) == brute([(i, t.encode()) for i, t in rows])


def dealt(spark, rows, buckets=16):
    """What the buckets of segments get: (bucket, n) rows."""
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(2).select(
        "doc", F.struct(F.col("text").alias("t")).alias("row"), F.lit(None).cast("array<string>").alias("gone"))
    wide = D._with_seeds(docs, D.shared_seeds(docs, buckets)).repartition(2).localCheckpoint()
    return D._bucketed(wide, buckets, np.array([], np.uint64), D.LENGTH).select("bucket", "n").collect()


def test_seeds_equal_by_chance_are_not_sorted(spark):
    """Few words, so most strings of 16 bytes come again, but no passage of 50 bytes; one pair of documents has one."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words, 300))) for i in range(150)]
    passage = "a passage of some sixty bytes that two of the documents share, "
    rows = [(i, passage + t if i in (3, 90) else t) for i, t in rows]
    texts = [t.encode() for _, t in rows]
    seen = {}
    for _, _, row, _, _, key in D.segments(texts):
        for r, k in zip(row.tolist(), key.tolist()):
            seen.setdefault(k, set()).add(r)
    total = sum(len(r) for r in seen.values())
    assert sum(len(r) for r in seen.values() if len(r) > 1) > 0.7 * total
    assert 0 < sum(r["n"] for r in dealt(spark, rows)) < 0.05 * total
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(df) == brute([(i, t.encode()) for i, t in rows])


def test_rows_dealt_do_not_grow_with_the_parts_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_BYTES", 500)
    rng = np.random.default_rng(6)
    passages = ["".join(rng.choice(list("abcdefghijkl "), 90)) for _ in range(60)]
    rows = [(i, "".join(rng.choice(passages, 6))) for i in range(120)]
    found = dealt(spark, rows, 4)
    assert len(found) <= 2 * 4 and {r["bucket"] for r in found} == {0, 1, 2, 3}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert digests(df) == brute([(i, t.encode()) for i, t in rows])


def test_contexts_decide_which_windows_of_a_segment_stay():
    """Every window is in the half that its seed's place says, and equal windows have equal contexts."""
    rng = np.random.default_rng(7)
    base = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    texts = [base, b"x" * 31 + base[100:290] + b"y" * 40]
    known = {}
    for buffer, at, row, start, n, _, seed in D._placed_segments(texts, 50):
        has_lead, lead_key, has_rest, rest_key, lead = D.contexts(buffer, at, n, seed, 50)
        assert ((lead > 0) == has_lead).all() and ((lead < n) == has_rest).all()
        for i in range(len(at)):
            for k in range(n[i]):
                key = int(lead_key[i] if k < lead[i] else rest_key[i])
                assert known.setdefault(buffer[at[i] + k:at[i] + k + 50], key) == key
    assert len(known) < sum(len(t) - 49 for t in texts)
