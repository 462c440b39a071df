"""Fingerprints, trie self-join and components against brute force."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quire.llm import simhash_dedup as S


def plain_simhash(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two THREE", "a b c d", "É é Ä a b c d e a b c d", "x " * 500])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert S.simhash(text) == plain_simhash(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    from quire.llm import common
    text = " ".join(str(i * 7919 % 1000) for i in range(3000))
    monkeypatch.setattr(common.word_blocks, "__defaults__", (97,))
    assert S.simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("key_bits", [0, 3, 21])
@pytest.mark.parametrize("at_once", [5, 1 << 16])
def test_trie_links_equal_all_pairs(key_bits, at_once, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(key_bits)
    codes = [int(x) for x in rng.integers(0, 2**63, 10, dtype=np.uint64)]
    for _ in range(150):
        x = codes[rng.integers(len(codes))]
        for k in rng.integers(0, 64, rng.integers(1, 7)):
            x ^= 1 << int(k)
        codes.append(x)
    codes = np.unique(np.array(codes, dtype=np.uint64))
    n = len(codes)
    near = [(i, j) for i in range(n) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 4
            and (not key_bits or int(codes[i]) >> (64 - key_bits) == int(codes[j]) >> (64 - key_bits))]
    expected = components(near, range(n))
    assert S.trie_links(codes, key_bits, 4).tolist() == [expected[i] for i in range(n)]


def test_any_two_linked_fingerprints_share_two_blocks():
    assert sum(w for _, w in S.bit_blocks(4)) == 64 and len(S.bit_blocks(4)) == 6
    assert len(S._dealt(4)) == 15


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 60)) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 3 else base[i % 12].replace("a", "b", int(rng.integers(1, 3)))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, " "), (103, "one two"), (104, "one two"), (7, rows[7][1]), (None, "lonely words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {}
    for i, t in rows:
        if i is not None:
            fp[i] = plain_simhash(t)
    ids = sorted(fp)
    expected = components([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == expected[r["doc_id"]]
        else:
            assert r["component_id"] is None
    kept = sorted((r["doc_id"] for r in S.keep_one(df).collect()), key=lambda x: (x is None, x))
    assert kept == sorted({c for c in expected.values()}) + [None]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert S.near_duplicates(empty).collect() == []
    assert S.keep_one(empty).columns == empty.columns
    one = spark.createDataFrame([(1, "a b c", "mine", 2), (2, "a b c", "mine", 3)], "doc_id long, text string, fingerprint string, _kept_id long")
    assert [tuple(r) for r in S.keep_one(one).collect()] == [(1, "a b c", "mine", 2)]


def test_one_id_with_several_texts_loses_none(spark):
    """Each text is judged by itself: what no smaller row has stays."""
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    schema = "doc_id long, text string"
    got = lambda rows: sorted(map(tuple, S.keep_one(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got([(1, a), (7, a), (7, b), (9, b)]) == [(1, a), (7, b)]
    assert got([(5, a), (5, b)]) == sorted([(5, a), (5, b)], key=str)
    assert got([(5, a), (5, a), (6, a)]) == [(5, a)]
    near = [(3, a + " eta " + w) for w in ("theta", "theta")] + [(3, a), (None, a), (None, b)]
    out = got(near)
    assert out.count((None, a)) == 1 and (None, b) in out and (3, a) in out
    comp = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(spark.createDataFrame([(1, a), (7, a), (7, b), (9, b)], schema)).collect()}
    assert comp == {(1, 1), (7, 1), (7, 7), (9, 7)}


def test_texts_of_one_id_in_one_component_leave_one(spark):
    rng = np.random.default_rng(8)
    words = [str(w) for w in rng.choice(list("abcdefghijklmnop"), 400)]
    twin = [*words[:-1], "zz"]
    rows = [(4, " ".join(words)), (4, " ".join(twin)), (8, " ".join(words))]
    assert (plain_simhash(rows[0][1]) ^ plain_simhash(rows[1][1])).bit_count() <= 4
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 4


def test_large_group_of_copies_is_one_leaf(spark):
    rows = [(i, "the same five words again and again") for i in range(3000)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}
