"""Containment search against brute force."""

import numpy as np

from quire.llm import decontaminate as D


def brute(docs, items):
    out = []
    for d, text in docs:
        have = set(D.shingles(D.normal(text).split()))
        for i, item in dict.fromkeys(items):
            own = set(D.shingles(D.normal(item).split()))
            if own and 10 * len(own & have) >= 8 * len(own):
                out.append((d, i, len(own), len(own & have)))
    return sorted(out, key=str)


def case():
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 40, n)]
    items = [(i, " ".join(word(int(rng.integers(1, 60))))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "!!"), (63, "just three words"), (3, items[3][1]), (64, items[4][1])]
    docs = []
    for d in range(200):
        text = word(int(rng.integers(0, 200)))
        item = items[int(rng.integers(0, 60))][1].split()
        for _ in range(int(rng.integers(0, 4))):  # spoilt by some words, near the limit
            item[int(rng.integers(len(item)))] = "zz"
        docs.append((d, " ".join(text[:50] + item + text[50:]).upper() + "."))
    docs += [(300, None), (301, ""), (302, "Just three, words!"), (303, "not just three words"), (None, items[0][1]), (5, docs[5][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    got = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                            spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(D, "BLOCK_ITEMS", 20)
    got = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_long_documents_are_read_in_blocks(monkeypatch):
    from quire.llm import common
    docs, items = case()
    index = D.ItemIndex([i for i in items if i[1]])
    whole = [sorted(index.matches(t, D._WordHashes())) for _, t in docs]
    monkeypatch.setattr(common.word_blocks, "__defaults__", (61,))
    assert [sorted(index.matches(t, D._WordHashes())) for _, t in docs] == whole


def test_keep_clean_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "h i j k l m", 2), (None, "a b c d e f g", 3)], "doc_id long, text string, _leak int")
    items = spark.createDataFrame([(1, "b c d e f")], "item_id long, text string")
    assert sorted(r["_leak"] for r in D.keep_clean(docs, items).collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(docs, none).collect() == [] and D.keep_clean(docs, none).count() == 3
    assert D.contained_items(docs.limit(0), items).collect() == []
