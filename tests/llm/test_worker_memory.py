"""What a Python worker holds: rows in small parts, and tables and sorts of bounded size."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quire.llm import common, decontaminate, packing, suffix_dedup


def test_slices_keep_every_row_in_order():
    texts = [None if i % 7 == 0 else f"é{i}" * (i % 90) for i in range(2000)]
    rows = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(range(2000))], ["t", "c0"])
    whole = pa.RecordBatch.from_arrays([pa.array(range(2000)), rows], ["doc", "row"])
    parts = list(common.slices(iter([whole.slice(0, 0), whole, whole.slice(5, 1)]), 10_000))
    assert len(parts) > 20 and all(p.num_rows for p in parts) and max(p.nbytes for p in parts) < 30_000
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(2000), 5]
    want = [(t or "").encode() for t in [*texts, texts[5]]]
    assert [t for p in parts for t in suffix_dedup._text_bytes(p.column(1))] == want


def test_a_row_larger_than_a_slice_comes_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5000, "b"])], ["t"])
    assert [p.column(0).to_pylist() for p in common.slices(iter([batch]), 100)] == [["a" * 5000], ["b"]]


def test_the_table_of_pieces_has_at_most_four_places_for_each():
    found = packing.encoder()
    found.forget()
    n = 140_000
    texts = [" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, n, 1000)]
    got = found.ids(texts[:3] + texts + texts[-3:])
    assert found.count >= n and len(found.place) <= 4 * found.count
    plain = [np.array(found.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (texts[0], texts[-1])]
    assert got[0] == got[3] == plain[0] and got[-1] == got[-4] == plain[1]
    found.forget()


def test_pieces_are_forgotten_before_there_are_too_many(monkeypatch):
    monkeypatch.setattr(packing, "MAX_PIECES", 500)
    found = packing.encoder()
    found.forget()
    for at in range(0, 3000, 300):
        text = " ".join(f"v{i}" for i in range(at, at + 300))
        assert found.ids([text]) == [np.array(found.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert found.count <= 500
    found.forget()


def test_hashes_of_words_are_bounded(monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 10)
    seen = decontaminate._WordHashes()
    words = [b"%d" % (i % 35) for i in range(100)]
    assert decontaminate.shingle_hashes(words, seen).tolist() == decontaminate.shingle_hashes(words, decontaminate._WordHashes()).tolist()
    assert len(seen) <= 10


def test_a_shard_is_sorted_in_memory_of_few_times_its_text():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    parts = list({" ".join(r.choice(words) for _ in range(12)).encode() for _ in range(4000)})
    size, ids = sum(map(len, parts)), np.arange(len(parts))
    tracemalloc.start()
    try:
        suffix_dedup.Shard(parts, ids, ids + 1, 50)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * size  # over 100 times as much before


def test_batches_larger_than_a_slice_are_worked_whole(spark):
    r = random.Random(2)
    shared = ["".join(r.choice("abcdefghijklmnop ") for _ in range(100)) for _ in range(900)]
    own = lambda: "%0512x" % r.getrandbits(2048)
    rows = [(i, own() + "<>"[i // 900] + shared[i % 900] + "()"[i // 900] + "".join(own() for _ in range(4))) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sum(len(t) for _, t in rows) > common.SLICE_BYTES
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"]) for x in suffix_dedup.repeated_passages(df).collect()}
    assert len(got) == 1800 and all(got[i] == (len(t), 0 if i < 900 else 100) for i, t in rows)
    pieces = packing.pieces(df).groupBy("doc_id").sum("length").collect()
    want = {i: len(packing.encoder().tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows[::100]}
    have = {x["doc_id"]: x["sum(length)"] for x in pieces}
    assert len(have) == 1800 and all(have[i] == n for i, n in want.items())
