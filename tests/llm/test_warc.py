"""Archives written and read back, with version lines inside payloads."""

import hashlib

import pytest

from quire.llm import warc as W
from quire.llm.common import shared_path

EVIL = ("x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello"
        + "\r\n\r\nWARC/1.1\r\nab" + "WARC/1.1\r\n" * 3)
ROWS = [(i, f"http://x/{i}\n", f"p{i % 7} " * (i * 3 + 30) if i % 5 else EVIL + str(i)) for i in range(150)] + [
    (300, None, None), (301, "u", ""), (302, "u", "é" * 60), (303, "u", "é" * 60), (304, "u", "a" * 99), (305, "u", "a" * 99),
    (307, "u", "z" * 100), (306, "u", "z" * 100), (308, "u", "WARC/1.1\r\n"), (309, "u", EVIL), (310, "u", EVIL)]


def expected(rows):
    heads = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            heads[b] = min(heads.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = heads.get(b, i) != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", heads[b] if again else None))
    return sorted(out)


@pytest.mark.parametrize("compression, segment, split", [
    ("none", 1 << 26, "128m"), ("none", 4096, "7000b"), ("gzip", 4096, "128m")])
def test_round_trip(spark, monkeypatch, compression, segment, split):
    monkeypatch.setattr(W, "SEGMENT_BYTES", segment)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = shared_path(spark, "warc-test")
        W.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3), path,
                         compression=compression)
        got = W.pages_of(W.read_archives(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got)) == expected(ROWS)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "u", "q" * 200), (1, "u", "q" * 200), (2, "u", "q" * 200)]
    path = shared_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in W.pages_of(W.read_archives(spark, path)).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    path = shared_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.pages_of(W.read_archives(spark, path)).collect() == []


def test_one_id_with_several_texts(spark):
    rows = [(1, "u", "A" * 200), (1, "u", "B" * 300), (2, "u", "A" * 200), (3, "u", "B" * 300)]
    path = shared_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])
                 for r in W.pages_of(W.read_archives(spark, path)).collect())
    assert got == [(1, 200, "response", None), (1, 300, "response", None), (2, 200, "revisit", 1), (3, 300, "revisit", 1)]


def test_truncated_record_is_left_out(spark):
    path = shared_path(spark, "warc-test")
    text = W.records(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")).first()[0] + "\r\n"
    (spark.createDataFrame([(text + text[:-10],)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path))
    assert [r["offset"] for r in W.read_archives(spark, path).collect()] == [0]
