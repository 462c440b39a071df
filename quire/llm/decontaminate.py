"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document when at least 0.8 of the item's distinct
five-word shingles are among the document's.  Texts are compared with A-Z
lower-cased and ASCII punctuation as space.

Items are partitioned by their number of shingles (powers of two).  In a
partition whose largest item has U shingles, an item's signature is its
``U - ceil(0.8 U) + 1`` smallest shingle hashes (bottom-k MinHash): a document
that holds 0.8 of the item misses at most ``U - ceil(0.8 U)`` of its shingles,
so at least one of the signature is in the document and no match is lost.
Partitions whose items need more shingles than a document has are skipped.
Candidates are verified by exact containment of the shingles themselves.

Items are the query set: they go to the tasks in blocks of bounded number and
bytes, each block against all documents, so that what is broadcast never grows
with the benchmark; documents are read in place, without a shuffle.

Cases: a null text has no shingles and matches nothing, as does a text without
words; a text with fewer than five words has one shingle, all of its words, and
so matches only a text of just those words; repeated items count once, an item
id with several texts is matched by each; repeated documents give a row each;
empty tables give an empty result.  Texts are read whole, in blocks of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import row_column, slices, word_blocks

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: bounds of one block of items: number, and bytes of text
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32_000_000
#: words whose hashes a task remembers
MAX_WORDS = 250_000

_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128)).lower().encode()
_TABLE = _ASCII + bytes(range(128, 256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)
_FILTER_BITS = 20


class _WordHashes(dict):
    """Hash of each word seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def shingle_hashes(words: list[bytes], seen: _WordHashes) -> np.ndarray:
    """A hash of every run of five words; of all words if there are fewer."""
    n = SHINGLE_WORDS
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return (h * _ODD[:len(h)]).sum(dtype=np.uint64, keepdims=True) * _ODD[len(h)] if len(h) else h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j:len(h) - n + 1 + j] * _ODD[j]
    return out ^ (out >> np.uint64(29))


def shingles(words: list[bytes]) -> list[bytes]:
    n = SHINGLE_WORDS
    return [b" ".join(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))] if words else []


class ItemIndex:
    """MinHash signatures of a block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str | None]], containment: float = CONTAINMENT):
        self.containment = containment
        seen = _WordHashes()
        self.items: list[tuple[int, set[bytes]]] = []
        hashed, by_size = [], {}
        for item, text in items:
            words = normal(text).split()
            if not words:
                continue
            hashes = np.unique(shingle_hashes(words, seen))
            by_size.setdefault(len(hashes).bit_length(), []).append(len(self.items))
            self.items.append((item, set(shingles(words))))
            hashed.append(hashes)
        #: (fewest shingles a document needs, signature hashes sorted, their items)
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in sorted(by_size):
            of = by_size[size]
            most = max(len(hashed[i]) for i in of)
            width = most - self.needed(most) + 1
            keys = np.concatenate([hashed[i][:width] for i in of])
            owner = np.concatenate([np.full(len(hashed[i][:width]), i) for i in of])
            order = np.argsort(keys, kind="stable")
            self.parts.append((min(self.needed(len(hashed[i])) for i in of), keys[order], owner[order]))
        self.hashes = hashed
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        for _, keys, _ in self.parts:
            self.maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True

    def needed(self, n: int) -> int:
        return ceil(self.containment * n - 1e-9)

    def candidates(self, blocks, seen: _WordHashes) -> set[int]:
        found, runs, total = set(), [], 0
        for words in blocks:
            h = shingle_hashes(words, seen)
            total += len(h)
            runs.append(h[self.maybe[h >> np.uint64(64 - _FILTER_BITS)]])
        for least, keys, owner in self.parts:
            if least > total:
                continue
            for h in runs:
                h = np.unique(h)
                lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    found.update(owner[a:b].tolist())
        return found

    def matches(self, text: str | None, seen: _WordHashes) -> list[tuple[int, int, int]]:
        """(item id, its shingles, those in the text) of every item contained."""
        data = normal(text)
        found = self.candidates(word_blocks(data, SHINGLE_WORDS - 1), seen)
        if not found:
            return []
        wanted = np.unique(np.concatenate([self.hashes[i] for i in found]))
        there: set[bytes] = set()
        for words in word_blocks(data, SHINGLE_WORDS - 1):
            h = shingle_hashes(words, seen)
            at = np.flatnonzero(np.isin(h, wanted))
            there.update(b" ".join(words[i:i + SHINGLE_WORDS]) for i in at.tolist())
        out = []
        for i in sorted(found):
            item, own = self.items[i]
            shared = len(own & there)
            if shared >= self.needed(len(own)):
                out.append((item, len(own), shared))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The distinct items in blocks of bounded size."""
    from pyspark import StorageLevel

    own = (items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
           .where("text is not null").distinct())
    total = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    n = max(ceil(total["n"] / BLOCK_ITEMS), ceil((total["b"] or 0) / BLOCK_BYTES), 1)
    if n == 1:
        yield [tuple(r) for r in own.collect()]
        return
    own = own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).persist(StorageLevel.DISK_ONLY)
    for k in range(n):
        yield [tuple(r) for r in own.where(F.col("block") == k).select("item", "text").collect()]
    own.unpersist()


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): every item found in a document,
    with its number of distinct shingles and how many the document has."""
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(doc_text).cast("string").alias("t"))
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = sc.broadcast(ItemIndex(block, containment))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, seen = shared.value, _WordHashes()
            for batch in slices(batches):
                found = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1))
                         for m in dict.fromkeys(index.matches(t.as_py(), seen))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)],
                                                     ["doc_id", "item_id", "n_item", "n_shared"])

        hits = rows.mapInArrow(run, schema)
        out = hits if out is None else out.union(hits)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
               containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item; a document whose id has one goes
    with all its rows.  Rows with a null id are judged by nothing and stay."""
    key = row_column(docs, "_leak")
    leaks = contained_items(docs, items, doc_id, doc_text, containment=containment)
    leaks = leaks.select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    return docs.join(leaks, docs[doc_id] == leaks[key], "left_anti")
