"""Repeated passages by suffix arrays, over the bytes of all documents.

A byte is removed if it is covered by a string of ``length`` bytes that also
starts in a document with a smaller id.  Strings are judged on the input, they
may overlap, and none crosses documents.

A text equal to one of a smaller id is removed whole, and of such a group only
the smallest id takes part in what follows: all its strings start there.

Texts are dealt to shards by content, so that equal strings meet.  Every window
of ``length`` bytes has a seed, the 16-byte string in it with the smallest hash
(a function of the window alone); a run of windows with one seed is a segment of
at most 84 bytes.  A window of 50 bytes holds 17 bytes before its seed or 18 after
it, so a window that repeats shares its seed with one of these contexts, of 33 or
34 bytes, which chance alone seldom repeats however large the corpus.  A first pass
finds the contexts that occur in two documents or more: tasks merge equal ones,
report each once to the bucket of its hash, and learn which are shared.  Windows
whose context is not shared cannot repeat and go no further; the others of a
segment stay.  Equal segments are merged in the task (a group of copies, or
a passage that a third of all documents share, is one segment per task), dealt
to buckets by seed with the places where they stand, and sorted there in shards of
bounded size:

* a suffix array per shard by Larsson-Sadakane refinement (the ranks of the
  first h symbols give those of 2h; only groups that are still equal are sorted
  again) in numpy,
* Kasai's common prefixes, all segments of the shard side by side, which cut the
  sorted windows into classes of equal strings,
* the sorted classes of a bucket's shards are merged by binary search.

A seed whose different segments would overfill a bucket (a phrase shorter than
``length`` in very many contexts) is known from an even sample of the text.  Its
segments are not sorted: their windows are dealt by their own hash, and Spark
sums up the smallest and largest id of each, first in the tasks.

Each class carries its smallest document id; the bucket marks the windows of every
occurrence with a larger id, and a document's marks come together for the removal.
Text crosses the network once.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; rows
with a null id lose nothing and remove nothing from others; rows that repeat an
id are one document and do not remove from each other, each is cut on its own
text; an empty table gives an empty result.  Very long texts are worked through
in parts that overlap, so memory is bounded by ``PART_BYTES``.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialise, release, row_column, slices, text_bytes

LENGTH = 50
SEED = 16
#: text of one vectorised step, text per bucket of seeds, and of segments per bucket and shard
PART_BYTES = 1 << 21
BLOCK = 1 << 16
BUCKET_BYTES = 1 << 24
SEGMENT_BUCKET_BYTES = 1 << 22
SHARD_BYTES = 1 << 22
#: text sampled for busy seeds (at least this much and this share), its piece in
#: characters, and the segments of a seed, in bytes, from which they are split
SAMPLE_BYTES, SAMPLE_SHARE, SAMPLE_PIECE = 1 << 22, 1 / 64, 1 << 14
BUSY_BYTES = 1 << 21
#: what a task gathers before it deals it to the buckets: contexts, and bytes of segments.
#: Rows dealt are gatherings times buckets, so small gatherings cost more the larger the table is
HELD_KEYS, HELD_BYTES = 1 << 19, 1 << 23
#: groups of copies above this part of all copies are told by broadcast, so at most so many are
HOT_SHARE = 1000
_PLACE = np.uint64((1 << 20) - 1)
_BASE, _MIX = 0x100000001B3, np.uint64(0xFF51AFD7ED558CCD)


def _window_seeds(data: np.ndarray, length: int) -> np.ndarray:
    """Per window of ``length`` bytes: the smallest seed hash (top 44 bits) and
    its place (low 20 bits, wrapping).  Worked through in blocks that stay in a
    processor's cache."""
    out = np.empty(max(len(data) - length + 1, 0), np.uint64)
    for at in range(0, len(out), BLOCK):
        out[at:at + BLOCK] = _block_seeds(data[at:at + BLOCK + length - 1], at, length)
    return out


def _block_seeds(data: np.ndarray, at: int, length: int) -> np.ndarray:
    """``_window_seeds`` of one block, which begins at ``at``."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    part, wide, h, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while wide <= SEED:  # hashes of strings of 1, 2, 4, ... bytes; those in SEED's sum are put together
        if SEED & wide:
            if h is None:
                h = part if 2 * wide > SEED else part.copy()
            else:
                n = min(len(part), len(h) - wide)
                h = part[:n] * power(done) + h[wide:wide + n]
            done += wide
        if 2 * wide > SEED:
            break
        part = part[:-wide] * power(wide) + part[wide:]
        wide *= 2
    h = h[:len(data) - SEED + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    h &= ~_PLACE
    h |= np.arange(at, at + len(h), dtype=np.uint64) & _PLACE
    wide, span = length - SEED + 1, 1
    while 2 * span <= wide:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:len(h) - (wide - span)], h[wide - span:]) if wide > span else h


def segments(texts: list[bytes], length: int = LENGTH):
    """Runs of windows with one seed, for many texts: yields (buffer, place in
    it, row, place in the text, number of windows, seed hash)."""
    for *found, _ in _placed_segments(texts, length):
        yield tuple(found)


def _placed_segments(texts: list[bytes], length: int):
    """``segments`` with the place of each seed in the buffer."""
    group, size = [], 0

    def work():
        buffer = b"".join(data for _, _, data in group)
        sizes = np.array([len(data) for _, _, data in group])
        begins = np.cumsum(sizes) - sizes
        count = np.maximum(sizes - length + 1, 0)
        some = count > 0
        if not some.any():
            return None
        best = _window_seeds(np.frombuffer(buffer, np.uint8), length)
        new = np.empty(len(best), bool)  # where a run, or what lies between two texts, begins
        np.not_equal(best[1:], best[:-1], out=new[1:])
        new[0] = True
        new[begins[some]] = True
        after = (begins + count)[some]
        new[after[after < len(best)]] = True
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(best)))
        own = np.searchsorted(begins, first, "right") - 1
        inside = first - begins[own] < count[own]
        first, n, own = first[inside], n[inside], own[inside]
        rows = np.array([r for r, _, _ in group])[own]
        start = first - begins[own] + np.array([o for _, o, _ in group])[own]
        seed = first + (((best[first] & _PLACE).astype(np.int64) - first) & int(_PLACE))
        return buffer, first, rows, start, n, best[first] >> np.uint64(20), seed

    for row, text in enumerate(texts):
        for off in range(0, max(len(text) - length + 1, 0), PART_BYTES):
            data = text[off:off + PART_BYTES + length - 1] if len(text) > PART_BYTES else text
            group.append((row, off, data))
            size += len(data)
            if size >= PART_BYTES:
                found = work()
                if found:
                    yield found
                group, size = [], 0
    found = work() if group else None
    if found:
        yield found


def _hashes(buffer: bytes, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """64-bit hashes of the strings of ``size`` bytes (8 at least) at the given places."""
    words = np.ndarray((max(len(buffer) - 7, 0),), "<u8", buffer, 0, (1,))  # the eight bytes from every place on
    out = np.full(len(at), salt, np.uint64)
    for step in [*range(0, size - 8, 8), size - 8]:
        out ^= out >> np.uint64(32)
        out *= _MIX
        out += words[at + step]
    for _ in range(2):
        out ^= out >> np.uint64(29)
        out *= _MIX
    return out ^ (out >> np.uint64(32))


def contexts(buffer: bytes, at: np.ndarray, n: np.ndarray, seed: np.ndarray, length: int):
    """Of segments: (has windows with the longer half before their seed, hash of that
    half with the seed, the same two for the half after it, number of the former windows)."""
    before = (length - SEED + 1) // 2
    after = length - SEED - before + 1
    lead = np.clip(seed - before - at + 1, 0, n)  # windows that begin ``before`` bytes or more before the seed
    has_lead, has_rest = lead > 0, lead < n
    keys = []
    for has, place, size, salt in ((has_lead, seed - before, before + SEED, 1), (has_rest, seed, SEED + after, 2)):
        key = np.zeros(len(at), np.uint64)
        key[has] = _hashes(buffer, place[has], size, salt)
        keys.append(key)
    return has_lead, keys[0], has_rest, keys[1], lead


def _tag(key: np.ndarray) -> np.ndarray:
    """31 bits of a context's hash, others than those that choose its bucket."""
    return (key >> np.uint64(33)).astype(np.uint32)


def _key_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _blobs(kind: int, bucket: np.ndarray, keys: np.ndarray, docs: np.ndarray):
    """(bucket, kind, keys, docs) rows, keys and documents packed per bucket."""
    order = np.lexsort((docs, bucket))
    bucket, keys, docs = bucket[order], keys[order], docs[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.array([], int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), kind, keys[a:b].tobytes(), docs[a:b].tobytes()


def _text_bytes(rows: pa.StructArray) -> list[bytes]:
    """The texts (first field) of packed rows."""
    return [t or b"" for t in rows.flatten()[0].cast(pa.binary()).to_pylist()]


def shared_seeds(rows: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(doc, keys): the tags of a document's seeds with their contexts that occur in
    another one too; ``rows`` has doc, row and gone, and copies take no part.  A tag
    may be equal by chance (in a bucket of 2 million, one in a thousand), which the
    sorting finds out."""

    def dealt(keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        low = np.minimum.reduceat(doc, first)
        several = low != np.maximum.reduceat(doc, first)
        here = np.repeat(several, np.diff(np.append(first, len(key))))
        probe = (_tag(key[first]) << np.uint32(1)) | several
        out = [*_blobs(0, _key_bucket(key[first], buckets), probe, low),
               *_blobs(1, doc[here] % buckets, _tag(key[here]), doc[here])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "keys", "docs"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of, held = [], [], 0
        for batch in slices(batches):
            known = batch.column(0).is_valid().to_pylist()
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            texts = [b"" if not ok or _is_copy(t, g) else t
                     for ok, t, g in zip(known, _text_bytes(batch.column(1)), batch.column(2).to_pylist())]
            for buffer, at, row, _, n, _, seed in _placed_segments(texts, length):
                has_lead, lead_key, has_rest, rest_key, _ = contexts(buffer, at, n, seed, length)
                doc = docs[row]
                keys += [lead_key[has_lead], rest_key[has_rest]]
                of += [doc[has_lead], doc[has_rest]]
                held += len(keys[-1]) + len(keys[-2])
                if held >= HELD_KEYS:
                    yield dealt(keys, of)
                    keys, of, held = [], [], 0
        if held:
            yield dealt(keys, of)

    def settle(table: pa.Table) -> pa.Table:
        release()  # of the buckets before
        kinds = np.array(table["kind"].to_pylist())
        keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        docs = [np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()]
        some = lambda parts, k, t: np.concatenate([p for p, of in zip(parts, kinds) if of == k] or [np.array([], t)])
        key, doc = some(keys, 0, np.uint32), some(docs, 0, np.int64)
        several, key = (key & np.uint32(1)).astype(bool), key >> np.uint32(1)
        order = np.argsort(key)
        key, doc, several = key[order], doc[order], several[order]
        if len(key):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            in_two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            shared = np.repeat(in_two | np.logical_or.reduceat(several, first), np.diff(np.append(first, len(key))))
        else:
            shared = np.zeros(0, bool)
        key = np.concatenate((key[shared], some(keys, 1, np.uint32)))
        doc = np.concatenate((doc[shared], some(docs, 1, np.int64)))
        order = np.argsort(doc)
        key, doc = key[order], doc[order]
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.array([], int)
        ends = [*cuts[1:].tolist(), len(doc)]
        return pa.table({"doc": pa.array(doc[cuts], pa.int64()), "keys": pa.array(
            [key[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary())})

    # (no filter here: the rows come from the same shuffle as in the later steps)
    reports = rows.mapInArrow(report, "bucket long, kind int, keys binary, docs binary")
    return reports.groupBy("bucket").applyInArrow(settle, "doc long, keys binary")


def busy_seeds(docs: DataFrame, total_bytes: int, length: int = LENGTH) -> np.ndarray:
    """The seeds, sorted, whose different segments are estimated to make up
    ``BUSY_BYTES`` or more, from pieces of text drawn evenly by hash."""
    share = min(max(SAMPLE_SHARE, SAMPLE_BYTES / max(total_bytes, 1)), 1.0)
    drawn = lambda c: F.pmod(F.xxhash64("doc", c), F.lit(1 << 20)) < ceil(share * (1 << 20))
    places = F.filter(F.sequence(F.lit(0), F.floor(F.length("t") / SAMPLE_PIECE).cast("int")), drawn)
    pieces = docs.select("doc", F.col("row.t").alias("t")).where("doc is not null and t is not null").select(F.explode(
        F.transform(places, lambda c: F.substring(F.col("t"), c * SAMPLE_PIECE + 1, F.lit(SAMPLE_PIECE + length - 1)))).alias("t"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            for buffer, at, _, _, n, key in segments(texts, length):
                names, _ = _names(_cut_out(buffer, at, n, length))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(names)], ["key", "s"])

    found = (pieces.mapInArrow(seen, "key long, s long").distinct().groupBy("key").count()
             .where(F.col("count") >= max(ceil(BUSY_BYTES * share / (2 * length - SEED)), 2)).select("key").collect())
    return np.array(sorted(r["key"] for r in found), np.uint64)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight symbols from every place on as one number of the same order."""
    padded = np.concatenate((text.astype(np.uint8), np.zeros(7, np.uint8)))
    found = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    return found.byteswap(inplace=True) if sys.byteorder == "little" else found


def suffix_array(text: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of symbols below 256, by Larsson-Sadakane refinement from
    the order of the first eight.  With ``left``, the symbols before the end mark
    (0) of each place's segment, end marks all differ, the earlier being smaller:
    nothing is compared beyond them."""
    n = len(text)
    kind = np.int32 if n < 1 << 30 else np.int64  # of places and ranks
    key = _words(text)
    if left is not None:
        ended = np.flatnonzero(left < 7)
        key[ended] &= ~((np.uint64(1) << (8 * (7 - left[ended])).astype(np.uint64)) - np.uint64(1))
    order = np.argsort(key).astype(kind)
    sorted_ = key[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.empty(n + 1, kind)
    rank[n] = -1
    rank[order] = np.repeat(first, size)  # a group's rank: where it begins
    del key, sorted_, new, first
    h = 8
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    if left is not None:  # equal up to an end mark: its place decides
        ended = left[order[open_]] < h
        slots = open_[ended]
        places = order[slots]
        order[slots] = places[np.argsort(rank[places].astype(np.int64) * (n + 2) + places)]
        rank[order[slots]] = slots
        open_ = open_[~ended]
    while len(open_):
        places = order[open_]
        group = rank[places]
        after = rank[np.minimum(places + h, n)]
        within = np.argsort(group.astype(np.int64) * (n + 2) + after + 1)
        places, group, after = places[within], group[within], after[within]
        order[open_] = places
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(open_)))
        rank[places] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix of every suffix that starts between a segment's
    begin and end with its neighbour before it in the suffix array, up to
    ``most``; by place in the text.  A step works on one place of every segment:
    the prefix is at least the one of the place before less one, and is extended
    from there, eight symbols at a time."""
    n = len(text)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    words = _words(np.concatenate((text, np.zeros(most + 8, text.dtype))))
    held = np.zeros(len(begins), np.int64)
    steps = [np.uint64(1 << (8 * k)) for k in range(8)]
    for t in range(int((ends - begins).max(initial=0))):
        live = np.flatnonzero(begins + t < ends)
        at = begins[live] + t
        near = before[at]
        size = np.maximum(held[live] - 1, 0)
        size[near < 0] = 0
        grow = np.flatnonzero((near >= 0) & (size < most))
        while len(grow):
            differ = words[at[grow] + size[grow]] ^ words[near[grow] + size[grow]]
            same = np.zeros(len(grow), np.int64)
            for step in steps:
                same += differ < step
            size[grow] += same
            grow = grow[(same == 8) & (size[grow] < most)]
        np.minimum(size, np.minimum(most, n - np.maximum(at, near)), out=size)
        out[at] = size
        held[live] = size
    return out


class Shard:
    """Sorted classes of equal windows in one shard of segments."""

    def __init__(self, parts: list[bytes], low: np.ndarray, high: np.ndarray, length: int):
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255
        begins = np.cumsum(sizes + 1) - sizes - 1
        ends = begins + sizes
        text[ends] = 0
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
        left = ends.astype(np.int32)[owner] - np.arange(len(text), dtype=np.int32)
        order = suffix_array(text, left)
        prefix = common_prefixes(text, order, begins, ends - length + 1, length)
        window = left >= length
        order = order[window[order]]
        new = prefix[order] < length
        new[:1] = True
        first = np.flatnonzero(new)
        self.kind = (np.cumsum(new) - 1).astype(np.int32)  # class of each window, in sorted order
        self.owner = owner[order]
        self.place = (order - begins[self.owner]).astype(np.int8)
        self.low = np.minimum.reduceat(low[self.owner], first) if len(first) else low[:0]
        self.high = np.maximum.reduceat(high[self.owner], first) if len(first) else high[:0]
        self._text, self._first, self._length = text, order[first], length

    @cached_property
    def heads(self) -> np.ndarray:
        """The classes' strings as rows of big-endian words, which compare as the bytes do."""
        raw = np.lib.stride_tricks.sliding_window_view(self._text - np.uint8(1), self._length)[self._first]
        words = np.zeros((len(raw), -(-self._length // 8) * 8), np.uint8)
        words[:, :self._length] = raw
        return words.view(">u8").astype(np.uint64)


def _find(heads: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of ``other`` stands in the sorted rows of ``heads``, and
    whether it is there: a binary search over rows of words."""
    lo, hi = np.zeros(len(other), np.int64), np.full(len(other), len(heads))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        a, b = heads[mid], other[open_]
        differ = a != b
        col = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        less = differ[rows, col] & (a[rows, col] < b[rows, col])
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    there = lo < len(heads)
    there[there] = (heads[lo[there]] == other[there]).all(axis=1)
    return lo, there


def merged(shards: list[Shard]) -> None:
    """Smallest and largest ids of equal classes over all shards: each shard's
    classes are looked up in those gathered so far."""
    if len(shards) == 1:
        return
    heads, low, high = shards[0].heads, shards[0].low, shards[0].high
    for shard in shards[1:]:
        at, there = _find(heads, shard.heads)
        np.minimum.at(low, at[there], shard.low[there])
        np.maximum.at(high, at[there], shard.high[there])
        fresh = ~there
        heads = np.insert(heads, at[fresh], shard.heads[fresh], axis=0)
        low, high = np.insert(low, at[fresh], shard.low[fresh]), np.insert(high, at[fresh], shard.high[fresh])
    for shard in shards:
        at, _ = _find(heads, shard.heads)
        shard.low, shard.high = low[at], high[at]


def _packed(parts: list[bytes]) -> bytes:
    """Segments, all shorter than 256 bytes, as one compressed string."""
    import zstandard

    return zstandard.compress(bytes(map(len, parts)) + b"".join(parts), 3)


def _unpacked(data: bytes, n: int) -> list[bytes]:
    import zstandard

    data = zstandard.decompress(data)
    ends = np.cumsum(np.frombuffer(data[:n], np.uint8).astype(np.int64)) + n
    return [data[a:b] for a, b in zip([n, *ends[:-1].tolist()], ends.tolist())]


def _window_marks(table: pa.Table, length: int) -> pa.Table:
    """(doc, place, mask) for the occurrences of one bucket's segments: the windows
    whose string is in a document with a smaller id."""
    release()  # of the buckets before
    texts = [x for data, n in zip(table["segments"].to_pylist(), table["n"].to_pylist()) for x in _unpacked(data, n)]
    s1, s2 = _names(texts)
    count = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    docs, places = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("docs", "places"))
    order = np.lexsort((s2, s1))
    new = np.concatenate(([True], (np.diff(s1[order]) != 0) | (np.diff(s2[order]) != 0)))
    texts = [texts[i] for i in order[new].tolist()]
    kind = np.empty(len(order), np.int64)  # equal segments of several tasks are one
    kind[order] = np.cumsum(new) - 1
    kind = np.repeat(kind, count)
    order = np.argsort(kind, kind="stable")
    kind, docs, places = kind[order], docs[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    low, high = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    shards = []
    cuts = [0]
    size = 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= SHARD_BYTES:
            cuts.append(k + 1)
            size = 0
    if cuts[-1] < len(texts):
        cuts.append(len(texts))
    for a, b in zip(cuts[:-1], cuts[1:]):
        shards.append(Shard(texts[a:b], low[a:b], high[a:b], length))
    merged(shards)
    owners, smallest, masks = [], [], []  # per segment and smallest id, the windows
    for at, shard in zip(cuts, shards):
        lows, highs = shard.low[shard.kind], shard.high[shard.kind]
        hit = lows < highs
        owner, place, lows = shard.owner[hit] + at, shard.place[hit], lows[hit]
        sort = np.lexsort((lows, owner))
        owner, place, lows = owner[sort], place[sort], lows[sort]
        if len(owner):
            begin = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (lows[1:] != lows[:-1]))))
            owners.append(owner[begin])
            smallest.append(lows[begin])
            masks.append(np.bitwise_or.reduceat(np.int64(1) << place.astype(np.int64), begin))
    mark = np.zeros(len(docs), np.int64)
    if owners:
        owner, lows, mask = map(np.concatenate, (owners, smallest, masks))
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        at, end = begin[:-1][kind], begin[1:][kind]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            mark[live] |= np.where(docs[live] > lows[at], mask[at], 0)
            at += 1
            more = at < end
            live, at, end = live[more], at[more], end[more]
    hit = mark != 0
    return pa.table({"doc": pa.array(docs[hit]), "place": pa.array(places[hit]), "mask": pa.array(mark[hit])})


def _text_key(data: bytes) -> int:
    """31 bits that tell the texts of one id apart, above 32 bits for a place."""
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(data) >> 33) << 32


def copies(docs: DataFrame, length: int) -> DataFrame:
    """(cdoc, gone): per document the MD5 of its texts that a document with a smaller
    id has too, word for word."""
    texts = docs.where(F.octet_length("row.t") >= length).select("doc", F.md5(F.col("row.t").cast("binary")).alias("h"))
    first = materialise(texts.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
                        .where("first < last"), "copied")
    # at most HOT_SHARE groups hold more than a HOT_SHARE-th of all copies: their rows stay where they are
    least = (first.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = first.where(F.col("n") > least).select(F.col("h").alias("hot_h"), F.col("first").alias("hot_first"))
    told = texts.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
    few = told.where("hot_h is null").join(first.where(F.col("n") <= least).select("h", "first"), "h").select("doc", "h", "first")
    later = few.unionAll(told.where("hot_h is not null").select("doc", "h", "hot_first")).where("doc > first")
    return later.groupBy(F.col("doc").alias("cdoc")).agg(F.collect_set("h").alias("gone"))


def _is_copy(data: bytes, gone: list[str] | None) -> bool:
    return bool(gone) and hashlib.md5(data).hexdigest() in gone


def _originals(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(doc, row, gone): rows with what is known of their copies."""
    return docs.join(again, docs.doc == again.cdoc, "left").select("doc", "row", "gone")


def _with_seeds(rows: DataFrame, shared: DataFrame) -> DataFrame:
    keys = shared.groupBy(F.col("doc").alias("kdoc")).agg(F.collect_list("keys").alias("keys"))
    return rows.join(keys, rows.doc == keys.kdoc, "left").select("doc", "row", "gone", "keys")


def _among(keys: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted pool."""
    if not len(pool):
        return np.zeros(len(keys), bool)
    return pool[np.minimum(np.searchsorted(pool, keys), len(pool) - 1)] == keys


def _shared_segments(batch: pa.RecordBatch, length: int, busy: np.ndarray, of_busy: bool = False):
    """(documents, text keys, what ``segments`` yields) of a batch's windows with a
    shared context: of the busy seeds, or of the others."""
    docs, texts, wanted = [], [], []
    for doc, data, gone, keys in zip(batch.column(0), _text_bytes(batch.column(1)), batch.column(2), batch.column(3)):
        if keys.is_valid and doc.is_valid and not _is_copy(data, gone.as_py()):
            docs.append(doc.as_py())
            texts.append(data)
            wanted += keys.as_py()
    if not docs:
        return
    text_keys = np.array([_text_key(t) for t in texts], np.int64)
    docs = np.array(docs, np.int64)
    pool = np.unique(np.frombuffer(b"".join(wanted), np.uint32))
    for buffer, at, row, start, n, key, seed in _placed_segments(texts, length):
        own = _among(key, busy) == of_busy
        at, row, start, n, key, seed = at[own], row[own], start[own], n[own], key[own], seed[own]
        # contexts shared by any document of the batch: the sorting decides exactly
        has_lead, lead_key, has_rest, rest_key, lead = contexts(buffer, at, n, seed, length)
        has_lead &= _among(_tag(lead_key), pool)
        has_rest &= _among(_tag(rest_key), pool)
        skip = np.where(has_lead, 0, lead)
        n = np.where(has_rest, n, lead) - skip
        here = has_lead | has_rest
        skip = skip[here]
        yield docs[row[here]], text_keys[row[here]], buffer, at[here] + skip, start[here] + skip, n[here], key[here]


def _busy_windows(batch: pa.RecordBatch, length: int, busy: np.ndarray):
    """(names, documents, places) of the windows of a batch's busy seeds."""
    for doc, text_key, buffer, at, start, n, _ in _shared_segments(batch, length, busy, of_busy=True):
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        s1, s2 = _names(_cut_out(buffer, (at[own] + step), np.ones(len(own), np.int64), length))
        yield s1, s2, doc[own], text_key[own] | (start[own] + step)


def _busy_hits(wide: DataFrame, busy: np.ndarray, length: int) -> DataFrame:
    """(doc, place, mask) of the windows of busy seeds that a smaller id has too."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for s1, s2, doc, _ in _busy_windows(batch, length, busy):
                order = np.lexsort((s2, s1))
                s1, s2, doc = s1[order], s2[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(s1) != 0) | (np.diff(s2) != 0)))) if len(s1) else []
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        s1[first], s2[first], np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first))],
                        ["s1", "s2", "low", "high"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x in _busy_windows(batch, length, busy):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["s1", "s2", "doc", "place"])

    found = (wide.mapInArrow(distinct, "s1 long, s2 int, low long, high long").groupBy("s1", "s2")
             .agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").drop("high"))
    return (wide.mapInArrow(occurrences, "s1 long, s2 int, doc long, place long").join(found, ["s1", "s2"])
            .where("doc > low").select("doc", "place", F.lit(1).cast("long").alias("mask")))


def _cut_out(buffer: bytes, at: np.ndarray, n: np.ndarray, length: int) -> list[bytes]:
    return [buffer[a:b] for a, b in zip(at.tolist(), (at + n + length - 1).tolist())]


def _names(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96-bit names of segments, as two columns."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, parts)), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], (both[:, 1] >> 32).astype(np.int32)


def _bucketed(wide: DataFrame, segment_buckets: int, busy: np.ndarray, length: int) -> DataFrame:
    """(bucket, n, segments, counts, docs, places): the segments of seeds that are not
    busy, equal ones merged per task, with the places of each."""

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        s1, s2, bucket, doc, place = (np.concatenate([x[i] for x in held]) for i in range(5))
        parts = [p for x in held for p in x[5]]
        order = np.lexsort((s2, s1, bucket))
        s1, s2, bucket, doc, place = s1[order], s2[order], bucket[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(s1) != 0) | (np.diff(s2) != 0) | (np.diff(bucket) != 0))))
        head, bucket, ends = order[first].tolist(), bucket[first], np.append(first, len(order))
        count = np.diff(ends).astype(np.int32)
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0)))
        out = [(int(bucket[a]), b - a, _packed([parts[i] for i in head[a:b]]), count[a:b].tobytes(),
                doc[ends[a]:ends[b]].tobytes(), place[ends[a]:ends[b]].tobytes())
               for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(head)])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*out), (pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["bucket", "n", "segments", "counts", "docs", "places"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for doc, text_key, buffer, at, start, n, key in _shared_segments(batch, length, busy):
                if not len(at):
                    continue
                parts = _cut_out(buffer, at, n, length)
                held.append((*_names(parts), (key % np.uint64(segment_buckets)).astype(np.int64), doc, text_key | start, parts))
                size += int((n + length - 1).sum())
                if size >= HELD_BYTES:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    return wide.mapInArrow(distinct, "bucket long, n long, segments binary, counts binary, docs binary, places binary")


def marks(docs: DataFrame, again: DataFrame, total_bytes: int, length: int = LENGTH) -> DataFrame:
    """(doc, marks): per document the windows to remove, as the place of the
    first window (under its text's key) and mask; ``docs`` has doc (long) and row (a struct whose first
    field t is the text), ``again`` is its ``copies``."""
    if not SEED < length <= SEED + 62:
        raise ValueError(f"length must be over {SEED} and at most {SEED + 62}")
    buckets = max(ceil(total_bytes / BUCKET_BYTES), 16)
    segment_buckets = max(ceil(total_bytes / SEGMENT_BUCKET_BYTES), 16)
    rows = _originals(docs, again)
    wide = _with_seeds(rows, shared_seeds(rows, buckets, length))
    busy = busy_seeds(docs, total_bytes, length)

    hits = (_bucketed(wide, segment_buckets, busy, length)
            .groupBy("bucket").applyInArrow(lambda t: _window_marks(t, length), "doc long, place long, mask long"))
    if len(busy):
        hits = hits.unionByName(_busy_hits(wide, busy, length))
    return hits.groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))


def spans_of(data: bytes, at: np.ndarray, mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (starts, lengths) covered by the marked windows of a text."""
    if len(at):
        own = at & ~np.int64(0xFFFFFFFF) == _text_key(data)
        at, mask = at[own] & 0xFFFFFFFF, mask[own]
    if not len(at):
        return at, at
    hit, bit = np.nonzero((mask[:, None] >> np.arange(length - SEED + 1)) & 1)
    starts = np.unique(at[hit] + bit)
    first = np.flatnonzero(np.concatenate(([True], np.diff(starts) > length)))
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + length - starts[first]


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                      as_text: bool = False) -> DataFrame:
    """``df`` with spans (start and length in bytes of each removed run),
    n_bytes, n_removed, n_spans and kept: the remaining bytes, or with
    ``as_text`` the text they hold, without characters that a cut left broken."""
    total = df.agg(F.sum(text_bytes(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    new = {"spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])),
           "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(),
           "kept": T.StringType() if as_text else T.BinaryType()}
    own = [c for c in df.columns if c not in new]
    is_text = df.schema[text_col].dataType == T.StringType()
    rest = [c for c in own if not (c == text_col and is_text)]
    # a whole row travels as one column, so that every step reads the same shuffle of it
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.struct(
        F.col(text_col).cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"))
    again = copies(docs, length)
    found = marks(docs, again, total, length).withColumnRenamed("doc", "mdoc")
    joined = _originals(docs, again)
    joined = joined.join(found, joined.doc == found.mdoc, "left").select("row", "gone", "marks")
    schema = T.StructType([joined.schema["row"], *[T.StructField(k, v) for k, v in new.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, sizes, kept = [], [], []
            found = batch.column(2)
            ends = found.offsets.to_numpy()
            place, mask = (c.to_numpy() for c in found.values.flatten())
            for data, g, a, b in zip(_text_bytes(batch.column(0)), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if _is_copy(data, g):
                    cuts = np.zeros(1, np.int64), np.array([len(data)])
                else:
                    cuts = spans_of(data, place[a:b], mask[a:b], length)
                at, left = 0, []
                for start, size in zip(*(c.tolist() for c in cuts)):
                    left.append(data[at:start])
                    at = start + size
                spans.append(cuts)
                sizes.append(len(data))
                kept.append(b"".join([*left, data[at:]]) if at else data)
            count = np.array([len(x) for x, _ in spans], np.int64)
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*spans)], ["start", "length"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), runs),
                 pa.array(sizes, pa.int64()), pa.array([a - len(k) for a, k in zip(sizes, kept)], pa.int64()), pa.array(count),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
                ["row", *new])

    done = joined.mapInArrow(run, schema)
    back = [F.col("row.t").alias(c) if c == text_col and is_text else F.col(f"row.c{rest.index(c)}").alias(c) for c in own]
    return done.select(*back, *new)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    size_col: str | None = None) -> DataFrame:
    """``df`` with the repeated passages cut out of its texts.  Characters that
    a cut leaves incomplete go; ``size_col``, if given, becomes the new number
    of characters.  Texts that lose nothing stay as they are; rows of which no
    word is left are left out."""
    own = {c: row_column(df, f"_own_{c}") for c in df.columns if c in ("spans", "n_bytes", "n_removed", "n_spans", "kept")}
    done = repeated_passages(df.withColumnsRenamed(own), id_col, text_col, length, as_text=True)
    done = done.withColumn(text_col, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text_col)))
    if size_col:
        done = done.withColumn(size_col, F.when(F.col("n_removed") > 0, F.length(text_col).cast(
            df.schema[size_col].dataType)).otherwise(F.col(size_col)))
    done = done.where((F.col("n_removed") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return done.select(*[F.col(own.get(c, c)).alias(c) for c in df.columns])
