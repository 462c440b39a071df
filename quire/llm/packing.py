"""Concatenate and cut: documents into sequences of a fixed number of tokens.

All documents, each followed by an end id, form one long row of tokens that is
cut every ``length`` tokens, so only the very last sequence can need padding.

First pass: every task tokenises its partition once and writes, per document,
the ids, the partition number and the offset within the partition (a running
sum).  The partitions' totals, one row each, give the partitions' global
offsets by a prefix sum.  Second pass: offset of partition plus offset within it
is a document's global place; it is cut at the multiples of ``length`` into
pieces, each task on its own.  A window that two partitions share is made of
boundary records: pieces with the same sequence number from both, put together
by ``sequences``.  Nothing is shuffled to cut; the tokens are written once to
the shared folder, so a lost executor never renumbers what others have cut.

Ids are those of the tokenizers library without added special tokens; pieces of
text that occur again are looked up instead of being merged again.  Between the
passes an id takes two bytes where the vocabulary allows it.

Cases: a null text is empty (its only token is the end id); texts of any length
are packed whole; repeated rows are packed each; an empty table gives no piece;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, slices
from quire.llm.token_counts import MAX_PIECES, TOKENIZER, Splitter, sweeps

LENGTH = 1024
END_ID = 0
#: characters split and looked up at once
SWEEP = 1 << 19
_AFTER_BLANK = re.compile(r" [^\s]+")


def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """Random-looking 64-bit numbers, one for each input."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceHashes:
    """Two 64-bit hashes of every piece of a text at once: sums of scrambled code points
    times powers, so a piece's hash is a difference of two running sums."""

    BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)

    def __init__(self):
        self.codes = [_scramble(np.arange(0x110000), salt) for salt in (1, 2)]
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in self.BASES]

    def grow(self, n: int) -> None:
        for i, base in enumerate(self.BASES):
            if len(self.powers[i][0]) < n:
                both = []
                for factor in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(n, factor, np.uint64)
                    steps[0] = 1
                    both.append(np.cumprod(steps, dtype=np.uint64))
                self.powers[i] = tuple(both)

    def of(self, points: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        self.grow(len(points) + 1)
        ends, out = np.append(starts[1:], len(points)), []
        for codes, (power, inverse) in zip(self.codes, self.powers):
            run = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(codes.take(points) * power[:len(points)], out=run[1:])
            out.append((run.take(ends) - run.take(starts)) * inverse.take(starts))
        return out


class TokenIds:
    """Ids of texts.  Pieces met before are found by two hashes in an open table; the ids
    of all of them lie in one array, from which a batch is one gather."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = Splitter(self.tokenizer.pre_tokenizer.pre_tokenize_str)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, special))) if special else None
        self.hashes = PieceHashes()
        self.forget()

    def forget(self) -> None:
        self.count = self.used = 0
        self.known, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.table(1 << 18)

    def table(self, size: int) -> None:
        """An empty table; number -1 marks a free place."""
        self.keys, self.place = [np.zeros(size, np.uint64) for _ in range(2)], np.full(size, -1, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for a new one."""
        mask, out = len(self.place) - 1, np.full(len(first), -1, np.int64)
        at = (first >> np.uint64(20)).astype(np.int64) & mask
        open_ = np.arange(len(first))
        while len(open_):
            number = self.place.take(at)
            same = (self.keys[0].take(at) == first.take(open_)) & (self.keys[1].take(at) == second.take(open_)) & (number >= 0)
            out[open_[same]] = number[same]
            on = np.flatnonzero(~same & (number >= 0))
            open_, at = open_.take(on), (at.take(on) + 1) & mask
        return out

    def put(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        """Enter distinct new pieces; of several for one free place one gets it a round."""
        mask = len(self.place) - 1
        at, open_ = (first >> np.uint64(20)).astype(np.int64) & mask, np.arange(len(first))
        while len(open_):
            free = self.place.take(at) < 0
            self.place[at[free]] = numbers[open_[free]]
            won = free & (self.place.take(at) == numbers.take(open_))
            for keys, own in zip(self.keys, (first, second)):
                keys[at[won]] = own[open_[won]]
            on = np.flatnonzero(~won)
            open_, at = open_.take(on), (at.take(on) + 1) & mask

    def keep(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number new pieces; their ids follow one another."""
        if self.used + len(ids) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros(max(len(ids), len(self.known)), np.uint32)])
        if self.count + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(sizes) + 1, len(self.ends)), np.int64)])
        numbers = np.arange(self.count, self.count + len(sizes))
        self.known[self.used:self.used + len(ids)] = ids
        self.ends[numbers + 1] = self.used + np.cumsum(sizes)
        self.used, self.count = self.used + len(ids), self.count + len(sizes)
        size = len(self.place)
        while 2 * self.count > size:
            size *= 2
        if size > len(self.place):  # everything is entered again
            old, taken = self.keys, np.flatnonzero(self.place >= 0)
            had = self.place[taken].astype(np.int64)
            self.table(size)
            self.put(old[0][taken], old[1][taken], had)
        self.put(first, second, numbers)

    def learn(self, new: list[str], first: np.ndarray, second: np.ndarray) -> None:
        """Ids of pieces not met before.  Pieces that begin with a blank split
        again where they did, so many go to the library as one text."""
        plain = np.array([_AFTER_BLANK.fullmatch(p) is not None for p in new], bool)
        joined, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        for at in range(0, len(joined), 1000):
            part = joined[at:at + 1000]
            done = self.tokenizer.encode("".join([new[i] for i in part]), add_special_tokens=False)
            words = np.array(done.word_ids)
            if words[-1] + 1 != len(part):
                raise ValueError("the tokenizer splits pieces another way")
            self.keep(first[part], second[part], np.array(done.ids, np.uint32), np.bincount(words, minlength=len(part)))
        if len(rest):
            done = [x.ids for x in self.tokenizer.encode_batch([new[i] for i in rest], add_special_tokens=False)]
            self.keep(first[rest], second[rest], np.array([i for x in done for i in x], np.uint32),
                      np.array([len(x) for x in done]))

    def numbers(self, text: str, starts: np.ndarray) -> np.ndarray:
        """Number of every piece of a text that is cut at ``starts``."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first, second = self.hashes.of(points, starts)
        found = self.find(first, second)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.count + len(missing) > MAX_PIECES:
                self.forget()
                missing = np.arange(len(starts))
            own = missing[np.unique(first[missing], return_index=True)[1]]
            ends = np.append(starts[1:], len(points))
            self.learn([text[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())], first[own], second[own])
            found[missing] = self.find(first[missing], second[missing])
        return found

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, and the number of each)."""
        whole = {row: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                 for row, text in enumerate(texts) if text and self.specials and self.specials.search(text)}
        counts, chunks = np.zeros(len(texts), np.int64), []
        for group in sweeps([None if row in whole else t for row, t in enumerate(texts)], None, SWEEP):
            parts = [t for _, t in group]
            cuts = self.splitter.piece_starts(parts)
            offset = np.cumsum([0, *map(len, parts)])
            found = self.numbers("".join(parts), np.concatenate([c + o for c, o in zip(cuts, offset.tolist())]))
            begin, size = self.ends.take(found), self.ends.take(found + 1)
            size = size - begin
            ends = np.cumsum(size)
            chunks.append(self.known.take(np.repeat(begin - ends + size, size) + np.arange(ends[-1])))
            last = ends[np.cumsum([len(x) for x in cuts]) - 1]
            np.add.at(counts, [row for row, _ in group], np.diff(last, prepend=0))
        ids = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
        if whole:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for row, own in whole.items():
                split[row], counts[row] = own, len(own)
            ids = np.concatenate(split)
        return ids, counts

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of little-endian unsigned 32-bit integers."""
        ids, counts = self.arrays(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]


_LOADED: dict[str, TokenIds] = {}


def encoder(path: str | None = None) -> TokenIds:
    """The worker's tokenizer; without a path, the public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def id_type(path: str | None = None, end_id: int = END_ID) -> str:
    """How ids are stored between the passes: two bytes each where they fit."""
    return "<u2" if max(encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that are consecutive parts of one array, ``ends`` in its elements."""
    at = np.concatenate([[0], ends]) * data.dtype.itemsize
    kind = pa.binary() if at[-1] < 1 << 31 else pa.large_binary()
    offsets = at.astype(np.int32 if kind == pa.binary() else np.int64)
    out = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return out.cast(pa.binary())


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           end_id: int = END_ID) -> DataFrame:
    """(part, at, id, n, ids): the first pass, written to the shared folder; ids are
    stored as ``id_type``."""
    stored = id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, n = encoder(path).arrays(batch.column(1).to_pylist())
            own = np.cumsum(n)
            ids = np.insert(ids, own, end_id).astype(stored)
            n = n + 1
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(0), pa.array(n),
                 _binary(ids, np.cumsum(n))], ["part", "at", "id", "n", "ids"])
            at = int(ends[-1]) if len(ends) else at

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = dict(rows.dtypes)["id"]
    return materialise(rows.mapInArrow(run, f"part int, at long, id {kind}, n long, ids binary"), "tokens")


def offsets(first: DataFrame) -> dict[int, int]:
    """Global offset of every partition: a prefix sum over one total each."""
    totals = first.groupBy("part").agg(F.sum("n").alias("n")).collect()
    out, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        out[row["part"]] = at
        at += row["n"]
    return out


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset) per piece;
    ids are the piece's ids as little-endian unsigned 32-bit integers."""
    first = tokens(df, id_col, text_col, path, end_id)
    base = df.sparkSession.sparkContext.broadcast(offsets(first))
    kind, stored = dict(first.dtypes)["id"], id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part, at, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
            begin = at + np.fromiter(map(base.value.__getitem__, part.tolist()), np.int64, len(part))
            count = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            seq = begin[row] // length + k
            lo = np.maximum(begin[row], seq * length)
            size = np.minimum(begin[row] + n[row], (seq + 1) * length) - lo
            start = lo - begin[row]
            # the pieces of a batch are its documents' ids cut at more places
            whole = np.frombuffer(b"".join(batch.column(4).to_pylist()), stored).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(row)), pa.array(start), pa.array(size), _binary(whole, np.cumsum(size)),
                 pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return first.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of each window put together, at
    most ``length`` of them, and padded to ``length`` ids unless the number of
    tokens is a power of two."""
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit("").cast("binary"),
                        lambda acc, x: F.concat(acc, x["ids"]))
    n = F.sum("length")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(length) - n).cast("int")))
    full = F.bit_count(n) == 1
    return packed.groupBy("sequence_id").agg(
        n.alias("n_tokens"), F.when(full, whole).otherwise(F.concat(whole, pad)).alias("ids"))
