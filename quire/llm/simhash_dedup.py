"""Near duplicates by SimHash and a binary-trie self-join.

A document's 64-bit fingerprint has a bit set where over half of its word
shingles have it set in their XXH64.  Two fingerprints link at ``max_bits``
or fewer differing bits; documents reachable over links form a component.

Candidate pairs come from a walk of binary tries: two nodes are traversed
together, differing bits are added up on the way, and a pair of nodes is
dropped as soon as the error budget is exceeded.  To share the work out, the
64 bits are cut into ``max_bits + 2`` blocks.  At most ``max_bits`` blocks can
differ, so any two linked fingerprints agree in at least two whole blocks; each
choice of two blocks deals the distinct fingerprints to tries keyed by those
bits.  Equal fingerprints are merged first (a group of copies is one leaf).
A task keeps a union-find over its leaves and emits at most one edge per leaf,
never the pairs of a group, and node pairs whose leaves are joined already are
not opened.

Cases: a null text has no words; a text without words has fingerprint zero and
links like any other; fewer words than a shingle make one shingle of them all.
Rows with a null id get a fingerprint but no component of their own id (the
component is the smallest id reachable, null if there is none).  Repeated rows
stay repeated.  Several texts under one id are judged each by itself: they share
a component only if their fingerprints do.  ``near_duplicates`` reads the id and
the text and returns its three columns; ``keep_one`` returns all columns of its
input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, row_column, slices, star_components, word_blocks

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: node pairs opened at once, and leaves held at once where groups allow a cut
PAIRS_AT_ONCE = 1 << 16
LEAVES_AT_ONCE = 1 << 20


def simhash(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    ones, total, few = np.zeros(64, np.int64), 0, None
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower(), n - 1):
        if len(words) < n:
            few = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([xxh64_intdigest(joined[a:b], HASH_SEED)
                           for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())],
                          dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxh64_intdigest(b" ".join(few), HASH_SEED) if few else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, text_hash): fp is the fingerprint as a signed long; the hash tells the
    texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(t.as_py(), n) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)],
                                             ["id", "fp", "text_hash"])

    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"),
                      _text_hash(text_col).alias("text_hash"))
            .mapInArrow(run, "id long, fp long, text_hash long"))


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


class _Leaves:
    """Union-find over the leaves of a forest of tries."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.settle()

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pending.append((a, b))
        self.waiting += len(a)

    def settle(self) -> None:
        """Join what was linked and refresh the roots."""
        root = self.root
        for a, b in self.pending:
            while True:
                ra, rb = root[a], root[b]
                open_ = ra != rb
                if not open_.any():
                    break
                a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while True:
                    up = root[root]
                    if np.array_equal(up, root):
                        break
                    root = up
        self.root, self.pending, self.waiting = root, [], 0
        self.breaks = np.concatenate(([0], np.cumsum(root[1:] != root[:-1]))) if len(root) else root

    def joined(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether all leaves of both ranges are in one class already."""
        return ((self.breaks[alo] == self.breaks[ahi - 1]) & (self.breaks[blo] == self.breaks[bhi - 1])
                & (self.root[alo] == self.root[blo]))


def trie_links(codes: np.ndarray, key_bits: int, budget: int) -> np.ndarray:
    """Class of every leaf of the tries that agree in their first ``key_bits``.

    ``codes`` are sorted, distinct unsigned 64-bit values.  Returns for each
    leaf the smallest index of a leaf reachable over pairs of at most
    ``budget`` differing bits within one trie.
    """
    leaves = _Leaves(len(codes))
    tops = codes >> np.uint64(64 - key_bits) if key_bits else np.zeros(len(codes), np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1]))) if len(codes) else np.array([], np.int64)
    hi = np.append(lo[1:], len(codes))
    more = hi - lo > 1
    lo, hi = lo[more], hi[more]
    stack = [(63 - key_bits, lo, hi, lo, hi, np.zeros(len(lo), np.int64))] if len(lo) else []
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            stack.append((bit, *(x[PAIRS_AT_ONCE:] for x in (alo, ahi, blo, bhi, diff))))
            alo, ahi, blo, bhi, diff = (x[:PAIRS_AT_ONCE] for x in (alo, ahi, blo, bhi, diff))
        if leaves.waiting >= 4096:
            leaves.settle()
        if len(leaves.root) > 2:
            open_ = ~leaves.joined(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, diff = (x[open_] for x in (alo, ahi, blo, bhi, diff))
        # single leaves: the remaining bits at once
        one = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[one], blo[one]
        near = np.bitwise_count(codes[a] ^ codes[b]) <= budget
        leaves.link(a[near], b[near])
        # whatever the rest of the bits, every leaf of these pairs is near
        rest = ~one & (bit + 1 + diff <= budget)
        for i in np.flatnonzero(rest):
            span = np.concatenate((np.arange(alo[i], ahi[i]), np.arange(blo[i], bhi[i])))
            leaves.link(span[1:], span[:-1])
        go = ~one & ~rest
        if bit < 0 or not go.any():
            continue
        alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
        step = np.uint64(1) << np.uint64(bit)
        clear = ~((step << np.uint64(1)) - np.uint64(1)) if bit < 63 else np.uint64(0)
        amid = np.searchsorted(codes, (codes[alo] & clear) | step)
        bmid = np.searchsorted(codes, (codes[blo] & clear) | step)
        amid, bmid = np.clip(amid, alo, ahi), np.clip(bmid, blo, bhi)
        own = alo == blo
        cross = ~own
        kids = ((alo, amid, bmid, bhi, diff + 1, slice(None)), (amid, ahi, blo, bmid, diff + 1, cross),
                (alo, amid, blo, bmid, diff, slice(None)), (amid, ahi, bmid, bhi, diff, slice(None)))
        parts = []
        for clo, chi, dlo, dhi, d, which in kids:
            part = [x[which] for x in (clo, chi, dlo, dhi, d)]
            ok = (part[1] > part[0]) & (part[3] > part[2]) & (part[4] <= budget)
            ok &= ~((part[0] == part[2]) & (part[1] - part[0] == 1))
            parts.append([x[ok] for x in part])
        # pairs within one node last, so that they are opened first
        stack.append((bit - 1, *(np.concatenate([p[k] for p in parts[:2]]) for k in range(5))))
        stack.append((bit - 1, *(np.concatenate([p[k] for p in parts[2:]]) for k in range(5))))
        stack[-2:] = [s for s in stack[-2:] if len(s[1])]
    leaves.settle()
    return leaves.root


def bit_blocks(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of max_bits + 2 nearly equal blocks of the 64 bits."""
    edges = [round(64 * k / (max_bits + 2)) for k in range(max_bits + 3)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _dealt(max_bits: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For every choice of two blocks: all blocks with the chosen ones first,
    and the number of key bits."""
    blocks = bit_blocks(max_bits)
    out = []
    for i, j in combinations(range(len(blocks)), 2):
        rest = [b for k, b in enumerate(blocks) if k not in (i, j)]
        out.append(([blocks[i], blocks[j], *rest], blocks[i][1] + blocks[j][1]))
    return out


def _permuted(fp, order: list[tuple[int, int]]):
    """The bits of ``fp`` with the given blocks from the top down."""
    out, at = None, 64
    for low, width in order:
        at -= width
        part = F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at)
        out = part if out is None else out.bitwiseOR(part)
    return out


def link_edges(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): edges that connect the linked rows of ``nodes`` (fp, least), fp distinct,
    at most one per node and trie.  A node is (least, fp): its smallest id comes first, so
    the smallest node of a component tells the component's smallest id."""
    deals = _dealt(max_bits)
    rows = nodes.select("least", F.col("fp").alias("node"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("deal"),
                 F.shiftrightunsigned(_permuted(F.col("fp"), order), 64 - bits).alias("key"),
                 _permuted(F.col("fp"), order).alias("code"))
        for k, (order, bits) in enumerate(deals)])).alias("x")).select("least", "node", "x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(part):
            for k in np.unique(part[:, 0]):
                of = part[part[:, 0] == k]
                codes = of[:, 2].copy().view(np.uint64)
                sort = np.argsort(codes)
                codes, node, least = codes[sort], of[sort, 1], of[sort, 4]
                root = trie_links(codes, deals[int(k)][1], max_bits)
                away = root != np.arange(len(root))
                if away.any():
                    to = root[away]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (least[away], node[away], least[to], node[to])], ["ul", "uf", "vl", "vf"])

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1))
            size += len(held[-1])
            if size >= LEAVES_AT_ONCE:  # cut where a key ends
                part = np.concatenate(held)
                last = np.flatnonzero((part[:, 0] != part[-1, 0]) | (part[:, 3] != part[-1, 3]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield from solve(part[:cut])
                held, size = [part[cut:]], len(part) - cut
        if size:
            yield from solve(np.concatenate(held))

    # each fingerprint is met once per deal; Spark sorts by key (spilling), the task reads key after key
    dealt = (rows.select(F.col("deal").cast("long").alias("deal"), "node", "code", "key", "least")
             .repartition("deal", "key").sortWithinPartitions("deal", "key"))
    pair = lambda x: F.struct(F.col(f"{x}l").alias("least"), F.col(f"{x}f").alias("fp"))
    return dealt.mapInArrow(run, "ul long, uf long, vl long, vf long").select(pair("u").alias("u"), pair("v").alias("v"))


def _components(df: DataFrame, id_col: str, text_col: str, n: int, max_bits: int) -> DataFrame:
    """(id, fp, text_hash, head, component_id) for every row: fingerprints are the nodes
    and ``head`` is a component's own, so texts of one id are judged each by itself."""
    fps = materialise(fingerprints(df, id_col, text_col, n), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    comp = star_components(link_edges(nodes.where("least is not null"), max_bits))
    own = F.struct("least", "fp")
    of_fp = nodes.join(comp, own == F.col("node"), "left").select(
        F.col("fp").alias("fp2"), F.coalesce("component", own).alias("head"))
    out = fps.join(of_fp, fps.fp == of_fp.fp2).drop("fp2")
    return out.withColumn("component_id", F.col("head.least"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``df``."""
    return _components(df, id_col, text_col, n, max_bits).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``df`` per component: the one of smallest id, of several texts of that
    id in the component the one of smallest fingerprint, then of smallest hash.  An id
    may thus stay for one text and go for another; rows with a null id stay."""
    found = _components(df, id_col, text_col, n, max_bits)
    first = found.where("id = component_id").select("id", "head", "fp", "text_hash").distinct()
    # few components have several texts under their smallest id
    several = first.groupBy("head").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    rivals = first.join(several, "head")
    best = rivals.groupBy("head").agg(F.min(F.struct("fp", "text_hash")).alias("best"))
    second = rivals.join(best, "head").where(F.struct("fp", "text_hash") != F.col("best"))
    gone_id, gone_hash = row_column(df, "_gone_id"), row_column(df, "_gone_hash")
    gone = found.where("id <> component_id").select("id", "text_hash").unionByName(second.select("id", "text_hash")) \
        .distinct().select(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash))
    mark = row_column(df, "_text_hash")
    rows = df.withColumn(mark, _text_hash(text_col))
    left = rows.join(gone, (rows[id_col].cast("long") == gone[gone_id]) & (rows[mark] == gone[gone_hash]), "left_anti")
    known = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, mark])
    return known.unionByName(left.where(F.col(id_col).isNull())).drop(mark)
