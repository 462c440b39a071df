"""Target-distribution importance resampling over hashed word features.

Every text is a bag of features: all runs of one or two consecutive words,
hashed by CRC-32 into ``buckets`` classes.  The corpus and a target collection
give exact bucket totals; the log ratio of the two smoothed shares is a
bucket's gain, a document's weight is the floored mean of the gains of its
features, and documents are drawn without replacement by adding Gumbel noise
(from a hash of the id, so a rerun draws the same ones) and taking the highest.

Head-tail vocabulary: most word and pair occurrences come from a short head.
The head's words with their CRC and the CRC state after a following blank, and
the head's pairs with their bucket, are broadcast (``HEAD_WORDS`` words and
``HEAD_PAIRS`` pairs at most, from the counts of a sample; the choice decides
what is looked up, never a result).  A word or pair outside the head takes its
CRC directly; a pair behind a head word goes on from that word's state.

First pass: each task turns texts into bucket numbers, two bytes each, written
once to the shared folder.  Second: bucket counts are summed in each task, then
by Spark; ``buckets`` rows reach the driver.  Third: gains are looked up and
summed per document, and the documents are ranked by range partitions.

Cases: a null text has no words; texts without words weigh 0; a null id hashes
as the empty string and loses ties; repeated rows count, are drawn and ranked
each; an empty corpus gives an empty result and an empty target T = 0; very long
texts are cut into blocks at word ends, carrying one word over, so all their
features count; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, word_blocks
from quire.operators.rank import global_rank

BUCKETS = 10_000
#: documents with fewer words are never drawn
LEAST_WORDS = 20
#: percent of the eligible documents that are drawn
PERCENT = 25
SEED = 7
#: bounds of the broadcast head, and about how many documents its counts come from
HEAD_WORDS, HEAD_PAIRS, HEAD_DOCS = 20_000, 200_000, 2_000
#: bytes of text worked on at once
GROUP_BYTES = 1 << 20
_SCALE = 4294967296

# Letters a-z, digits and all bytes of non-ASCII characters belong to words; A-Z are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32
              for b in range(256))


def _groups(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[list[bytes]], bool]]:
    """(rows, words of each, whether the first one's first word was carried over)."""
    rows, words, size = [], [], 0
    for row, text in enumerate(texts):
        data = (text or b"").translate(_FOLD)
        if len(data) > GROUP_BYTES:
            for k, block in enumerate(word_blocks(data, 1, GROUP_BYTES)):
                yield [row], [block], k > 0
            continue
        if size + len(data) > GROUP_BYTES and rows:
            yield rows, words, False
            rows, words, size = [], [], 0
        rows.append(row)
        words.append(data.split())
        size += len(data)
    if rows:
        yield rows, words, False


class Head:
    """Frequent words and pairs with their CRC states and buckets."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int):
        self.buckets = buckets
        self.index = {w: i for i, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words] + [0], np.int64)
        self.state = np.array([zlib.crc32(b" ", zlib.crc32(w)) for w in words] + [0], np.int64)
        found = {}
        for pair in pairs:
            a, b = pair.split(b" ")
            if a in self.index and b in self.index:
                found[self.index[a] * len(words) + self.index[b]] = zlib.crc32(pair) % buckets
        self.keys = np.array(sorted(found), np.int64)
        self.pair_bucket = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def features(self, words: list[list[bytes]], skip_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the features of several texts, one after the other, and the
        number of each; ``skip_first`` leaves out the first word by itself."""
        flat = [w for x in words for w in x]
        size = np.array([len(x) for x in words], np.int64)
        n = len(flat)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, n)
        crc, state = self.crc[ids], self.state[ids]
        tail = np.flatnonzero(ids < 0)
        direct = [zlib.crc32(flat[i]) for i in tail.tolist()]
        crc[tail] = direct
        state[tail] = [zlib.crc32(b" ", c) for c in direct]
        out = np.full(2 * n, -1, np.int64)
        out[0::2] = crc % self.buckets
        if skip_first:
            out[0] = -1
        last = np.zeros(n, bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        at = np.flatnonzero(~last)
        first, second = ids[at], ids[at + 1]
        bucket = np.full(len(at), -1, np.int64)
        if len(self.keys):
            key = np.where((first >= 0) & (second >= 0), first * len(self.index) + second, -1)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            bucket[hit] = self.pair_bucket[place[hit]]
        rest = np.flatnonzero(bucket < 0)
        where = at[rest]
        bucket[rest] = np.fromiter((zlib.crc32(flat[i + 1], s) for i, s in zip(where.tolist(), state[where].tolist())),
                                   np.int64, len(rest)) % self.buckets
        out[2 * at + 1] = bucket
        keep = out >= 0
        owner = np.repeat(np.repeat(np.arange(len(words)), size), 2)
        return out[keep], np.bincount(owner[keep], minlength=len(words))


def choose_head(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, words: int = HEAD_WORDS,
                pairs: int = HEAD_PAIRS, docs: int = HEAD_DOCS) -> Head:
    """Head of the vocabulary by the counts of about ``docs`` sampled documents."""
    total = df.count()
    few = df.select(F.col(text_col).cast("string").cast("binary").alias("t"))
    if total > docs:
        few = few.sample(fraction=docs / total, seed=SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for _, groups, skip in _groups(batch.column(0).to_pylist()):
                for w in groups:
                    seen[0].update(w[1:] if skip else w)
                    seen[1].update(map(b" ".join, zip(w, w[1:])))
            for kind, counts in enumerate(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], ["kind", "f", "n"])

    counts = few.mapInArrow(run, "kind int, f binary, n long").groupBy("kind", "f").agg(F.sum("n").alias("n"))
    best = materialise(counts.where("n > 1"), "head").orderBy(F.desc("n"), "f")
    return Head([bytes(r["f"]) for r in best.where("kind = 0").limit(words).collect()],
                [bytes(r["f"]) for r in best.where("kind = 1").limit(pairs).collect()], buckets)


def feature_buckets(df: DataFrame, head: Head, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, buckets) per text, written once: the bucket numbers of its features
    as little-endian unsigned integers of two bytes (four beyond 65,536 buckets)."""
    shared = df.sparkSession.sparkContext.broadcast(head)
    width = "<u2" if head.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for rows, words, skip in _groups(batch.column(1).to_pylist()):
                found, counts = shared.value.features(words, skip)
                data, ends = found.astype(width).tobytes(), np.cumsum(counts) * int(width[-1])
                for row, a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
                    out[row] = out[row] + data[a:b] if skip else data[a:b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // int(width[-1]) for x in out], pa.int64()),
                 pa.array(out, pa.binary())], ["id", "n", "buckets"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    kind = dict(rows.dtypes)["id"]
    return materialise(rows.mapInArrow(run, f"id {kind}, n long, buckets binary"), "features")


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Exact number of features in every bucket: a task adds up its texts, Spark the tasks."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), width), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counts = features.select("buckets").where("n > 0").mapInArrow(run, "bucket int, n long")
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of a bucket in the target over that in the corpus."""
    k, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + k) / ((s + 1.0) * (big_t + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def scored(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) per text."""
    shared = features.sparkSession.sparkContext.broadcast(gain)
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = features.select("id", "n", "buckets", F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
                           .alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            total = np.fromiter((shared.value[np.frombuffer(x.as_buffer(), width)].sum() for x in batch.column(2)),
                                np.int64, len(n))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.array([math.floor(-1000 * math.log(-math.log((h + 0.5) / _SCALE)))
                              for h in batch.column(3).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((n + 1) // 2), pa.array(n), pa.array(weight), pa.array(weight + noise)],
                ["id", "n_words", "n_features", "weight", "score"])

    kind = dict(features.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every document; rank
    numbers the drawn ones from 1 by score, ties to the smaller id, else null."""
    head = choose_head(docs, text_col, buckets)
    features = feature_buckets(docs, head, id_col, text_col)
    aims = feature_buckets(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("t")), head, "id", "t")
    gain = gains(bucket_totals(features, buckets), bucket_totals(aims, buckets))
    rows = scored(features, gain, seed)
    able = global_rank(rows.where(F.col("n_words") >= least_words),
                       [F.desc("score"), F.asc_nulls_last("id"), F.desc("weight"), "n_features"], "rank", "total")
    drawn = F.when(F.col("rank") <= F.expr(f"{int(percent)} * total div 100"), F.col("rank"))
    out = able.select(*rows.columns, drawn.alias("rank")).unionByName(
        rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn."""
    ids = resample(docs, target, id_col, **options).where("rank is not null").select(id_col).distinct()
    return docs.join(ids, id_col, "left_semi")
