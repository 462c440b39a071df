"""Exact top-k inner products by a pivot-distance index.

Vectors become integers, floor(scale * x), and are keyed by their nearest pivot
and their distance to it.  Pivots (centres of a bounded sample) cut space into
cells, distances cut a cell into rings: a ring of a cell is an annulus.  Every
row is indexed; the sample only places pivots and rings.

For a query q and an annulus around pivot p that holds distances lo..hi, the
triangle inequality says that every x in it is at least gap = max(lo - d(q, p),
d(q, p) - hi, 0) away, and |q - x|^2 = |q|^2 + |x|^2 - 2 q.x bounds the product
by (|q|^2 + max |x|^2 - gap^2) / 2.  Each query sorts the annuli by that bound
and expands along them in rounds: first as many as hold more than k rows, then
``GROWTH`` times as many each round; a round is left out where the bound is below
the k-th best product so far, so a query stops as soon as no annulus can
help.  Products are exact integers; the bound is rounded upwards.

Spark deals (annulus, chunk): an annulus of many rows (copies of one vector are
at one distance) is split into chunks of about ``CHUNK_ROWS`` by a hash of the
row, and a task holds one chunk at a time while the queries stream past it,
sorted behind it.  Only the pivots, the ring edges and one row per annulus
(``PIVOTS`` * ``RINGS`` at most) are broadcast.  A round's best rows are written to
the shared folder.

Cases: a vector that is null or holds a null or a non-finite component takes no
part, neither as query nor as candidate; an empty vector is zero; a shorter one
is filled with zeros; products beyond 64 bits are cut to the 64-bit range; a row
is never its own candidate, but another row of the same id is; ties go to the
smaller id, a null id comes last and is no query; fewer than k candidates are all
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise

SCALE = 64
K = 20
#: bounds of the index's directory, and rows that place pivots and rings
PIVOTS, RINGS, SAMPLE = 64, 64, 4096
#: rows that a ring should hold, and that a chunk holds
RING_ROWS, CHUNK_ROWS = 512, 512
GROWTH = 16
SEED = 13
#: stands for a null id, so that it comes last
NO_ID = (1 << 63) - 1
_SMALL = 1 << 15


def scaled_vectors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, integer vectors as doubles) of the vectors that take part; column 0 holds them."""
    column = batch.column(0)
    flat = column.flatten()
    values = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float))
    size = np.where(np.asarray(column.is_null()), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[ends] == bad[ends - size]) & ~np.asarray(column.is_null())
    rows = np.flatnonzero(good)
    return rows, [values[ends[i] - size[i]:ends[i]] for i in rows]


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors under one another, filled with zeros to the longest."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, float).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def packed(vector: np.ndarray) -> tuple[bytes, bool]:
    """Bytes of a vector: two a component where that holds it, else doubles."""
    wide = bool(len(vector)) and bool(np.abs(vector).max() >= _SMALL)
    return vector.astype("<f8" if wide else "<i2").tobytes(), wide


def unpacked(data: list[bytes], wide: list[bool]) -> np.ndarray:
    size = len(data[0]) if data else 0
    if not any(wide) and all(len(x) == size for x in data):
        return np.frombuffer(b"".join(data), "<i2").reshape(len(data), size // 2).astype(float)
    return matrix([np.frombuffer(x, "<f8" if w else "<i2").astype(float) for x, w in zip(data, wide)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` as 64-bit integers."""
    a, b = same_width(a, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    low, high = -(1 << 63), NO_ID
    return np.array([[max(low, min(high, sum(x * y for x, y in zip(map(int, row), other)))) for other in whole]
                     for row in a], np.int64).reshape(len(a), len(b))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = same_width(a, b)
    with np.errstate(all="ignore"):
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))


def centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` centres of the sample: Lloyd's rounds from its first distinct rows."""
    if not len(sample):
        return np.zeros((1, 0))
    found = np.unique(sample, axis=0, return_index=True)[1]
    out = sample[np.sort(found)[:k]].copy()
    for _ in range(rounds):
        near = distances(sample, out).argmin(1)
        for j in np.unique(near):
            out[j] = sample[near == j].mean(0)
    return out


class Directory:
    """Pivots and ring edges: fitted on a sample, a bounded size."""

    def __init__(self, sample: np.ndarray, total: int, pivots: int, rings: int, ring_rows: int):
        self.pivots, self.rings = centres(sample, pivots), rings
        near, far = self.nearest(sample) if len(sample) else (np.zeros(0, int), np.zeros(0))
        self.edges = []
        for j in range(len(self.pivots)):
            own = np.sort(far[near == j])
            n = int(np.clip(round(total * len(own) / max(1, len(sample)) / ring_rows), 1, rings))
            self.edges.append(np.unique(np.quantile(own, np.arange(1, n) / n)) if n > 1 and len(own) else np.zeros(0))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.nan_to_num(distances(vectors, self.pivots), nan=np.inf)
        near = d.argmin(1)
        return near, d[np.arange(len(d)), near]

    def annuli(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, far = self.nearest(vectors)
        ring = np.array([np.searchsorted(self.edges[j], d) for j, d in zip(near.tolist(), far.tolist())], np.int64)
        return near * self.rings + ring, far


def fit_directory(vectors: DataFrame, scale: int = SCALE, pivots: int = PIVOTS, rings: int = RINGS,
                  ring_rows: int = RING_ROWS, sample: int = SAMPLE) -> Directory:
    """Pivots and rings from at most ``sample`` rows of (v)."""
    total = vectors.count()
    few = vectors.select("v") if total <= sample else vectors.select("v").sample(fraction=sample / total, seed=SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scaled_vectors(batch, scale)[1], pa.list_(pa.float64()))], ["v"])

    rows = few.mapInArrow(run, "v array<double>").limit(sample).collect()
    return Directory(matrix([np.array(r["v"], float) for r in rows]), total, pivots, rings, ring_rows)


def build(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          pivots: int = PIVOTS, rings: int = RINGS, ring_rows: int = RING_ROWS, sample: int = SAMPLE) -> DataFrame:
    """The index: (row, id, v, wide, annulus, far, square) of every vector that
    takes part, written once; ``row`` numbers the rows."""
    vectors = df.select(F.col(vector_col).cast("array<double>").alias("v"),
                        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    shared = df.sparkSession.sparkContext.broadcast(fit_directory(vectors, scale, pivots, rings, ring_rows, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = scaled_vectors(batch, scale)
            if not len(rows):
                continue
            whole = matrix(found)
            annulus, far = shared.value.annuli(whole)
            data = [packed(v) for v in found]
            with np.errstate(over="ignore"):
                square = (whole * whole).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(rows)), pa.array([x for x, _ in data], pa.binary()),
                 pa.array([w for _, w in data]), pa.array(annulus), pa.array(far), pa.array(square)],
                ["id", "v", "wide", "annulus", "far", "square"])

    rows = vectors.mapInArrow(run, "id long, v binary, wide boolean, annulus long, far double, square double")
    out = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "index")
    out.directory = shared
    return out


class Annuli:
    """What is known of every annulus: bounds of its distances and lengths, and its chunks."""

    def __init__(self, rows: list, directory: Directory, chunk_rows: int):
        rows = sorted(rows, key=lambda r: r["annulus"])
        self.ids = np.array([r["annulus"] for r in rows], np.int64)
        self.n, self.lo, self.hi, self.square = (
            np.array([r[c] for r in rows], float) for c in ("n", "lo", "hi", "square"))
        self.chunks = np.maximum(1, np.ceil(self.n / chunk_rows)).astype(np.int64)
        self.pivot = self.ids // directory.rings
        self.pivots = directory.pivots

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of each query with the rows of each annulus."""
        with np.errstate(all="ignore"):
            d = distances(queries, self.pivots)[:, self.pivot]
            gap = np.maximum(0, np.maximum(self.lo - d, d - self.hi))
            own = (queries * queries).sum(1)[:, None]
            both = own + self.square[None, :]
            # distances and squares are rounded: a wider gap than the true one must not exclude
            gap = np.maximum(0, gap - 1e-6 * np.sqrt(both))
            most = np.minimum((both - gap * gap) / 2, np.sqrt(own * self.square[None, :])) + 1e-9 * both + 1e-6
        return np.where(np.isfinite(most), most, np.inf)


def _rivals(annuli, k: int, round_no: int, growth: int):
    """Queries to one row per chunk of the annuli that this round expands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Annuli = annuli.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, ids, v, wide, least, tie = (part.column(i).to_pylist() for i in range(6))
                bound = known.bounds(unpacked(v, wide))
                order = np.argsort(-bound, axis=1, kind="stable")
                # the first round takes annuli until they hold more than k rows
                first = 1 + (np.cumsum(known.n[order], axis=1) <= k).sum(1)
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
                begin = np.zeros_like(first) if round_no == 0 else first * growth ** (round_no - 1)
                low = np.array([-np.inf if x is None else x for x in least])
                q, a = np.nonzero((rank >= begin[:, None]) & (rank < (first * growth ** round_no)[:, None])
                                  & (bound >= low[:, None]))
                times = known.chunks[a]
                q, a = np.repeat(q, times), np.repeat(a, times)
                chunk = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known.ids[a]), pa.array(chunk), pa.array(np.ones(len(a), np.int32)),
                     *(part.column(i).take(take) for i in range(6))],
                    ["annulus", "chunk", "kind", "row", "id", "v", "wide", "least", "tie"])

    return run


def _best_of_chunk(k: int):
    """Chunks, each followed by its queries, to the products that may be among the best."""

    def best(held, queries) -> pa.RecordBatch | None:
        rows, ids, vectors = held
        q_row, q_id, q_v, q_wide, least, tie = queries
        score = products(unpacked(q_v, q_wide), vectors)
        place = {r: j for j, r in enumerate(rows.tolist())}
        may = np.ones(score.shape, bool)
        for i, (r, low, rival) in enumerate(zip(q_row, least, tie)):
            if low is not None:
                may[i] = (score[i] > low) | ((score[i] == low) & (ids < rival))
            if r in place:
                may[i, place[r]] = False
        out_q, out_c = [], []
        for i in np.flatnonzero(may.any(1)).tolist():
            c = np.flatnonzero(may[i])
            if len(c) > k:  # candidates are in order of id, so a stable sort keeps the smaller of equals
                c = c[np.argsort(-score[i, c], kind="stable")[:k]]
            out_q += [i] * len(c)
            out_c.append(c)
        if not out_q:
            return None
        q, c = np.array(out_q), np.concatenate(out_c)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(q_row)[q]), pa.array(np.array(q_id)[q]), pa.array(ids[c]), pa.array(score[q, c])],
            ["row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, held = None, [], None
        for batch in batches:
            a, ch, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(ch) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
                if lo == hi:
                    continue
                if key != (a[lo], ch[lo]):
                    key, gathered, held = (a[lo], ch[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    gathered.append([part.column(i).to_pylist() for i in range(3, 7)])
                    continue
                if held is None:
                    rows, ids, v, wide = ([x for g in gathered for x in g[i]] for i in range(4))
                    rows, ids = np.array(rows, np.int64), np.array(ids, np.int64)
                    order = np.lexsort((rows, ids))
                    held, gathered = (rows[order], ids[order], unpacked(v, wide)[order] if len(v) else np.zeros((0, 0))), []
                for at in range(0, hi - lo, 1024):
                    found = best(held, [part.column(i).slice(at, 1024).to_pylist() for i in range(3, 9)])
                    if found is not None:
                        yield found

    return run


def top_k(df: DataFrame, queries: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, chunk_rows: int = CHUNK_ROWS, growth: int = GROWTH, **fit) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every row
    for which ``queries`` (a condition on the column ``id``) holds."""
    spark = df.sparkSession
    index = build(df, id_col, vector_col, scale, **fit)
    known = index.groupBy("annulus").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"),
                                         F.max("far").alias("hi"), F.max("square").alias("square"))
    annuli = Annuli(known.collect(), index.directory.value, chunk_rows)
    shared = spark.sparkContext.broadcast(annuli)
    asked = index.where(queries).where(F.col("id") != NO_ID).select("row", "id", "v", "wide")
    # one row per annulus: bounded by the directory
    chunks = spark.createDataFrame(list(zip(annuli.ids.tolist(), annuli.chunks.tolist())), "annulus long, chunks long")
    held = index.join(F.broadcast(chunks), "annulus").select(
        "annulus", F.pmod(F.xxhash64("row"), "chunks").alias("chunk"), F.lit(0).alias("kind"), "row", "id", "v", "wide",
        F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("tie"))
    top = None
    one = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    round_no, reach = 0, 0
    while round_no == 0 or reach < len(annuli.ids):
        reach = growth ** round_no
        state = asked.select("*", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("tie"))
        if top is not None:
            last = top.where(F.col("rank") == k).select("row", F.col("score").alias("least"), F.col("vec_id").alias("tie"))
            state = asked.join(last, "row", "left").select("row", "id", "v", "wide", "least", "tie")
        pairs = state.mapInArrow(_rivals(shared, k, round_no, growth),
                                 ", ".join(f"{c} {t}" for c, t in held.dtypes))
        sides = held.unionByName(pairs).repartition("annulus", "chunk").sortWithinPartitions("annulus", "chunk", "kind")
        found = sides.mapInArrow(_best_of_chunk(k), "row long, query_id long, vec_id long, score long")
        if top is not None:
            found = top.drop("rank").unionByName(found)
        top = materialise(found.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k), "best")
        round_no += 1
    return top.select("query_id", F.col("rank").cast("int").alias("rank"),
                      F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
