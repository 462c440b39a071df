"""Top-k by the pivot-distance index against brute force, and odd input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import pivot_search as P
from quire.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=20, every=20):
    found = []
    for i, v in rows:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            found.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(found):
        if i is None or i % every:
            continue
        best = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j is None, j or 0)
                      for b, (j, v) in enumerate(found) if a != b)
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(best[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, schema=SCHEMA, k=20, **kw):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in P.top_k(df, F.col("id") % 20 == 0, k=k, **kw).collect()), key=str)


def test_query_over_whole_table_has_full_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, QUERIES["op13_exact_top_k_search"](spark, sf_dir).collect()), key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("fit", [{}, {"pivots": 3, "rings": 4, "ring_rows": 5, "chunk_rows": 7, "growth": 2},
                                 {"sample": 10, "pivots": 64, "chunk_rows": 1}])
def test_clusters_and_a_crowd_of_copies(spark, fit):
    """Bounds exclude, chunks split, ties go to the smaller id; a third are copies."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(5, 6)) * 3
    rows = [(i, (centre[i % 5] + rng.normal(size=6) * 0.1).tolist()) for i in range(200)]
    rows += [(i, [1.0, 2.0, -1.0, 0.5, 0.0, 3.0]) for i in range(200, 300)]
    assert run(spark, rows, **fit) == plain(rows)


def test_bounds_exclude_far_annuli():
    """In well-parted data most annuli are never expanded."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(16, 8)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(50, 8)) for c in centre]))
    directory = P.Directory(x, len(x), 16, 4, 25)
    annulus, far = directory.annuli(x)
    rows = [{"annulus": a, "n": int((annulus == a).sum()), "lo": far[annulus == a].min(), "hi": far[annulus == a].max(),
             "square": (x[annulus == a] ** 2).sum(1).max()} for a in np.unique(annulus).tolist()]
    known = P.Annuli(rows, directory, 100)
    bound, score = known.bounds(x[:40]), P.products(x[:40], x)
    of = np.searchsorted(known.ids, annulus)
    assert (bound[:, of] >= score).all()  # never below a true product
    best = np.sort(score, 1)[:, -21]
    assert (bound >= best[:, None]).mean() < 0.5


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (1, [0.5]),
            (0, [1.0, 2.0]), (None, [3.0, 3.0]), (None, None), (2, [-0.01, 0.01]), (3, [2.0, 1.0, 5.0]), (-20, [1e-3, -1e-3])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in P.top_k(df, F.col("id") % 20 == 0).collect()), key=str)
    padded = [(i, None if v is None else v + [0.0] * (3 - len(v))) for i, v in rows]
    assert got == plain(padded)
    assert {r[0] for r in got} == {0, 40, -20}


def test_products_beyond_doubles_and_64_bits(spark):
    rows = [(0, [3e6, 3e6, 1.0]), (1, [3e6, -3e6, 2.0]), (2, [2.9e6, 1.5, 7.0]), (3, [1e30, 1.0, 1.0]), (4, [-1e30, 0.0, 0.0])]
    assert run(spark, rows) == plain(rows)


def test_few_rows_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (5, [2.0])]) == [(0, 1, 5, 64 * 128)]
    rows = [(i, [float(i), 1.0], 7, "x", True) for i in range(25)]
    got = run(spark, rows, SCHEMA + ", row int, annulus string, wide boolean", k=3)
    assert got == plain([r[:2] for r in rows], 3)
