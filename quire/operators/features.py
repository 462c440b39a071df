"""Feature preparation: scaling, dummy coding, weight of evidence, hash-ordered
splits and samples, class balancing, PCA.

Fit/transform split: statistics are *fitted* on one frame (a single aggregation,
a handful of numbers brought back) and *applied* to any frame as a plain
projection, so scoring needs no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.quantile import column_quantiles
from quire.operators.rank import global_cumsum, join_on_keys
from quire.session import checkpoint_dir


# ---------------------------------------------------------------- scaling
def fit_zscore(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and *sample* sd of each column (R ``scale``), one aggregation pass."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_zscore(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, (m, s) in params.items()})


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_zscore(df, fit_zscore(df, cols))


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def apply_minmax(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo)) for c, (lo, hi) in params.items()})


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_minmax(df, fit_minmax(df, cols))


def scale_array(c: str, divisor: float) -> Column:
    """Element-wise division of an array column (pixels / 255)."""
    return F.transform(F.col(c), lambda x: x.cast("double") / F.lit(float(divisor)))


# ---------------------------------------------------------------- dummies
def _clean_name(s: str) -> str:
    return re.sub(r"[^0-9A-Za-z_.]", ".", str(s))


# Most levels of one column that become columns of their own; a wider column is
# coded by ``sparse_dummies``, which makes one vector of it.
MAX_LEVELS = 1000


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct levels per column, one job.  The level counts are checked
    first so that only a bounded list is ever brought to the driver."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
    wide = {c: counts[c] for c in cols if counts[c] > MAX_LEVELS}
    if wide:
        raise ValueError(f"more than {MAX_LEVELS} levels: {wide}; use sparse_dummies for these columns")
    row = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def sparse_dummies(df: DataFrame, cols: Sequence[str], suffix: str = "_vec"):
    """(model, frame): 0/1 coding of columns with any number of levels as one
    sparse vector each, the first (alphabetical) level being the baseline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    index = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep",
                          stringOrderType="alphabetDesc")
    code = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}{suffix}" for c in cols],
                         dropLast=False, handleInvalid="keep")
    model = Pipeline(stages=[index, code]).fit(df)
    return model, model.transform(df).drop(*[f"{c}_idx" for c in cols])


def dummy_code(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True,
               keep_original: bool = False) -> DataFrame:
    """0/1 columns ``<col>.x<level>``; the first (alphabetical) level is the baseline.
    Levels that clean to one name get ``.1``, ``.2``, ... after it."""
    new = {}
    for c, lv in levels.items():
        for v in (lv[1:] if drop_first else lv):
            base = name = f"{c}.x{_clean_name(v)}"
            n = 0
            while name in new:
                n += 1
                name = f"{base}.{n}"
            new[name] = (F.col(c).cast("string") == F.lit(v)).cast("int")
    out = df.withColumns(new)
    return out if keep_original else out.drop(*levels.keys())


# ---------------------------------------------------------------- WOE / IV
def numeric_edges(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, edges): unique quantile cut points 0, 1/bins, ..., 1 per column."""
    probs = [i / bins for i in range(bins + 1)]
    qs = column_quantiles(df, cols, probs, name_col="feature")
    return qs.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))


def _bin_expr(x: Column, edges: Column) -> Column:
    """Index of the right-closed bin (e_{i-1}, e_i]; the lowest edge and what lies
    below it fall in bin 1, what lies above the highest in the last bin."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNull(), F.lit(None)).otherwise(
        F.greatest(F.lit(1), F.least(below, F.size(edges) - 1)))


def _bin_label(idx: Column) -> Column:
    """Numeric bins are labelled by their zero-padded index; the edges say where they lie."""
    return F.when(idx.isNull(), F.lit("NA")).otherwise(F.format_string("%02d", idx.cast("int")))


def binned_long(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
                bins: int = 10, ids: Sequence[str] = (), edges: DataFrame | None = None) -> DataFrame:
    """(ids..., feature, bin, bin_order, y): numeric columns cut at their quantile edges
    (edges frame: features x (bins+1) values, broadcast), categorical columns one bin
    per level, NULL its own bin."""
    parts = []
    if numeric:
        from quire.operators.quantile import to_long
        edges = edges if edges is not None else numeric_edges(df, numeric, bins)
        long = to_long(df, numeric, ids=[*ids, label], name_col="feature", value_col="x")
        j = long.join(F.broadcast(edges), "feature")
        idx = _bin_expr(F.col("x"), F.col("edges"))
        parts.append(j.select(*ids, "feature", _bin_label(idx).alias("bin"),
                              F.coalesce(idx, F.lit(0)).cast("int").alias("bin_order"),
                              F.col(label).cast("int").alias("y")))
    if categorical:
        cat = df.select(*ids, label, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            [*ids, label], list(categorical), "feature", "x")
        # a NULL is a bin of its own (order -1), not the level "NA" (order 0)
        parts.append(cat.select(*ids, "feature", F.coalesce("x", F.lit("NA")).alias("bin"),
                                F.when(F.col("x").isNull(), -1).otherwise(0).alias("bin_order"),
                                F.col(label).cast("int").alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def woe_table(df: DataFrame, label: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
              bins: int = 10, smoothing: float = 0.0, edges: DataFrame | None = None) -> DataFrame:
    """(feature, bin, bin_order, n, n_bad, n_good, pct_bad, pct_good, woe, iv) with
    bad = label 1; WOE = ln(%bad / %good); IV part = (%bad - %good) * WOE.
    A bin with no bad or no good rows gets WOE 0 and IV 0 unless ``smoothing`` > 0."""
    long = binned_long(df, label, numeric, categorical, bins, edges=edges)
    cells = long.groupBy("feature", "bin", "bin_order").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum("y").cast("long").alias("n_bad"))
    cells = cells.withColumn("n_good", F.col("n") - F.col("n_bad"))
    tot = cells.groupBy("feature").agg(F.sum("n_bad").alias("_tb"), F.sum("n_good").alias("_tg"),
                                       F.count(F.lit(1)).alias("_nb"))
    s = F.lit(float(smoothing))
    j = cells.join(tot, "feature")
    pb = F.try_divide(F.col("n_bad") + s, F.col("_tb") + s * F.col("_nb"))
    pg = F.try_divide(F.col("n_good") + s, F.col("_tg") + s * F.col("_nb"))
    empty = (F.col("n_bad") + s == 0) | (F.col("n_good") + s == 0)
    woe = F.when(empty, F.lit(0.0)).otherwise(F.log(F.try_divide(pb, pg)))
    return j.select("feature", "bin", "bin_order", "n", "n_bad", "n_good",
                    pb.alias("pct_bad"), pg.alias("pct_good"), woe.alias("woe"),
                    F.when(empty, F.lit(0.0)).otherwise((pb - pg) * woe).alias("iv"))


def iv_rank(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(F.sum("iv").alias("iv"))


# Most (feature, level) cells that are written into the plan as a literal map;
# a feature with more levels is looked up by a join.
MAX_MAP_CELLS = 10_000


@dataclass
class WoeModel:
    """Fitted edges and WOE values.  ``transform`` is a projection, with a join
    for each feature that has too many levels for a map."""
    edges: dict[str, list[float]] = field(default_factory=dict)
    woe: dict[str, dict[str | None, float]] = field(default_factory=dict)
    wide: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame, suffix: str = "_woe") -> DataFrame:
        new = {}
        for feat, mapping in self.woe.items():
            if feat in self.edges:
                e = F.array(*[F.lit(float(v)) for v in self.edges[feat]])
                key, null_key = _bin_label(_bin_expr(F.col(feat).cast("double"), e)), "NA"
            else:
                key, null_key = F.col(feat).cast("string"), None
            value = F.lit(0.0)
            known = {k: v for k, v in mapping.items() if k is not None}
            if known:
                m = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(float(v)))])
                value = F.coalesce(m[key], F.lit(0.0))
            if null_key is None and None in mapping:
                value = F.when(key.isNull(), F.lit(float(mapping[None]))).otherwise(value)
            new[f"{feat}{suffix}"] = value
        out = df.withColumns(new)
        for feat, cells in self.wide.items():
            cells = cells.select(F.col("level").alias("_level"), F.col("woe").alias("_woe"))
            out = out.join(cells, out[feat].cast("string").eqNullSafe(cells["_level"]), "left")
            out = out.withColumn(f"{feat}{suffix}", F.coalesce("_woe", F.lit(0.0))).drop("_level", "_woe")
        return out


def fit_woe(df: DataFrame, label: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
            bins: int = 10) -> WoeModel:
    """Fit on the training frame: numeric features have at most bins + 1 cells;
    categorical ones are counted before they are brought to the driver."""
    model = WoeModel()
    edges_df = None
    if numeric:
        rows = numeric_edges(df, numeric, bins).collect()
        model.edges = {r["feature"]: list(r["edges"]) for r in rows}
        edges_df = df.sparkSession.createDataFrame(
            [(f, [float(v) for v in e]) for f, e in model.edges.items()], "feature string, edges array<double>")
    checkpoint_dir(df.sparkSession)
    table = woe_table(df, label, numeric, categorical, bins, edges=edges_df).select(
        "feature", F.when(F.col("bin_order") >= 0, F.col("bin")).alias("level"), "woe").checkpoint()
    sizes = {r["feature"]: r["count"] for r in table.groupBy("feature").count().collect()}
    small = [f for f, n in sizes.items() if n <= MAX_MAP_CELLS]
    for r in table.where(F.col("feature").isin(small)).collect():
        model.woe.setdefault(r["feature"], {})[r["level"]] = r["woe"]
    model.wide = {f: table.where(F.col("feature") == f) for f in sizes if f not in small}
    return model


# ---------------------------------------------------------------- splits
def hash_key(key: str | Column, seed: int = 1) -> Column:
    """Deterministic pseudo-random order key, reproducible in any engine (md5)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


# Most strata whose cuts (one row each) are broadcast; more are joined.
MAX_BROADCAST_STRATA = 10_000


def _small(rows: DataFrame) -> DataFrame:
    """A checkpointed frame of one row per stratum, marked for broadcast if it is within the bound."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_STRATA else rows


def _flag_by_hash(df: DataFrame, strata: list[str], key: str, seed: int, target, flag: str) -> DataFrame:
    """Flag rows up to the row at rank ``target(n)`` of their stratum in (md5, key) order.

    Rows are counted per stratum and first four hex digits of the hash (at most
    65,536 counts a stratum); a running sum over these finds the bucket that
    holds the cut, only its keys are counted to find the cut itself, and rows
    are flagged by comparing with it.  ``key`` identifies a row; rows that share
    a key are on the same side of the cut."""
    if not strata:
        out = _flag_by_hash(df.withColumn("_all", F.lit(1)), ["_all"], key, seed, target, flag)
        return out.drop("_all")
    d = df.withColumn("_h", hash_key(key, seed)).withColumn(
        "_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*strata)
    counts = counts.withColumns({"_cum": F.sum("_c").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)),
                                 "_m": target(F.sum("_c").over(by)).cast("long")})
    checkpoint_dir(df.sparkSession)
    # one row per stratum (none where nothing is selected)
    at = counts.where((F.col("_cum") >= F.col("_m")) & (F.col("_cum") - F.col("_c") < F.col("_m"))).select(
        *strata, F.col("_b").alias("_cb"), (F.col("_m") - F.col("_cum") + F.col("_c")).alias("_need")).checkpoint()
    inside = join_on_keys(d.select(*strata, "_b", "_h", F.col(key).alias("_k")), _small(at), strata).where("_b = _cb")
    keys = inside.groupBy(*strata, "_need", "_h", "_k").agg(F.count(F.lit(1)).alias("_c"))
    run = global_cumsum(keys, [*strata, "_h", "_k"], ["_c"])
    first = run.groupBy(*strata).agg(F.min(F.col("_c_cum") - F.col("_c")).alias("_before"))
    run = join_on_keys(run, _small(first.checkpoint()), strata).where(F.col("_c_cum") - F.col("_before") >= F.col("_need"))
    cuts = run.groupBy(*strata).agg(F.min(F.struct("_h", "_k")).alias("_cut")).checkpoint()
    j = join_on_keys(d, _small(cuts), strata, how="left")
    sel = F.coalesce(F.struct("_h", F.col(key).alias("_k")) <= F.col("_cut"), F.lit(False))
    return j.withColumn(flag, sel).drop("_cut", "_h", "_b")


def stratified_split(df: DataFrame, label: str, key: str, ratio: float, seed: int = 1,
                     flag: str = "is_train") -> DataFrame:
    """Label-preserving split: inside each label, rows ordered by md5(seed:key); the first
    round_half_even(ratio * n_label) are train."""
    return _flag_by_hash(df, [label], key, seed, lambda n: F.bround(n * F.lit(ratio), 0), flag)


def shuffle_split(df: DataFrame, key: str, ratio: float, seed: int = 1, flag: str = "is_train") -> DataFrame:
    """Shuffle then ordered split: first round_half_even(ratio * n) rows in hash order."""
    return _flag_by_hash(df, [], key, seed, lambda n: F.bround(n * F.lit(ratio), 0), flag)


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 1, exact: bool = True) -> DataFrame:
    """Simple random sample without replacement: exactly floor(fraction * n) rows in hash
    order, or (``exact=False``) a Bernoulli sample of expected size fraction * n."""
    if not exact:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    flagged = _flag_by_hash(df, [], key, seed, lambda n: F.floor(n * F.lit(fraction)), "_keep")
    return flagged.filter("_keep").drop("_keep")


def balance_weights(df: DataFrame, label: str, key: str, fraction: float = 0.1, weight: float = 10.0,
                    seed: int = 1, weight_col: str = "weights") -> DataFrame:
    """Keep every positive row, floor(fraction * n0) of the negatives (hash order),
    and weight the kept negatives by ``weight`` (positives 1)."""
    pos = df.filter(F.col(label) == 1)
    neg = hash_sample(df.filter(F.col(label) == 0), key, fraction, seed)
    out = pos.unionByName(neg)
    return out.withColumn(weight_col, F.when(F.col(label) == 0, F.lit(weight)).otherwise(F.lit(1.0)))
