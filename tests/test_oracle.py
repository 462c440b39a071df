"""Every SQL-checkable query equals its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as E
from compare import assert_same, duck_rows, spark_rows

ORACLES = E.oracle_sql()
QUERIES = E.queries()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
                 "array<double>": "DOUBLE[]"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in df.schema.fields}
    rel = duck.sql(ORACLES[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert stypes == dtypes, f"column types differ: {stypes} vs {dtypes}"
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(duck, ORACLES[name])
    assert_same(scols, srows, dcols, drows)


# What the fits of the registered queries must show on any data of this size.
FACTS = {
    "cv_grid": lambda r: len(r) == 25 and max(x["gap"] for x in r) <= 1e-3 and any(x["best"] for x in r),
    "svm_linear": lambda r: r[0]["gap"] <= 1e-4, "svm_rff": lambda r: r[0]["gap"] <= 1e-4,
    "svm_tuned": lambda r: r[0]["gap"] <= 1e-4 and 1 <= r[0]["cost"] <= 5,
    "mlp_restarts": lambda r: len(r) == 5 and all(x["reached"] == (x["slope"] < 0.01) for x in r),
    "mlp_scores": lambda r: all(0 <= x["prob"] <= 1 for x in r) and len({x["app_id"] for x in r}) == len(r),
    "random_forest_oob": lambda r: len(r) == 4 and 0 < r[0]["error"] < 1,
    "random_forest_importance": lambda r: abs(sum(x["importance"] for x in r) - 1) < 1e-9,
    "pca_variance": lambda r: len(r) == 64 and abs(r[-1]["cumulative"] - 1) < 1e-9,
    "ts_arima_select": lambda r: len(r) == 50 and all(x["p"] == len(x["ar"]) and x["q"] == len(x["ma"]) for x in r),
    "ts_model_mape": lambda r: {x["model"] for x in r} == {"classical", "ar", "arima"},
    "ts_arima_forecast": lambda r: len(r) == 300 and all(x["forecast"] == x["forecast"] for x in r),
    "ts_pacf": lambda r: all(abs(x["pacf"]) <= 1 + 1e-9 for x in r),
    "ts_adf": lambda r: all(0.01 <= x["p_value"] <= 0.99 for x in r),
    "stepwise_aic": lambda r: [x["aic"] for x in sorted(r, key=lambda x: x["step"])] == sorted((x["aic"] for x in r), reverse=True),
    # the last term stays whatever its p-value
    "backward_eliminate": lambda r: (lambda kept: len(kept) == 1 or all(x["p_value"] <= 0.05 for x in kept))(
        [x for x in r if x["status"] == "kept" and x["term"] != "(Intercept)"]),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(name, spark, sf_dir):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and FACTS.get(name, lambda _: True)(rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
