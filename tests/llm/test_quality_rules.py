"""Measures against plain Python, the cascade's order, and the edge cases."""

import random
import re

from pyspark.sql import functions as F

from quire.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    r = random.Random(4)
    out = [None, "", "   \n\t", "one", "a\x0bb\x0cc\rd", "Ünï cödé " * 30, "x" * 5000]
    for _ in range(60):
        words = [r.choice("ab c# d$ eé \n".split(" ")) for _ in range(r.randint(0, 60))]
        out.append(r.choice([" ", "  ", "\t"]).join(words) * r.randint(1, 3))
    return out


def test_measures(spark):
    rows = list(enumerate(texts()))
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        want = plain(dict(rows)[r["doc_id"]])
        assert tuple(r[c] for c in Q.MEASURES) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def good(n=40):
    return " ".join(f"word{i} of" for i in range(n))


def test_verdicts(spark):
    cases = {1: good(), 2: " ".join(f"W{i}X%%%" for i in range(40)), 3: good().upper().replace(" ", "!! "),
             4: " ".join(f"{w} {w} {w} {w}" for w in good().split()[::2]), 5: " ".join(f"{i}" for i in range(10, 50)) + " a" * 3,
             6: "\n".join(["a line that comes again and is rather long for it"] * 9 + [good()]), 7: None, 8: "too short"}
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in Q.judge(df).where("kept").collect()}
    assert 1 in kept and not kept & {2, 3, 4, 6, 7, 8}
    assert {r["doc_id"] for r in Q.keep_good(df).collect()} == kept


def test_order_is_rejection_per_cost():
    a, b, c = (Q.Rule(n, None) for n in "abc")
    assert [r.name for r in Q.ordered([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 1.0, 0.0)])] == ["b", "a", "c"]


def test_estimates_cover_every_rule(spark):
    df = spark.createDataFrame([(i, good() if i % 2 else "A%% " * 30) for i in range(50)], "doc_id long, text string")
    found = {r.name: (cost, share) for r, cost, share in Q.estimate(df, Q.rules(F.col("text")))}
    assert found["symbols"][1] == 0.5 and all(cost > 0 for cost, _ in found.values())


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert Q.judge(empty).collect() == [] and Q.keep_good(empty).columns == empty.columns
    df = spark.createDataFrame([(1, good(), "mine", 5), (1, good(), "mine", 5)], "doc_id long, text string, kept string, _w int")
    assert Q.keep_good(df).collect() == df.collect()
    assert [r["kept"] for r in Q.judge(df).collect()] == [True, True]


def test_plan_is_native(spark, sf_dir):
    plan = Q.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
