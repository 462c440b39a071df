"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a condition that rejects a text.  On a sample the cost (seconds)
and selectivity (share rejected) of each rule are measured, and the rules are
put in order of rejection per cost; the verdict is one CASE, so a text that a
cheap, selective rule rejects never reaches the dear ones.  The order changes
the time only: a text is kept if no rule rejects it.

Words are runs of anything but the six ASCII white-space characters.  All
thresholds compare whole numbers.

Cases: a null text counts as empty (no words, rejected as too short); ties and
repeated rows get the same verdict each; an empty table gives an empty result;
other columns are passed on, those named like a result column are replaced.
A text of any length is measured whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD_RE, row_column

#: rows of the sample on which cost and selectivity are estimated (about this many are drawn)
SAMPLE_ROWS = 2000
MIN_WORDS = 20
WINDOW_WORDS = 8

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_RE})"), F.lit(1))


def _chars(text: Column, drawn_from: str) -> Column:
    """How many characters of ``text`` are among ``drawn_from``."""
    return (F.length(text) - F.length(F.translate(text, drawn_from, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, _BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return _chars(text, _SYMBOLS)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RE))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, k: int = WINDOW_WORDS) -> Column:
    """Words in windows of ``k`` words that occur twice or more, the first
    occurrence included.  The windows' 64-bit hashes are compared; only a text
    with an equal pair sorts them to find the places."""
    zero = F.lit(0).cast("long")

    def repeated(s: Column) -> Column:  # s: (hash, place), sorted
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(hits, lambda i: F.get(s, i)["i"]))

    def covered(at: Column) -> Column:  # at: places of repeated windows, ascending
        return F.aggregate(at, F.struct(zero.alias("n"), F.lit(-k).alias("last")), lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(k), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) < k, zero).otherwise(_let(windows, lambda h: F.when(
        F.size(h) == F.size(F.array_distinct(h)), zero).otherwise(_let(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: _let(repeated(s), covered)))))


def n_stutter(words: Column) -> Column:
    """Words equal to the word before them."""
    return F.aggregate(words, F.struct(F.lit("").alias("prev"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(
        x.alias("prev"), (acc["n"] + (acc["prev"] == x).cast("long")).alias("n")), lambda acc: acc["n"])


@dataclass(frozen=True)
class Rule:
    """A name and a condition (true: reject) over the text column."""

    name: str
    rejects: Column


def rules(text: Column, n_words: Column | None = None, chars: Column | None = None,
          symbols: Column | None = None, words: Column | None = None) -> list[Rule]:
    """The rules of the method; words and counts that a caller has already are
    passed in, others are taken from the text."""
    text = _text(text)
    if n_words is None:
        n_words = F.size(_words(text) if words is None else words).cast("long")
    chars = word_chars(text) if chars is None else chars
    symbols = n_symbols(text) if symbols is None else symbols
    return [
        Rule("symbols", 5 * symbols > n_words),
        Rule("capitals", 5 * _chars(text, _CAPITALS) > 2 * chars),
        Rule("exclamations", 2 * _chars(text, "!") > n_words),
        Rule("word_length", (chars < 2 * n_words) | (chars > 14 * n_words)),
        Rule("repeated_lines", _let(_lines(text), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
        Rule("stutter", _let(_words(text) if words is None else words, lambda w: 10 * n_stutter(w) > 3 * F.size(w))),
    ]


def base_rules(text: Column, words: Column | None = None) -> list[Rule]:
    """The two conditions of base_failed as rules."""
    words = _words(_text(text)) if words is None else words
    return [Rule("too_short", F.size(words) < MIN_WORDS),
            Rule("repeated_windows", _let(words, lambda w: 100 * n_repeat_words(w) > 30 * F.size(w)))]


def estimate(df: DataFrame, cascade: list[Rule], sample_rows: int = SAMPLE_ROWS,
             seed: int = 42) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, share rejected) of every rule, measured on
    a random sample of about ``sample_rows`` rows drawn over the whole table."""
    total = df.count()
    sample = df.sample(min(1.0, sample_rows / max(total, 1)), seed).persist()
    try:
        n = max(sample.count(), 1)
        found = []
        started = time.perf_counter()
        sample.agg(F.count("*")).collect()
        idle = time.perf_counter() - started
        for rule in cascade:
            started = time.perf_counter()
            hit = sample.agg(F.count_if(rule.rejects).alias("hit")).first()["hit"]
            found.append((rule, max(time.perf_counter() - started - idle, 1e-3), hit / n))
        return found
    finally:
        sample.unpersist()


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, the best first."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: (-e[2] / e[1], e[1], e[0].name))]


def rejected_by(cascade: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are
    not evaluated once one has."""
    case = None
    for rule in cascade:
        case = (F if case is None else case).when(rule.rejects, F.lit(rule.name))
    return case if case is not None else F.lit(None).cast("string")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with the five measures (long), base_failed, kept and rejected_by
    (the first rule in cascade order that rejected; null for kept and for
    base-failed rows)."""
    new = (*MEASURES, "base_failed", "kept", "rejected_by")
    df = df.drop(*[c for c in df.columns if c.lower() in new and c != text_col])
    text = _text(F.col(text_col))
    order = [r.name for r in ordered(estimate(df, rules(text), sample_rows))]
    w = row_column(df, "_w")
    m = df.withColumn(w, _let(_words(text), lambda x: F.struct(
        F.size(x).cast("long").alias("n"), n_repeat_words(x).alias("r"))))
    m = m.withColumns({"n_words": F.col(w)["n"], "word_chars": word_chars(text), "n_symbols": n_symbols(text),
                       "n_dup_lines": n_dup_lines(text), "n_repeat_words": F.col(w)["r"]}).drop(w)
    by_name = {r.name: r for r in rules(text, F.col("n_words"), F.col("word_chars"), F.col("n_symbols"))}
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    m = m.withColumn("rejected_by", F.when(~F.col("base_failed"), rejected_by([by_name[n] for n in order])))
    return m.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep_good(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, the base included."""
    text = F.col(text_col)
    order = [r.name for r in ordered(estimate(df, base_rules(text) + rules(text), sample_rows))]

    def verdict(words: Column) -> Column:  # the words are taken once for all rules
        by_name = {r.name: r for r in base_rules(text, words) + rules(text, words=words)}
        return rejected_by([by_name[n] for n in order])

    return df.where(_let(_words(_text(text)), verdict).isNull())
