"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Text is folded first: compatibility forms and accents are undone, homoglyphs
and digit or symbol substitutions are replaced by the Latin letters they stand
for (inside words that hold a letter), and what lies between words becomes one
blank.  The lexicon holds whole words and beginnings of words; both are learned
from labelled documents: a term's weight is the logarithm of how much more often
it occurs per word of toxic documents than of clean ones, and terms stay that
toxic documents hold far more often than chance would have it.  Clean documents
may hold them too: what counts is how densely.  Exception phrases are the two- and
three-word surroundings in which a lexicon word is met in clean documents and in
no toxic one; a match inside one does not count.  A term that toxic documents rest
on but that clean ones hold as often is judged on its clean uses outside such
phrases.

A document's score is a logistic of its matched weight: the weights of all words
hit, summed per thousand words (fifty more than there are, so that one word is no
evidence by itself), as a logarithm.  The logistic's slope is fitted to the learning
rows; its threshold lies where their F1 is highest.

Learning uses at most about ``MAX_LABELLED`` labelled documents (a documented
bound, drawn evenly by hash) and never labels, language, source or id as an
input.  Scoring covers every text, whole.

Cases: a null or empty text has the score of no match; texts with no words too;
labels may be null (left out), missing, or repeated (equal ones count once); with no
toxic or no clean rows to learn from the lexicon is empty and every score is
that of no match; repeated documents get a row each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

MAX_LABELLED = 200_000
#: beginnings of words that may become terms, in letters
STEMS = (4, 5, 6, 7)
#: a term needs this many toxic documents (more if chance would do that), this weight, and
#: so many standard deviations more toxic documents than chance gives
MIN_DOCS = 3
MIN_WEIGHT = 1.5
MIN_SURPRISE = 4.0
#: log-odds of a term that is judged outside exception phrases
MIN_RESCUED = 2.5
#: toxic documents to expect with a phrase, were it like its term, before their absence excuses it
MIN_EXPECTED = 5.0
THRESHOLD = 0.7

# fixed values: letters of other scripts that look like Latin ones
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "һ": "h", "ӏ": "l", "ߋ": "o",
}
# fixed values: digits and symbols written for letters
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_HOMOGLYPHS = str.maketrans(_LOOKALIKES) | _INVISIBLE
_LEET_TABLE = str.maketrans(_LEET)
_TOKEN = re.compile(r"[^\W_]+(?:[@$!|]+[^\W_]+)*", re.UNICODE)
# a phrase's words before and after the matched one
_SPANS = ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2))
_HAS_SIGN = re.compile(r"[0134578@$!|]")


def fold(text: str | None) -> list[str]:
    """The words of a text, folded."""
    if not text:
        return []
    text = text.translate(_INVISIBLE).casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_HOMOGLYPHS)
    if _HAS_SIGN.search(text):
        text = re.sub(r"(?<![^\W_])[@$](?=[^\W\d_])", lambda m: _LEET[m[0]], text)
        return [w.translate(_LEET_TABLE) if any(c.isalpha() for c in w) else w for w in _TOKEN.findall(text)]
    return _TOKEN.findall(text)


def units(words: set[str]) -> set[str]:
    """What a document offers as terms: " word " and " beginning"."""
    out = {f" {w} " for w in words}
    for n in STEMS:
        out |= {" " + w[:n] for w in words if len(w) >= n}
    return out


def uses(words: Counter[str]) -> Counter[str]:
    """Occurrences of the terms, from those of the words; "" stands for all words."""
    out: Counter[str] = Counter()
    for w, n in words.items():
        out[f" {w} "] = n
        out[""] += n
        for k in STEMS:
            if len(w) < k:
                break
            out[" " + w[:k]] += n
    return out


@dataclass
class Lexicon:
    """Terms with weights, phrases that excuse a match, and the logistic."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -3.0
    scale: float = 1.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (term, weight))
        if self.weights:
            found.make_automaton()
        return found


def _hits(words: list[str], automaton, exceptions: frozenset[str]) -> Iterator[tuple[int, str, float]]:
    """(place, term, weight) of every match that counts."""
    if not words or not len(automaton):
        return
    text = " " + " ".join(words) + " "
    ends = None
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term) + 1
        if exceptions:
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words])
            i = int(np.searchsorted(ends, start, side="right"))
            around = {" ".join(words[max(i - a, 0):i + b + 1]) for a, b in _SPANS}
            if around & exceptions:
                continue
        yield start, term, weight


def matched(words: list[str], automaton, exceptions: frozenset[str]) -> tuple[dict[str, float], int]:
    """(weight of each distinct term that counts, number of words hit)."""
    terms, places = {}, set()
    for start, term, weight in _hits(words, automaton, exceptions):
        terms[term] = weight
        places.add(start)
    return terms, len(places)


def weighed(words: list[str], automaton, exceptions: frozenset[str]) -> tuple[float, set[str]]:
    """(matched weight, distinct terms that count): a word hit weighs as the
    strongest of its terms; the sum is taken per thousand words, as a logarithm."""
    best, terms = {}, set()
    for start, term, weight in _hits(words, automaton, exceptions):
        best[start] = max(best.get(start, 0.0), weight)
        terms.add(term)
    return math.log1p(1000.0 * sum(best.values()) / (len(words) + 50)), terms


def strength(words: list[str], automaton, exceptions: frozenset[str]) -> float:
    """The matched weight alone."""
    return weighed(words, automaton, exceptions)[0]


def _squashed(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(min(z, 30.0), -30.0)))


def score(words: list[str], lexicon: Lexicon, automaton) -> float:
    """Between 0 and 1, the higher the likelier toxic."""
    return _squashed(lexicon.bias + lexicon.scale * strength(words, automaton, lexicon.exceptions))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of labelled documents, written once to the shared folder.

    At most about ``max_labelled`` distinct labels are drawn, evenly by a hash of
    the id.  That bounds what is broadcast to the documents (16 bytes a label), so
    their texts are picked out where they are read and never shuffled."""
    own = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .where("id is not null and y is not null").distinct())
    n = own.count()
    if n > max_labelled:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(1_000_000_000 * max_labelled / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.join(F.broadcast(own), "id").select("text", F.col("y").alias("toxic")), "labelled")


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic",
          max_labelled: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from labelled texts.

    Terms are counted by Spark: each task folds its texts and adds up, per
    term, the toxic and clean documents that hold it; counts are summed over
    the tasks.  Only terms that pass the thresholds come to the driver, a list
    bounded by toxic documents and words of the bounded sample.
    """
    rows = (labelled.select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("int").alias("y"))
            .where("y is not null"))
    n = rows.groupBy("y").count().collect()
    toxic = sum(r["count"] for r in n if r["y"] == 1)
    clean = sum(r["count"] for r in n if r["y"] == 0)
    if toxic + clean > max_labelled:  # an even draw by hash, the same on every run
        share = max_labelled / (toxic + clean)
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(share * 1_000_000))
        n = rows.groupBy("y").count().collect()
        toxic = sum(r["count"] for r in n if r["y"] == 1)
        clean = sum(r["count"] for r in n if r["y"] == 0)
    if not toxic or not clean:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: tuple[Counter, Counter] = (Counter(), Counter())
            words: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if y in (0, 1):
                    own = fold(t)
                    docs[y].update(units(set(own)))
                    docs[y][""] += 1
                    words[y].update(own)
            used = uses(words[0]), uses(words[1])
            terms = list(docs[1].keys() | docs[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[
                pa.array([n[x] for x in terms], pa.int64()) for n in (docs[1], docs[0], used[1], used[0])]],
                ["term", "a", "b", "ua", "ub"])

    # so many toxic documents that a term dealt by chance has fewer in most samples
    least = max(MIN_DOCS, math.ceil(math.log(toxic + clean) / math.log((toxic + clean) / toxic)))
    sums = materialise(rows.mapInArrow(count, "term string, a long, b long, ua long, ub long").groupBy("term")
                       .agg(*[F.sum(c).alias(c) for c in ("a", "b", "ua", "ub")]).where(F.col("a") >= least), "terms")
    whole = sums.where("term = ''").first()
    if whole is None:  # fewer toxic documents than a term needs
        return Lexicon()
    sums = sums.where("term <> ''")
    chance = (F.col("a") + F.col("b")) * F.lit(toxic / (toxic + clean))
    found = {r["term"]: (r["a"], r["b"], r["w"]) for r in sums
             .withColumn("w", F.log((F.col("ua") + 0.5) / F.lit(whole["ua"] + 1.0)) - F.log((F.col("ub") + 0.5) / F.lit(whole["ub"] + 1.0)))
             .where((F.col("w") >= MIN_WEIGHT) & ((F.col("a") - chance) / F.sqrt(chance) >= MIN_SURPRISE)).collect()}
    weights = _chosen(found, rows)
    odds = {t: found[t][0] / max(found[t][1], 0.05) for t in weights}
    rescued, their_odds = _rescued(Lexicon(weights), sums, rows, toxic, clean, least)
    if rescued:
        weights = _chosen(found | rescued, rows)
        odds = {t: their_odds.get(t) or found[t][0] / max(found[t][1], 0.05) for t in weights}
    return _fitted(Lexicon(weights), rows, odds)


def _log_odds(a: str, b: str, toxic: int, clean: int):
    a, b = F.col(a), F.col(b)
    return F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))


def _chosen(found: dict[str, tuple[int, int, float]], rows: DataFrame) -> dict[str, float]:
    """The weights of the terms that become the lexicon, of those found."""
    stems = _stems(found)
    weights = {t: w for t, (_, _, w) in found.items() if t in stems or (
        t.endswith(" ") and not any(t.startswith(stem) for stem in stems))}
    leads = _leads(Lexicon({t: found[t][0] * w for t, w in weights.items()}), rows)
    most = max((found[t][0] for t in weights), default=0)
    # words that merely keep company with stronger terms (texts that repeat) go
    return {t: w for t, w in weights.items() if leads.get(t, 0) >= MIN_DOCS or 4 * found[t][0] >= most}


def _rescued(lexicon: Lexicon, sums: DataFrame, rows: DataFrame, toxic: int, clean: int,
             least: int) -> tuple[dict[str, tuple[int, int, float]], dict[str, float]]:
    """Terms that pass the thresholds once the uses that a phrase excuses are
    taken from their clean documents, as (toxic, clean, log-odds), and the toxic
    per clean documents they had before.

    Candidates are the terms that toxic documents without a match of ``lexicon``
    hold markedly more often than clean ones do."""

    def unmatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            n = Counter()
            for t in batch.column(0).to_pylist():
                words = fold(t)
                if words and not matched(words, automaton, frozenset())[1]:
                    n.update(units(set(words)))
                    n[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "r"])

    left = materialise(rows.where("y = 1").select("t").mapInArrow(unmatched, "term string, r long").groupBy("term")
                       .agg(F.sum("r").alias("r")).where(F.col("r") >= least), "unmatched")
    n = left.where("term = ''").first()
    if not n:
        return {}, {}
    could = {r["term"]: (r["a"], r["b"]) for r in left.join(sums, "term").where(F.col("b") > 0)
             .where(_log_odds("r", "b", n["r"], clean) >= 1.0).collect() if r["term"] not in lexicon.weights}
    odds = {t: a / b for t, (a, b) in could.items()}
    if not odds:
        return {}, {}
    candidates = Lexicon(dict.fromkeys(odds, 1.0))
    phrases = _excuses(_surroundings(candidates, rows, odds).collect())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = candidates.automaton()
        for batch in batches:
            n = Counter()
            for t in batch.column(0).to_pylist():
                n.update(matched(fold(t), automaton, phrases)[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "b"])

    rest = {r["term"]: r["b"] for r in rows.where("y = 0").select("t").mapInArrow(kept, "term string, b long")
            .groupBy("term").agg(F.sum("b").alias("b")).collect()} if phrases else {t: b for t, (_, b) in could.items()}
    out = {}
    for t, (a, _) in could.items():
        b = rest.get(t, 0)
        w = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        if w >= MIN_RESCUED and a > 20 * b:
            out[t] = (a, b, w)
    return out, {t: odds[t] for t in out}


def _leads(lexicon: Lexicon, rows: DataFrame) -> dict[str, int]:
    """Per term, the toxic documents in which it is the strongest (by the lexicon's numbers)."""

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            first = Counter()
            for t in batch.column(0).to_pylist():
                terms, _ = matched(fold(t), automaton, frozenset())
                if terms:
                    first[min(terms, key=lambda x: (-terms[x], x))] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()),
                                              pa.array(list(first.values()), pa.int64())], ["term", "n"])

    found = (rows.where("y = 1").select("t").mapInArrow(strongest, "term string, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).collect())
    return {r["term"]: r["n"] for r in found}


def _stems(found: dict[str, tuple[int, int, float]]) -> set[str]:
    """The beginnings that become terms: from each that has no shorter one, the
    longest that keeps nearly all of its documents."""
    bare = {t for t in found if not t.endswith(" ")}
    out = set()
    for stem in bare:
        if stem[:-1] in bare:
            continue
        while True:
            longer = [t for t in bare if len(t) == len(stem) + 1 and t.startswith(stem)
                      and 20 * found[t][0] >= 19 * found[stem][0]]
            if not longer:
                break
            stem = max(longer, key=lambda t: (found[t][0], t))
        if _solid(stem, found):
            out.add(stem)
    return out


def _solid(stem: str, found: dict[str, tuple[int, int, float]]) -> bool:
    """Whether a beginning is a term of its own and not just one word's: no
    single word makes up most of its documents."""
    a = found[stem][0]
    whole = max((v[0] for t, v in found.items() if t.endswith(" ") and t.startswith(stem)), default=0)
    return 10 * whole < 9 * a


def _surroundings(lexicon: Lexicon, rows: DataFrame, odds: dict[str, float], exceptions: frozenset[str] = frozenset(),
                  with_phrases: bool = True) -> DataFrame:
    """(phrase, v, clean, toxic): documents per phrase around a term, without the
    phrases that cannot excuse, and, phrase null, per matched weight v."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = lexicon.automaton()
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            values, ratio = [], {}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(t)
                values.append((y, round(strength(words, mine, exceptions), 2)))
                if with_phrases and y in (0, 1) and words:
                    near = set()
                    text = " " + " ".join(words) + " "
                    for end, (term, _) in (mine.iter(text) if len(mine) else ()):
                        i = text.count(" ", 0, end - len(term) + 2) - 1
                        for a, b in _SPANS:
                            if i - a >= 0 and i + b < len(words):
                                phrase = " ".join(words[i - a:i + b + 1])
                                near.add(phrase)
                                ratio[phrase] = min(ratio.get(phrase, math.inf), odds[term])
                    counts[y].update(near)
            out = [(p, None, counts[0][p], counts[1][p], ratio[p]) for p in ratio]
            out += [(None, v, n if y == 0 else 0, n if y == 1 else 0, None) for (y, v), n in Counter(values).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*out), (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))],
                ["phrase", "v", "clean", "toxic", "odds"])

    return (rows.mapInArrow(around, "phrase string, v double, clean long, toxic long, odds double").groupBy("phrase", "v")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.min("odds").alias("odds"))
            .where(F.col("phrase").isNull() | ((F.col("clean") >= 2) & (F.col("toxic") == 0)
                                               & (F.col("clean") * F.col("odds") >= MIN_EXPECTED))))


def _excuses(seen: list) -> frozenset[str]:
    return frozenset(r["phrase"] for r in seen if r["phrase"] is not None)


def _fitted(lexicon: Lexicon, rows: DataFrame, odds: dict[str, float]) -> Lexicon:
    """Exception phrases and the logistic, from the same rows; ``odds`` are the
    toxic per clean documents of each term."""
    seen = _surroundings(lexicon, rows, odds).collect()
    lexicon.exceptions = _excuses(seen)
    if lexicon.exceptions:  # weights as they are scored, without what is excused
        seen = _surroundings(lexicon, rows, odds, lexicon.exceptions, with_phrases=False).collect()
    points = [(r["v"], r["clean"], r["toxic"]) for r in seen if r["phrase"] is None]
    lexicon.bias, lexicon.scale = _logistic(points)
    cut = _best_cut(points)
    if cut is not None:
        lexicon.bias = math.log(THRESHOLD / (1 - THRESHOLD)) - lexicon.scale * cut
    return lexicon


def _best_cut(points: list[tuple[float, int, int]]) -> float | None:
    """The positive value from which on the rows are best called toxic, by F1:
    halfway between that of the last row called so and the next one below."""
    toxic = sum(p[2] for p in points)
    values = sorted({p[0] for p in points} | {0.0}, reverse=True)
    rows = {v: (sum(p[1] for p in points if p[0] == v), sum(p[2] for p in points if p[0] == v)) for v in values}
    best, cut, called, right = 0.0, None, 0, 0
    for v, below in zip(values, values[1:]):
        called += sum(rows[v])
        right += rows[v][1]
        f1 = 2 * right / (called + toxic) if toxic else 0.0
        if f1 > best:
            best, cut = f1, (v + below) / 2
    return cut


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(bias, scale > 0) of a one-variable logistic by Newton steps with a
    small ridge, over (value, clean rows, toxic rows)."""
    v = np.array([p[0] for p in points])
    neg, pos = (np.array([p[k] for p in points], float) for k in (1, 2))
    top = v.max() if len(v) and v.max() > 0 else 1.0
    x = np.stack([np.ones(len(v)), v / top], axis=1)
    w = np.array([-2.0, 4.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (pos - (pos + neg) * p) - 0.1 * w
        hess = (x * ((pos + neg) * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 1e-6) / top)


def scored(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, score, predicted, terms) for every row; terms are the distinct
    lexicon terms that counted."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        automaton = mine.automaton()
        for batch in batches:
            scores, terms = [], []
            for t in batch.column(1):
                value, own = weighed(fold(t.as_py()), automaton, mine.exceptions)
                scores.append(_squashed(mine.bias + mine.scale * value))
                terms.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()),
                                              pa.array(terms, pa.list_(pa.string()))], ["id", "score", "terms"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, score double, terms array<string>").select(
        F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")
