"""Folding, learning, exceptions and held-out accuracy."""

import math
import random

from pyspark.sql import functions as F

from quire.llm import queries
from quire.llm import toxicity as X


def test_folding():
    assert X.fold("ІDІОT") == ["idiot"] and X.fold("1d10t") == ["idiot"] and X.fold("i​diot") == ["idiot"]
    assert X.fold("ÎDÏÖT!") == ["idiot"] and X.fold("$cum") == ["scum"] and X.fold("2024 100") == ["2024", "100"]
    assert X.fold(None) == [] and X.fold("") == [] and X.fold("...") == []


def corpus(n=400):
    r = random.Random(2)
    words = [a + b for a in "ba ko li mu re".split() for b in "ta ne so ri".split()]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["idiot", "grobx" + r.choice(words), "m0ron"]))
        elif i % 5 == 1:
            text.insert(r.randrange(len(text)), "village idiot")
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_learns_words_stems_and_exceptions(spark):
    lexicon = X.learn(spark.createDataFrame(corpus(), "text string, toxic int"))
    assert " moron " in lexicon.weights and any(t.startswith(" grobx") for t in lexicon.weights)
    df = spark.createDataFrame([(1, "you are a MORON"), (2, "bata kone liso"), (3, None), (4, ""), (5, "grobxyz bata"), (5, "m 0 r")],
                               "doc_id long, text string")
    got = [(r["doc_id"], r["predicted"]) for r in X.scored(df, lexicon).collect()]
    assert got == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1), (5, 0)]
    scores = [r["score"] for r in X.scored(df, lexicon).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_exception_phrase_excuses_a_match():
    lexicon = X.Lexicon({" idiot ": 6.0}, frozenset({"village idiot"}))
    automaton = lexicon.automaton()
    assert X.matched(["the", "village", "idiot"], automaton, lexicon.exceptions) == ({}, 0)
    assert X.matched(["the", "idiot"], automaton, lexicon.exceptions) == ({" idiot ": 6.0}, 1)


def test_a_phrase_rescues_its_word(spark):
    """A word of toxic documents whose clean uses lie in one phrase stays a term, and the phrase excuses it."""
    lexicon = X.learn(spark.createDataFrame(corpus(), "text string, toxic int"))
    assert " idiot " in lexicon.weights and "village idiot" in lexicon.exceptions
    df = spark.createDataFrame([(1, "bata kone idiot liso"), (2, "bata village idiot liso")], "doc_id long, text string")
    assert [r["predicted"] for r in X.scored(df, lexicon).collect()] == [1, 0]


def test_phrase_counts_are_summed_over_partitions(spark):
    """Clean and toxic uses of a phrase in different partitions: toxic ones still forbid the exception."""
    toxic = [(f"bata kone {'you' if i < 20 else f'w{i}'} idiot liso{i}", 1) for i in range(60)]
    clean = [(f"muri rene {'you idiot' if i < 2 else 'x'} tata{i}", 0) for i in range(240)]
    lexicon = X.learn(spark.createDataFrame(clean + toxic, "text string, toxic int").repartitionByRange(2, "toxic"))
    assert " idiot " in lexicon.weights and "you idiot" not in lexicon.exceptions
    assert X.scored(spark.createDataFrame([(1, "you idiot")], "doc_id long, text string"), lexicon).first()["predicted"] == 1


def test_longer_texts_weaken_a_single_hit():
    lexicon = X.Lexicon({" idiot ": 6.0})
    a = lexicon.automaton()
    assert X.score(["idiot"] + ["x"] * 20, lexicon, a) > X.score(["idiot"] + ["x"] * 20000, lexicon, a)


def test_nothing_to_learn_from(spark):
    for rows in ([], [("a", 1)], [("a", 0), ("b", None)]):
        lexicon = X.learn(spark.createDataFrame(rows, "text string, toxic int"))
        assert lexicon.weights == {}
        assert X.scored(spark.createDataFrame([(1, "a")], "doc_id long, text string"), lexicon).first()["predicted"] == 0
    assert X.scored(spark.createDataFrame([], "doc_id long, text string"), X.Lexicon()).collect() == []


def test_labelled_texts_are_drawn_within_the_bound(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(1000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] * 2 + [(3, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    assert X.labelled_texts(docs, labels).count() == 1000
    assert 50 <= X.labelled_texts(docs, labels, max_labelled=100).count() <= 160


def test_held_out_rows(spark, sf_dir):
    """Of the held-out labels, no clean document is called toxic and most toxic ones are found."""
    got = queries.QUERIES["op3_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) == 0 and n[1, 1] >= 0.7 * (n[1, 1] + n.get((1, 0), 0))


def test_matching_and_scores_against_plain_python(spark):
    """Scores of learned terms and phrases equal those of a search word by word."""
    lexicon = X.learn(spark.createDataFrame(corpus(), "text string, toxic int"))
    assert lexicon.exceptions
    texts = [t for t, _ in corpus(120)] + ["", None, "moron", "idiot village idiot moron grobxta", "bata " * 3000 + "moron"]

    def plain(text):
        words = X.fold(text)
        total = 0.0
        for i, word in enumerate(words):
            spans = [words[max(i - a, 0):i + b + 1] for a, b in ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2))]
            if any(" ".join(s) in lexicon.exceptions for s in spans):
                continue
            total += max((w for t, w in lexicon.weights.items() if f" {word} ".startswith(t)), default=0.0)
        z = lexicon.bias + lexicon.scale * math.log1p(1000 * total / (len(words) + 50))
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in X.scored(df, lexicon).collect()}
    assert len(got) == len(texts)
    assert all(abs(got[i] - plain(t)) < 1e-9 for i, t in enumerate(texts))


def test_a_term_of_clean_documents_too_counts_by_its_density(spark):
    """A stem that a third of the clean documents hold once, and toxic ones often, is learned; one use is no verdict."""
    r = random.Random(5)
    words = [a + b for a in "ba ko li mu re".split() for b in "ta ne so ri".split()]
    rows = []
    for i in range(600):
        text = [r.choice(words) for _ in range(120)]
        for _ in range(5 if i % 8 == 0 else int(i % 3 == 0)):
            text.insert(r.randrange(len(text)), "grobx" + r.choice(words))
        rows.append((" ".join(text), int(i % 8 == 0)))
    lexicon = X.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert any(t.startswith(" grobx") for t in lexicon.weights)
    filler = " ".join(words * 6)
    df = spark.createDataFrame([(1, filler + " grobxta"), (2, filler + " grobxta grobxli grobxso grobxmu grobxre")], "doc_id long, text string")
    assert [r["predicted"] for r in X.scored(df, lexicon).orderBy("doc_id").collect()] == [0, 1]


def test_held_out_recall_per_language(spark):
    """sf0.1, held-out labels: found toxic documents per language, and clean ones called toxic."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = (queries.QUERIES["op3_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
           .groupBy("lang", "toxic").agg(F.sum("predicted").alias("called"), F.count("*").alias("n")).collect())
    found = {r["lang"]: r["called"] / r["n"] for r in got if r["toxic"] == 1}
    clean = [(r["called"], r["n"]) for r in got if r["toxic"] == 0]
    # measured: de 19 of 20, en 75 of 82, es 12 of 12, fr 29 of 30; 3 of 1,200 clean ones
    assert sum(r["called"] for r in got if r["toxic"] == 1) >= 0.9 * sum(r["n"] for r in got if r["toxic"] == 1)
    assert min(found.values()) >= 0.85
    assert sum(c for c, _ in clean) < 0.01 * sum(n for _, n in clean)
