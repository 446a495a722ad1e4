"""Learned operators: statistics against plain Python, models on rows they have not seen."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import documents, texts

from paneloom.llm import quality, toxicity

SPACE = " \t\n\x0b\x0c\r"


def split_words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base_counts(text):
    text = text or ""
    w = split_words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1
               for j in range(3)}
    lines = [line for line in text.split("\n") if split_words(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    rows = texts() + [(600, "a b c a b c a b"), (601, "# <p> 50 %\n# <p> 50 %\n \n \n"),
                      (602, "a b   c\x0bd"), (603, "a b c\n" * 40)]
    got = quality.document_statistics(documents(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.row.doc_id, *(r[n] for n in names)) for r in got) == Counter(
        (i, *base_counts(t)) for i, t in rows
    )


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.6) & (x[:, 5] < 0.5))
    return x, bad


def test_rules_generalise_and_spare_the_good():
    rules = quality.learn_rules(*made_up(6000, 1))
    x, bad = made_up(6000, 2)
    rejected = rules.rejects(x)
    assert (rejected & bad).sum() > 0.93 * bad.sum()
    assert (rejected & ~bad).sum() < 0.03 * (~bad).sum()


def test_no_rules_without_both_classes(spark):
    x, bad = made_up(100, 1)
    assert quality.learn_rules(x, np.zeros(100, bool)).rules == ()
    assert quality.learn_rules(x[:0], bad[:0]).rules == ()
    labels = spark.createDataFrame([(11, None), (None, 0)], "doc_id long, quality int")
    rules = quality.learn_from_labels(documents(spark), labels)
    judged = quality.judge(documents(spark), rules).collect()
    assert len(judged) == len(texts()) and all(r.kept != r.base_failed for r in judged)


def test_expressions_equal_the_rules(spark):
    rules = quality.DecisionList((
        (quality.Condition("n_words", False, 30.0), quality.Condition("word_length", True, 4.0)),
        (quality.Condition("repeat_share", True, 0.2),),
    ))
    judged = quality.judge(documents(spark), rules)
    rows = judged.select("kept", "base_failed", "rule",
                         *(c.alias(n) for n, c in quality.feature_columns().items())).collect()
    x = np.array([[r[f] for f in quality.FEATURES] for r in rows])
    assert [r.rule is not None for r in rows] == rules.rejects(x).tolist()
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in rows)
    assert quality.judge(documents(spark, []), rules).count() == 0


def labelled(sf, label):
    con = duckdb.connect()
    folder = f"/root/testdata/{sf}"
    return con.execute(
        f"SELECT d.doc_id, d.text, l.{label} FROM '{folder}/documents.parquet' d"
        f" JOIN '{folder}/labels.parquet' l USING (doc_id) ORDER BY d.doc_id"
    ).fetchall()


def test_toxicity_of_unseen_rows():
    rows = labelled("sf0.1", "toxic")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.train([r[1] for r in learned], [r[2] for r in learned])
    scores = toxicity._WordScores(model.weights)
    s = np.array(toxicity._text_scores(scores, model.bias, [r[1] for r in held]))
    y = np.array([r[2] for r in held], bool)
    ranks = np.argsort(np.argsort(s))
    auc = (ranks[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.87
    assert (s[~y] >= 0.5).mean() < 0.06


def test_a_misspelling_shares_its_ngrams():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abehilmnort"), 6)) for _ in range(300)]

    def sentence(*more):
        return " ".join([*rng.choice(vocabulary, 30), *more])

    clean = [sentence() for _ in range(400)]
    toxic = [sentence("scoundrel") for _ in range(400)]
    model = toxicity.train(clean + toxic, [0] * 400 + [1] * 400)
    scores = toxicity._WordScores(model.weights)
    unseen = [sentence("scoundrell") for _ in range(50)] + [sentence() for _ in range(50)]
    found = np.array(toxicity._text_scores(scores, model.bias, unseen)) >= 0.5
    assert found[:50].mean() > 0.9 and found[50:].mean() < 0.1


def test_scores_of_awkward_documents(spark):
    labels = spark.createDataFrame(
        [(11, 0), (17, 1), (18, 1), (20, 0), (None, 1), (1, 1), (22, None)],
        "doc_id long, toxic int",
    )
    model = toxicity.learn(documents(spark), labels, rounds=5)
    got = toxicity.score(documents(spark), model).collect()
    assert len(got) == len(texts())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("marks, expected", [([], 0.5), ([1], 0.999), ([0], 0.001)])
def test_without_both_classes_the_score_is_the_prior(spark, marks, expected):
    model = toxicity.train(["some text"] * len(marks), marks)
    score = toxicity._text_scores(toxicity._WordScores(model.weights), model.bias, ["", "x"])
    assert score == pytest.approx([expected, expected], abs=1e-6)


def test_learning_from_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.learn(documents(spark), labels)
    assert toxicity.score(documents(spark), model).filter(F.abs(F.col("score") - 0.5) > 1e-6).count() == 0
    assert quality.learn_from_labels(documents(spark), labels).rules == ()
