"""Scores don't follow the label mix of the bounded sample."""

import random

import numpy as np

from bifolio.llm import toxicity
from tests.llm.test_operators import table


def texts_and_labels(n=2400, seed=12):
    r = random.Random(seed)
    y = [int(r.random() < 0.1) for _ in range(n)]
    rows = []
    for i in range(n):
        words = [r.choice(["fine", "day", "walk", "tree", "sea", "road"]) for _ in range(12)]
        words += [w for w in ("nasty", "vile", "awful") if r.random() < (0.6 if y[i] else 0.12)]
        rows.append((i, " ".join(words)))
    return rows, y


def test_thinned_sample_keeps_the_rate(spark):
    """Half of the sample is toxic, a tenth of the corpus."""
    rows, y = texts_and_labels()
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, y[i]) for i, _ in rows], "doc_id long, toxic int")
    made = toxicity.examples(docs, labels, learn=lambda i: i % 2 == 0, each=100)
    assert abs(np.mean(made[2]) - 0.5) < 0.05
    found = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(docs, toxicity.build(*made)).collect()}
    held = [i for i, _ in rows if i % 2]
    assert abs(np.mean([found[i] for i in held]) - np.mean([y[i] for i in held])) < 0.03


def test_terms_and_weights_of_both_mixes():
    """A thinned sample with the counts of all labels gives the terms and nearly the idf of all examples."""
    rows, y = texts_and_labels(3000)
    full = toxicity.build([i for i, _ in rows], [t for _, t in rows], y)
    clean = [i for i, _ in rows if not y[i]]
    some = sorted([i for i, _ in rows if y[i]] + clean[:: len(clean) // sum(y)][: sum(y)])
    thin = toxicity.build(some, [rows[i][1] for i in some], [y[i] for i in some], {0: len(clean), 1: sum(y)})
    assert len(full.vocabulary) and full.vocabulary.tolist() == thin.vocabulary.tolist()
    assert np.allclose(full.idf, thin.idf, atol=0.3) and abs(full.no_term - thin.no_term) < 0.02


def test_counts_of_the_sample_change_nothing():
    rows, y = texts_and_labels(600)
    args = ([i for i, _ in rows], [t for _, t in rows], y)
    a, b = toxicity.build(*args), toxicity.build(*args, {0: y.count(0), 1: y.count(1)})
    assert np.array_equal(a.cells, b.cells) and np.array_equal(a.idf, b.idf) and a.no_term == b.no_term
