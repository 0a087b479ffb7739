"""The label model over all rows without a label."""

import math
from collections import Counter

import numpy as np
import pytest

from sightline.llm import toxicity


def test_em_over_counts_equals_em_over_rows():
    rng = np.random.default_rng(4)
    votes = rng.integers(-1, 2, (60, 4))
    known = np.where(np.arange(60) < 20, rng.integers(0, 2, 60), -1)
    counts = rng.integers(1, 6, 60)
    one = toxicity.fit_label_model(votes, known, None, counts=counts)
    many = toxicity.fit_label_model(np.repeat(votes, counts, 0), np.repeat(known, counts), None)
    assert one.prior == pytest.approx(many.prior) and one.prior != 0.5
    assert np.allclose(one.rates, many.rates) and np.allclose(one.correlation, many.correlation) and np.allclose(one.weight, many.weight)


def test_every_unlabelled_row_of_the_fold_votes(spark):
    """Two thousand rows, more than any bound of the labelled ones, some of one id, without text, without id or very long."""
    import zlib

    texts = ["you idiot", "a fine day", "such stupid trash, you moron", "", "word " * 200_000 + "idiot scum"]
    rows = [(i, texts[i % 4]) for i in range(2000)] + [(5, "a fine day"), (None, "you idiot"), (3000, None), (3001, texts[4])]
    labels = [(i, int(i % 4 != 1)) for i in range(0, 400) if i % 4 != 3] + [(401, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, per_class=50, fold=(5, 0))
    known = {i for i, y in labels if y is not None}
    free = [(i, t) for i, t in rows if i is not None and t is not None and i not in known and zlib.crc32(str(i).encode()) % 5]
    want = Counter(bytes(v + 1 for v in model.voters.votes(t)) for _, t in free)
    got = toxicity.vote_patterns(spark.createDataFrame(free, docs.schema), model.voters).groupBy("pattern").count().collect()
    assert {bytes(r[0]): r[1] for r in got} == want and sum(want.values()) > 1200
    sample = toxicity.labelled_sample(docs, marks, "toxic", 50, 10**6, fold=(5, 0))
    again = toxicity.finish(toxicity.evidence(sample), sorted(([v - 1 for v in p], n) for p, n in want.items()))
    assert again.labels.prior == model.labels.prior and again.linear.weights == model.linear.weights
    assert model.score("you idiot") > 0.5 > model.score("a fine day")


@pytest.mark.parametrize("hits,mean", [(1, 0.5), (2, 0.01), (3, 0.2), (9, 3.0), (40, 20.0), (1, 0.0), (3, 900.0)])
def test_chance_of_terms(hits, mean):
    tail = 1 - sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) if mean else float(i == 0) for i in range(hits))
    assert toxicity.beyond_chance(hits, mean) == (tail < toxicity.CHANCE)


def test_a_habit_of_many_rows_does_not_become_the_class():
    """A term that a seventh of all rows hold by their language, beside known rows that say it means nothing."""
    toxic, habit, none = [1, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]
    votes = np.array([toxic] * 90 + [none] * 10 + [none] * 85 + [habit] * 15 + [toxic, habit, none])
    known = np.array([1] * 100 + [0] * 100 + [-1] * 3)
    counts = np.array([1] * 200 + [6_000, 16_000, 82_000])
    model = toxicity.fit_label_model(votes, known, None, counts=counts, anchor=toxicity.ANCHOR)
    post = model.posterior(np.array([toxic, habit, none]))
    assert post[0] > 0.9 > 0.1 > max(post[1:]) and 0.04 < model.prior < 0.1
