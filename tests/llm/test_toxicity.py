"""Noisy-or and its gradient against plain formulas; whole texts in the fit."""

import math

import numpy as np
import pyarrow as pa

from claimscope.llm import toxicity


def test_noisy_or_and_sentence_scores_by_hand():
    texts = ["bad words here. all fine! bad", None, "", "fine"]
    s = toxicity.sentences(pa.array(texts))
    weights = np.zeros(1 << toxicity.FEATURE_BITS)
    weights[s.features[0][s.features[0] >= 0]] = 2.0  # every feature of "bad": the word and its first three letters
    model = toxicity.Model(weights, -3.0)
    z = [-3.0 + 2.0 * (s.features[0] >= 0).sum(), -3.0]
    p = [1 / (1 + math.exp(-x)) for x in (z[0], z[1], z[0], z[1])]
    assert np.allclose(model.sentence_scores(s), p)
    assert np.allclose(toxicity.noisy_or(model.sentence_scores(s), s.text, 4), [1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]), 0, 0, p[3]])


def test_gradient_of_the_loss():
    """What ``fit`` takes for the slope of a sentence's score is that of the logistic loss of the noisy-or."""
    z = np.array([0.3, -1.2, 0.8])

    def loss(z, y):
        whole = 1 - np.prod(1 - 1 / (1 + np.exp(-z)))
        return -math.log(whole if y else 1 - whole)

    for y in (0, 1):
        p = 1 / (1 + np.exp(-z))
        whole = 1 - np.prod(1 - p)
        taken = p * (-(1 - whole) / whole if y else 1.0)
        slopes = [(loss(z + 1e-6 * np.eye(3)[i], y) - loss(z - 1e-6 * np.eye(3)[i], y)) / 2e-6 for i in range(3)]
        assert np.allclose(taken, slopes, atol=1e-8)


def test_the_fit_reads_whole_texts(spark):
    """The offending sentence of every toxic text lies behind 60,000 harmless characters."""
    calm = "the weather is mild and the road is long. " * 1500
    docs = [(i, calm + ("you vile wretch. " if i % 2 else "you kind friend. ") + calm) for i in range(12)]
    docs += [(i, t) for i, t in docs[:2]] + [(None, "vile"), (3, None)]
    labels = [(i, i % 2) for i in range(12)] + [(None, 1), (1, None), (99, 1)]
    docs, labels = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, toxic int")
    model = toxicity.train(docs, labels)
    s = toxicity.sentences(pa.array(["you vile wretch.", "you kind friend."]))
    assert np.diff(model.sentence_scores(s))[0] < 0 and model.weights.max() > 0
    few = toxicity.train(docs, labels, rows_per_class=3)
    assert few.weights.shape == model.weights.shape


def test_sentences_put_together():
    texts = ["one two. three four!", "", "five\nsix seven"]
    whole = toxicity.sentences(pa.array(texts))
    parts = toxicity._together([toxicity.instance(toxicity.sentences(pa.array([t]))) for t in texts])
    assert (whole.features == parts.features).all() and (whole.sentence == parts.sentence).all() and (whole.text == parts.text).all()
