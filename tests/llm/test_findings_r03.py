"""What finding 3 of round 3 was about: each failed before its change, but for the last."""

import numpy as np

from tidemark.llm import attention as A


def corpus(rng, vocabulary, n):
    stream = np.concatenate([np.arange(vocabulary), rng.zipf(1.3, n) % vocabulary])
    counts = np.bincount(stream, minlength=vocabulary + 5)
    return stream, counts, np.arange(vocabulary + 5) % 2 == 0


def test_every_subword_that_occurs_has_its_class_by_context():
    stream, counts, ends_word = corpus(np.random.default_rng(1), 900, 4000)
    assert (counts == 1).any() and (counts[900:] == 0).all()
    seen = A.contexts(stream, *A.columns_of(counts, ends_word))
    got = A.classes_of(counts, seen, ends_word, np.random.default_rng(2))
    assert (got[:900] < A.OWN_CLASSES + A.CLUSTERS).all()
    assert (got[900:] == A.OWN_CLASSES + A.CLUSTERS + ends_word[900:]).all()


def test_classes_are_settled():
    # Another round from the classes' own centres changes none.
    stream, counts, ends_word = corpus(np.random.default_rng(3), 4000, 60000)
    column, row = A.columns_of(counts, ends_word)
    seen = A.contexts(stream, column, row)
    got = A.classes_of(counts, seen, ends_word, np.random.default_rng(4))
    others = np.flatnonzero(row >= 0)
    x = seen.reshape(len(others), -1).astype(float)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    own = got[others] - A.OWN_CLASSES
    centres = np.array([np.average(x[own == k], axis=0, weights=counts[others][own == k]) for k in range(A.CLUSTERS)])
    near = x @ centres.T - 0.5 * (centres**2).sum(1)
    assert (near.max(1) - near[np.arange(len(own)), own]).max() < 1e-9


def test_few_others_have_a_class_each():
    stream, counts, ends_word = corpus(np.random.default_rng(5), A.OWN_CLASSES + 9, 3000)
    got = A.classes_of(counts, A.contexts(stream, *A.columns_of(counts, ends_word)), ends_word, np.random.default_rng(6))
    assert sorted(got[: A.OWN_CLASSES + 9]) == list(range(A.OWN_CLASSES + 9))


def test_scores_of_large_weights():
    """Scaled or not, blocks of one document or several: the score of each document by itself, from its definition."""
    rng = np.random.default_rng(7)
    class_of = rng.integers(0, A.START, 300)
    for size in (1.0, 30.0):
        p = {name: x * (size if name in "EU" else 1) for name, x in A.start(rng.integers(0, 50, A.CLASSES**2), rng).items()}
        model = A.model_of(class_of, p).with_counts(rng.integers(0, 9, 300))
        bounds = np.cumsum([0, 3, 0, 700, 1, 40, 5000])
        stream = rng.integers(0, 300, bounds[-1])
        got = model.score(stream, bounds)
        alone = [model.score(stream[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds, bounds[1:])]
        assert np.isfinite(got).all() and got[1] == 0
        w = {name: x.astype(float) for name, x in model.weights.items()}
        want = 0.0  # the document of three subwords
        c = [A.START, *class_of[stream[:3]]]
        for t in range(3):
            s = np.array([w["Q"][c[t]] @ w["K"][c[j]] + w["bias"][0, A.HALF - (t - j)] for j in range(t + 1)])
            a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            logits = (w["E"][c[t]] + sum(x * w["V"][c[j]] for j, x in enumerate(a))) @ w["U"] + w["B"][c[t]]
            want += logits[c[t + 1]] - logits.max() - np.log(np.exp(logits - logits.max()).sum()) + model.log_share[stream[t]]
        assert np.isclose(got[0], want / np.log(10), rtol=1e-4)
        assert np.isclose(alone[0], got[0], rtol=1e-4)
