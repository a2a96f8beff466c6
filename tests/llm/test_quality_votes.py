"""The vote against one written out neighbour by neighbour, and the learned weights by hand."""

import math

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import quality


def test_term_weights_by_hand():
    x = np.array([[1.0, 0, 2], [3, 0, 2], [0, 1, 2], [0, 3, 2], [0, 5, 2]])
    want = [2 / (1 / 2 + 1e-3), 3 / (8 / 3 / 2 + 1e-3), 0]
    assert quality.term_weights(x, np.array([1, 1, 0, 0, 0])) == pytest.approx(want)
    assert (quality.term_weights(x, np.ones(5)) == 1).all()


def test_votes_equal_brute_force():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(80)] + ["zz zz zz " * int(k) for k in rng.integers(1, 30, 40)]
    labels = np.array([1] * 80 + [0] * 40)
    model = quality.fit(quality.term_rows(pa.array(texts)), labels, (3.0, 2.0), latent=16)
    asked = ["", "zz zz", texts[3], "abcd efgh", None, "É 12 !!"]
    got = quality.vote(model, quality.term_rows(pa.array(asked, pa.string())), 7, 0.02)
    for text, score in zip(asked, got):
        v = np.log1p(quality.term_rows(pa.array([text], pa.string()))[0].astype(float)) @ model["base"]
        cosines = [float(v @ p) / max(float(np.linalg.norm(v)), 1e-12) for p in model["points"]]
        near = sorted(range(120), key=lambda i: -cosines[i])[:7]
        weigh = {i: math.exp((cosines[i] - 1) / 0.02) * (2.0 if labels[i] else 3.0) for i in near}
        assert score == pytest.approx(sum(w for i, w in weigh.items() if labels[i]) / sum(weigh.values()), abs=1e-6)
