"""The toxicity scorer's memory: what is kept is bounded, and scores don't depend on it."""

import numpy as np

from lettermill.llm.toxicity import Scorer, train


def test_kept_weights_are_bounded(monkeypatch):
    rnd = np.random.default_rng(3)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 7))
    texts = [" ".join(word() for _ in range(30)) + (" terrible idiot here. terrible idiots" if i % 3 == 0 else ". fine") for i in range(120)]
    model = train(texts, [int(i % 3 == 0) for i in range(120)])
    whole = Scorer(model)(texts)
    monkeypatch.setattr(Scorer, "KEPT", 50)
    score, found = Scorer(model), []
    for i, text in enumerate(texts):
        found += score([text])
        assert len(score.weights) + len(score.old) < 50 + 3 * 40, i
    assert {"terrible", "fine"} <= score.weights.keys() | score.old.keys()  # what is met again stays
    assert np.allclose(found, whole, atol=1e-5)
