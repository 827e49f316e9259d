"""op10_lm_scores: counts and likelihoods do not depend on where sequences are cut, and need no product for two segments."""

import numpy as np

from graphloom.llm import hmm


def test_outer_segments_need_no_products(monkeypatch):
    rng = np.random.default_rng(3)
    emit = rng.random((hmm.STATES, hmm.ALL)) + 0.01
    model = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit / emit.sum(1, keepdims=True))
    sizes = np.array([1, 5, 8, 9, 13, 16, 40, 77])
    flat = rng.integers(0, hmm.ALL, sizes.sum()).astype(np.int32)
    starts, got, cut = np.cumsum(sizes) - sizes, [], []
    through = hmm.Model._through
    monkeypatch.setattr(hmm.Model, "_through", lambda self, flat, first: cut.append(len(first)) or through(self, flat, first))
    for segment in (8, 100):
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        monkeypatch.setattr(hmm, "LONG", segment)
        into = hmm.blank()
        model.expect(flat, sizes, into)
        got.append((into, model.forward(flat, starts, sizes)))
    assert cut == [11, 11]  # 3 of 40 symbols, 8 of 77; none of shorter ones
    (a, x), (b, y) = got
    assert all(np.allclose(a[k], b[k], rtol=1e-9, atol=1e-12) for k in a) and np.allclose(x, y, rtol=1e-12)
    plain = []
    for at, n in zip(starts, sizes, strict=True):
        v, like = model.start, 0.0
        for t in range(n):
            v = (v if t == 0 else v @ model.move) * model.emit[flat[at + t]]
            like, v = like + np.log(v.sum()), v / v.sum()
        plain.append(like)
    assert np.allclose(x, plain, rtol=1e-12)
