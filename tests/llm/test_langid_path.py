"""Best paths over languages against all paths."""

from __future__ import annotations

from itertools import product

import numpy as np

from voxelith.llm import langid


def value(s, p):
    return sum(s[i, k] for i, k in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))


def test_path_is_the_best_of_all():
    model, rng = langid.Model([], np.zeros((1, 0)), []), np.random.default_rng(6)
    cases = [np.array([[0.0, -20.0, -7.0], [-20.0, 0.0, -7.0]]), *(-20 * rng.random((n, 3)) for n in (1, 2, 3, 4, 5) for _ in range(60))]
    for s in cases:
        best = max(value(s, p) for p in product(range(3), repeat=len(s)))
        assert abs(value(s, model.path(s).tolist()) - best) < 1e-9
    assert model.path(cases[0]).tolist() == [0, 1]
