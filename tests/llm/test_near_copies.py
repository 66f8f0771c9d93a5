"""The pipeline's near-duplicate stage against all pairs compared."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from voxelith.llm import near_copies

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("an", "el", "ir", "om", "ut")]


def shingled(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    s, root = {i: shingled(t) for i, t in rows}, {i: i for i, _ in rows}
    near = [(a, b) for a in s for b in s if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {i for i, r in root.items() if i == r}


@pytest.mark.parametrize("frequent", [2, 1000])
def test_near_copies_equal_all_pairs(spark, monkeypatch, tmp_path, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = rng.choices(WORDS, k=rng.randint(5, 250))
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
    passage = rng.choices(WORDS, k=60)
    texts += [" ".join([*passage, *rng.choices(WORDS, k=rng.randint(1, 60))]) for _ in range(20)]
    texts += [None, "", " \n", "One two", "one  TWO", "one two three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows] + [(None, texts[3], None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, d, str(tmp_path))
    want = kept(rows)
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == sorted(want) and len(want) < len(rows) - 20
    assert got.where("doc_id is null").count() == 1 and got.columns == d.columns


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (500, 540), (510, 515), (2000, 2500), (5000, 5100)):
        x = np.unique(rng.integers(-1 << 62, 1 << 62, n))
        y = np.unique(np.concatenate([x[:n * 9 // 10], rng.integers(-1 << 62, 1 << 62, m - n * 9 // 10)]))
        assert near_copies.apart(near_copies.parities(x), near_copies.parities(y)) <= len(np.setxor1d(x, y))
        z = np.unique(rng.integers(-1 << 62, 1 << 62, m))
        assert n == 1 or 9 * near_copies.apart(near_copies.parities(x), near_copies.parities(z)) > n + m
