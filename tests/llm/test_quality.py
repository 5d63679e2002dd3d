"""The vote's ties, the latent space against a dense decomposition, and words as terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pulseframe.llm import common, quality


def test_ties_go_to_the_first():
    rng = np.random.default_rng(4)
    for _ in range(20):
        cosines = rng.integers(0, 4, (50, 200)).astype(np.float32) / 4
        got = quality.nearest(cosines, 15)
        want = np.argsort(-cosines, axis=1, kind="stable")[:, :15]
        assert (np.sort(got, axis=1) == np.sort(want, axis=1)).all()
    alternate = np.tile(np.array([1.0, 0.5], np.float32), 500)[None]
    assert sorted(quality.nearest(alternate, 15)[0].tolist()) == list(range(0, 30, 2))


def chunk(*texts):
    return next(common.chunks(pa.array(texts), 1 << 20))


def test_words_and_pairs_are_terms():
    def kinds(text):
        _, term, _ = quality.terms(chunk(text))
        return {int(t) for t in term if t < quality.LAYOUT}, {int(t) for t in term if t >= quality.LAYOUT}

    (layout, words), (other_layout, other_words) = kinds("alpha beta gamma"), kinds("omega zeta kappa")
    assert len(words) == 5 and not words & other_words and layout & other_layout
    assert kinds("gamma beta alpha")[1] & words and kinds("gamma beta alpha")[1] != words  # same words, other pairs
    assert kinds("Alpha BETA gamma")[1] == words and quality.terms(chunk("", None))[0].size == 0


def test_parts_have_their_lengths():
    m = quality.scaled(np.array([[3.0, 4.0, 6.0, 8.0], [0, 0, 5, 0], [0, 0, 0, 0]], np.float32), np.array([0, 1, quality.LAYOUT, quality.LAYOUT + 1]))
    assert np.allclose(m, [[0.6, 0.8, 0.6 * quality.WORD_SHARE, 0.8 * quality.WORD_SHARE], [0, 0, quality.WORD_SHARE, 0], [0, 0, 0, 0]])


def test_space_is_that_of_a_dense_decomposition(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[:40] if i % 2 else vocabulary[20:], 30)) + ("!?" if i % 3 else ".\n") * (i % 5), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    dense = np.zeros((80, quality.TERMS))
    for i, text, _ in rows:
        _, term, weight = quality.terms(chunk(text))
        dense[i, term] = weight * model.idf[term]
    dense = quality.scaled(dense, np.arange(quality.TERMS))
    _, sizes, right = np.linalg.svd(dense, full_matrices=False)
    kept = model.space.shape[1]
    caught = np.linalg.norm(dense @ model.space) ** 2
    assert caught == pytest.approx((sizes[:kept] ** 2).sum(), rel=1e-2)
    assert np.abs(model.space.T @ model.space - np.eye(kept)).max() < 1e-4
    best = right[:3].T
    assert np.linalg.norm(model.space.T @ best, axis=0) == pytest.approx(np.ones(3), abs=1e-3)  # the leading directions lie in it
