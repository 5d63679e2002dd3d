"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are of two kinds: its layout, which is trigrams of character classes (letter case, digit,
space, line break, each punctuation mark) and words that repeat one of the two words before them; and
its words and pairs of words, by hash. Term weights are square roots of counts times inverse document
frequency, and each kind's have length one (words :data:`WORD_SHARE`); a truncated singular value
decomposition of the labelled rows' terms gives the latent space. The labelled vectors are broadcast (their number is
bounded by :data:`TRAIN_ROWS` per label); every text is compared with all of them in exact blocked
cosine products, and the nearest vote with their similarity as weight.

Nulls, ties, repeats: a null or empty text has no terms, a zero vector, and the labelled rows'
mean as score; of equally near neighbours those of lesser ids vote; conflicting labels of one id
train with the larger; a repeated id trains once; repeated rows are scored each for itself; without
labelled rows every score is 0.5; an empty table gives an empty result. Very long texts are read whole. Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, map_texts, training_rows

#: Terms by layout, and hash slots for words and pairs of words.
LAYOUT, WORDS = 4096, 4096
TERMS = LAYOUT + WORDS
#: Length of the words' part of a vector, beside the layout's length of one.
WORD_SHARE = 0.5
RANK = 48
TRAIN_ROWS = 2000
NEIGHBOURS = 15
_REPEATS = 4
_CLASSES = 64
_CHUNK = 1 << 19


@cache
def _classes() -> np.ndarray:
    out = np.full(1 << 16, 40, np.int64)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            out[c] = 2 if s.isupper() else 1
        elif s.isdigit():
            out[c] = 3
        elif s == "\n":
            out[c] = 5
        elif s.isspace():
            out[c] = 4
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = np.arange(8, 8 + len(marks))
    return out


def terms(chunk: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) of each text's distinct terms, sorted; weights are square roots of counts."""
    points, at = chunk.code_points
    c = _classes()[np.minimum(points, 0xFFFF)]
    doc = np.repeat(np.arange(chunk.n), np.diff(at))
    if len(c) >= 3:
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        term = (code * 2654435761 % (1 << 32)) % (LAYOUT - _REPEATS)
        inside = doc[:-2] == doc[2:]
        keys = [(doc[:-2][inside].astype(np.int64) * TERMS) + term[inside]]
    else:
        keys = []
    h, owner = chunk.hashes, chunk.doc
    for back in (1, 2):
        if len(h) > back:
            again = np.flatnonzero((h[back:] == h[:-back]) & (owner[back:] == owner[:-back]))
            keys.append(owner[back:][again].astype(np.int64) * TERMS + LAYOUT - back)
    for k in (1, 2):
        runs, first = chunk.runs(k)
        keys.append(owner[first].astype(np.int64) * TERMS + LAYOUT + ((runs >> np.uint64(20)) % np.uint64(WORDS)).astype(np.int64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // TERMS, key % TERMS, np.sqrt(count).astype(np.float32)


def scaled(matrix: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Rows whose layout has length one and whose words :data:`WORD_SHARE`, in place; ``term`` names the columns in ascending order."""
    cut = int(np.searchsorted(term, LAYOUT))
    for part, length in ((matrix[:, :cut], 1.0), (matrix[:, cut:], WORD_SHARE)):
        part *= (length / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)).astype(np.float32)[:, None]
    return matrix


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; of equal ones at the border the first."""
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    border = np.take_along_axis(cosines, near, axis=1).min(axis=1)
    tied = np.flatnonzero((cosines >= border[:, None]).sum(axis=1) > k)
    near[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
    return near


class Model:
    """Term weights, the latent space, and labelled vectors in it."""

    def __init__(self, idf: np.ndarray, space: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float):
        self.idf, self.space, self.vectors, self.labels, self.prior = idf, space, vectors, labels, prior

    def project(self, n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Latent vectors of n texts, of length one (zero for a text without terms)."""
        out = np.zeros((n, self.space.shape[1]), np.float32)
        used, column = np.unique(term, return_inverse=True)
        counts = np.zeros((n, len(used)), np.float32)
        counts[doc, column] = weight * self.idf[term]
        out += scaled(counts, used) @ self.space[used]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Shares of label 1 among the nearest labelled vectors, weighted by cosine."""
        score = np.full(len(vectors), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(vectors), 256) if k else ():
            cosines = vectors[lo : lo + 256] @ self.vectors.T
            near = nearest(cosines, k)
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            share = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            score[lo : lo + 256] = np.where(total > 1e-12, share, self.prior)
        return score


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows per label; their terms, not their texts, come to the driver."""
    one = labels.where(F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_label"))
    own = training_rows(docs, one, key, "_label", text, rows)

    def make():
        def collect(chunk: Texts):
            doc, term, weight = terms(chunk)
            cut = np.searchsorted(doc, np.arange(chunk.n + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(term.astype(np.int32)))
            weights = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(weight))
            return [lists, weights]

        return collect

    found = map_texts(own, text, [key, "_label"], "terms array<int>, weights array<float>", make, _CHUNK).toArrow().sort_by([(key, "ascending")])
    y = found.column("_label").to_numpy().astype(np.float64)
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    row, term, weight = [], [], []
    for i, (t, w) in enumerate(zip(found.column("terms"), found.column("weights"), strict=True)):
        t, w = t.values.to_numpy(), w.values.to_numpy()
        row.append(np.full(len(t), i, np.int32)), term.append(t), weight.append(w)
    row, term, weight = np.concatenate(row), np.concatenate(term), np.concatenate(weight)
    del found
    idf = np.log((1 + len(y)) / (1 + np.bincount(term, minlength=TERMS))).astype(np.float32) + 0.1
    matrix = np.zeros((len(y), TERMS), np.float32)
    matrix[row, term] = weight * idf[term]
    scaled(matrix, np.arange(TERMS))
    rank = min(RANK, *matrix.shape)
    basis = np.random.default_rng(7).standard_normal((TERMS, min(rank + 16, *matrix.shape))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    space = np.ascontiguousarray((basis @ right.T)[:, :rank])
    del matrix
    model = Model(idf, space, np.zeros((0, rank), np.float32), y, float(y.mean()))
    model.vectors = model.project(len(y), row, term, weight)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add ``score``: the neighbours' share of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def vote(chunk: Texts):
            return [pa.array(m.vote(m.project(chunk.n, *terms(chunk))))]

        return vote

    return map_texts(docs, text, list(docs.columns if carry is None else carry), "score double", make, _CHUNK)
