"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by multiplying its
letters' vectors, permuted by their places; a text is the bundle (sum) of its trigrams; a language
is the bundle of its training texts, each at length one. A text gets the language whose prototype
has the largest cosine with it.

Letters are what Unicode calls alphabetic, in lower case; runs of anything else are one boundary,
which is a letter of its own. Letters beyond a-z share a fixed number of vectors by hash.

Prototypes are fitted on about :data:`TRAIN_ROWS` labelled rows of each of the
:data:`~pulseframe.llm.common.MOST_GROUPS` most frequent languages (documented bounds, so that dirty
language values cannot grow the model without end); every text is scored whole.

Nulls, ties, repeats: a null text, or one without letters, is ``und`` with score 0; rows with a
null language or id do not train; equal cosines go to the language that comes first by name;
a repeated id and language trains once; repeated rows are scored each for itself; without any training row all is ``und``; an
empty table gives an empty result. Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, crc_fold, map_texts, training_rows

DIMENSIONS = 512
TRAIN_ROWS = 2000
_SLOTS = 128
_SHARPNESS = 30.0
_CHUNK = 1 << 19


@cache
def _slots() -> np.ndarray:
    """The vector of each letter of the basic plane; 0 for what is no letter."""
    out = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            out[c] = _slot(chr(c))
    return out


def _slot(letter: str) -> int:
    low = ord(letter.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 4294967296 % (_SLOTS - 27)


@cache
def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors as they stand first, second and last in a trigram."""
    base = np.random.default_rng(1729).choice(np.array([-1, 1], np.int8), (_SLOTS, DIMENSIONS)).astype(np.float32)
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def bundles(chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
    """One vector per text, of length one, and whether the text has a letter."""
    points, at = chunk.code_points
    slots = _slots()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        c = chr(points[i])
        slots[i] = _slot(c) if c.isalpha() else 0
    doc = np.repeat(np.arange(chunk.n), np.diff(at))
    padded = np.zeros(len(slots) + chunk.n + 1, np.int32)
    place = np.arange(len(slots)) + doc + 1
    padded[place] = slots
    owner = np.zeros(len(padded), np.int32)
    owner[place] = doc
    keep = padded > 0
    keep[0] = True
    keep[1:] |= padded[:-1] > 0
    s, owner = padded[keep], owner[keep]
    out = np.zeros((chunk.n, DIMENSIONS), np.float32)
    if len(s) >= 3:
        middle = np.flatnonzero(s[1:-1] > 0) + 1
        code = (s[middle - 1].astype(np.int64) * _SLOTS + s[middle]) * _SLOTS + s[middle + 1]
        key, count = np.unique((owner[middle].astype(np.int64) << 21) | code, return_counts=True)
        grams, column = np.unique(key & ((1 << 21) - 1), return_inverse=True)
        first, second, third = _vectors()
        row = key >> 21
        for lo in range(0, len(grams), 1024):  # so many trigrams at a time
            part = grams[lo : lo + 1024]
            bound = first[part >> 14] * second[(part >> 7) & 127] * third[part & 127]
            here = (column >= lo) & (column < lo + 1024)
            counts = np.zeros((chunk.n, len(part)), np.float32)
            counts[row[here], column[here] - lo] = count[here]
            out += counts @ bound
    norm = np.linalg.norm(out, axis=1)
    letters = np.zeros(chunk.n, bool)
    letters[doc[slots > 0]] = True
    return out / np.maximum(norm, 1e-9)[:, None], letters


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, in order of name, and their prototypes of length one.

    Each task bundles its own texts; Spark adds the bundles up, and one vector per language comes
    to the driver.
    """
    train = training_rows(docs, docs, key, lang, text, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column("_lang").to_pylist()
            for chunk in chunks(batch.column("_text"), _CHUNK):
                vectors, letters = bundles(chunk)
                for i in np.flatnonzero(letters):
                    name = languages[chunk.rows.start + i]
                    sums[name] = sums.get(name, 0) + vectors[i].astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v)], names=["lang", "dim", "value"]
            )

    summed = (
        train.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
        .mapInArrow(run, "lang string, dim int, value double")
        .groupBy("lang", "dim")
        .agg(F.sum("value").alias("value"))
    )
    found: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["value"]
    names = sorted(found)
    prototypes = np.array([found[n] / max(np.linalg.norm(found[n]), 1e-9) for n in names], np.float32).reshape(-1, DIMENSIONS)
    return names, prototypes


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the language's share by cosine, sharpened)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        names, prototypes = sent.value

        def score(chunk: Texts):
            vectors, letters = bundles(chunk)
            if not names:
                return [pa.array(["und"] * chunk.n), pa.array(np.zeros(chunk.n))]
            cosines = (vectors @ prototypes.T).astype(np.float64)
            weight = np.exp(_SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
            best = cosines.argmax(axis=1)
            share = np.where(letters, 1 / weight.sum(axis=1), 0.0)
            return [pa.array([names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]), pa.array(share)]

        return score

    return map_texts(docs, text, list(docs.columns if carry is None else carry), "lang_pred string, score double", make, _CHUNK)


def train_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that may train: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where(crc_fold(F.col(key), 4) != 2)
