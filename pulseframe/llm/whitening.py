"""Whitening of embeddings from an exact scatter matrix, by residue numbers.

Entries become integers x = floor(64 c) + 1,000,000. With n vectors and sums S, y = n x - S is the
centred vector times n, an integer. Each task reduces y modulo several primes and multiplies block by
block in float64, where products and sums of such residues are exact (``BLOCK * (p / 2)**2 < 2**53``).
Sums of residues over all tasks are added by prime and row of the matrix, and Chinese remaindering
gives the integer matrix sum(y y'), whose division by n**3 is the covariance, rounded once. How many
primes it takes follows from n and the extremes of each dimension, which the first pass finds. What
comes to the driver has the size of the matrix, whatever the number of rows.

The matrix is decomposed in double precision (``eigh``); vectors are projected as x - S/n, whose integer
part is taken before the division. The covariance of the whitened values is measured, not assumed.

Nulls, ties, repeats: rows are dropped if the vector is null, or holds a null or non-finite entry or one
whose x is no 64-bit integer (beyond 1.4e17), or if it has not the most frequent length (the longest of
equally frequent ones). Repeated rows and null ids count as rows like others. A component without
variance (an eigenvalue not above d * 2**-52 times the largest) has whitened value null, and does not
enter ``identity_error``; components are numbered by falling eigenvalue, and the entry of largest
amount in an eigenvector is positive. ``deviation`` is a decimal of 38 digits, null beyond. Empty tables,
and tables whose vectors are all dropped or empty, give an empty result. Other columns are not carried,
so their names cannot clash. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, release

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block of the modular products; primes lie under 2**PRIME_BITS, so sums stay under 2**50.
BLOCK, PRIME_BITS = 4096, 20
#: Entries up to this amount have a 64-bit x.
LARGEST = 1.4e17


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2**20."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for i in range(2, 1 << (PRIME_BITS // 2)):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1][:count]]


def enough_primes(bound: int) -> list[int]:
    """Primes whose product exceeds twice ``bound``, so that numbers between -bound and bound are told apart."""
    found = primes(2 * bound.bit_length() // PRIME_BITS + 2)
    n = 1
    while prod(found[:n]) <= 2 * bound:
        n += 1
    return found[:n]


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers of least amount with these residues, as Python integers."""
    whole = prod(residues)
    total = sum(r.astype(object) * (whole // p * pow(whole // p, -1, p)) for p, r in residues.items()) % whole
    return np.where(total > whole // 2, total - whole, total)


@dataclass(frozen=True)
class Model:
    """What the rows are projected by. ``weights`` has a column per component, zero for those without variance."""

    n: int
    dim: int
    centre: np.ndarray  # floor(S / n)
    remainder: np.ndarray  # S - n * centre
    small: bool  # deviations fit 64 bits
    weights: np.ndarray
    alive: np.ndarray
    explained: np.ndarray
    identity_error: float


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their x."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            c = part.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            yield part, np.floor(c * SCALE).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """Sums of the array column ``values`` by key, element by element. Only these sums come to the driver."""
    kind = rows.schema["values"].dataType.elementType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
            total, last = part if total is None else total + part, batch
        if last is not None:
            yield pa.RecordBatch.from_arrays([*[last.column(k).slice(0, 1) for k in keys], list_array(pa.array(total), np.array([len(total)]))], names=[*keys, "values"])

    schema = ", ".join(f"{k} int" for k in keys) + f", values array<{kind}>"
    # two steps: no task adds up what all tasks of the scan have sent for a key
    part = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = part.groupBy(*keys, "_part").applyInArrow(add, schema)
    return {tuple(r[k] for k in keys): np.array(r["values"]) for r in once.groupBy(*keys).applyInArrow(add, schema).collect()}


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _v): rows whose vector has finite entries only and the most frequent length."""
    fine = F.forall("_v", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))
    rows = table.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v")).where(F.col("_v").isNotNull() & fine)
    lengths = rows.groupBy(F.size("_v").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).limit(1).collect()
    return rows.where(F.size("_v") == (lengths[0]["_d"] if lengths else 0))


def _moments(rows: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and each dimension's sum, least and largest x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        least, most = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for _, x in _matrices(batches, dim):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low), pa.array(least), pa.array(most)], names=["dim", "n", "high", "low", "least", "most"])

    per_task = rows.select("_v").mapInArrow(run, "dim int, n long, high long, low long, least long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = per_task.groupBy("dim").agg(exact("n"), exact("high"), exact("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    return int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found], [r["least"] for r in found], [r["most"] for r in found]


def scatter(rows: DataFrame, dim: int, n: int, sums: list[int], moduli: list[int]) -> np.ndarray:
    """sum(y y') with y = n x - S, exactly."""
    s_mod = {p: np.array([s % p for s in sums]) for p in moduli}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((dim, dim), np.int64) for p in moduli}
        for _, x in _matrices(batches, dim):
            for p in moduli:
                y = ((x % p) * (n % p) - s_mod[p]) % p
                y = np.where(y > p // 2, y - p, y).astype(np.float64)
                total[p] = (total[p] + (y.T @ y).astype(np.int64)) % p
        for k, p in enumerate(moduli):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, k, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), list_array(pa.array(total[p].ravel()), np.full(dim, dim))], names=["prime", "i", "values"])
        release()

    found = _summed(rows.select("_v").mapInArrow(run, "prime int, i int, values array<long>"), ["prime", "i"])
    return remaindered({p: np.array([found[k, i] for i in range(dim)]).reshape(dim, dim) % p for k, p in enumerate(moduli)})


def _projected(x: np.ndarray, m: Model) -> np.ndarray:
    return ((x - m.centre).astype(np.float64) - m.remainder / m.n) @ m.weights


def _identity_error(rows: DataFrame, m: Model) -> float:
    """Largest entry of the whitened values' covariance minus the identity, measured over all rows."""
    k = int(m.alive.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the projected rows are centred already: their mean is zero but for rounding
        total = np.zeros((k + 1, k))
        for _, x in _matrices(batches, m.dim):
            w = _projected(x, m)[:, m.alive]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), list_array(pa.array(total.ravel()), np.full(k + 1, k))], names=["i", "values"])
        release()

    if not k:
        return 0.0
    found = _summed(rows.select("_v").mapInArrow(run, "i int, values array<double>"), ["i"])
    mean = found[(k,)] / m.n
    return float(np.abs(np.array([found[(i,)] for i in range(k)]) / m.n - np.outer(mean, mean) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """Components of the usable rows, by falling eigenvalue; None without rows or dimensions."""
    first = rows.select(F.size("_v").alias("d")).first()
    if first is None or not first["d"]:
        return None
    dim = first["d"]
    n, sums, least, most = _moments(rows, dim)
    far = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(least, most, sums, strict=True))
    exact = scatter(rows, dim, n, sums, enough_primes(n * far * far))
    covariance = np.array([[v / n**3 for v in row] for row in exact.tolist()])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    alive = values > dim * 2.0**-52 * max(values[0], 0.0)
    trace = int(sum(exact[i, i] for i in range(dim))) / n**3
    m = Model(
        n, dim, np.array([s // n for s in sums]), np.array([s % n for s in sums]), dim * far * far < 1 << 62,
        np.where(alive, vectors / np.sqrt(np.where(alive, values, 1.0)), 0.0), alive,
        np.where(alive, values, 0.0) / (trace or 1.0), 0.0,
    )
    return Model(**{**m.__dict__, "identity_error": _identity_error(rows, m)})


def _deviations(x: np.ndarray, m: Model) -> pa.Array:
    """sum((n x - S)**2) of each row; null beyond 38 digits."""
    if m.small:
        y = m.n * (x - m.centre) - m.remainder
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    y = (x.astype(object) - m.centre.astype(object)) * m.n - m.remainder.astype(object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))


def whiten(rows: DataFrame, m: Model) -> DataFrame:
    """A row per usable row and component: _id, component, n, deviation, whitened, explained, identity_error."""
    k = len(m.alive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, m.dim):
            b = len(x)
            each = pa.array(np.repeat(np.arange(b), k))
            lost = np.tile(~m.alive, b)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, m.n)),
                    _deviations(x, m).take(each), pa.array(_projected(x, m).ravel(), mask=lost),
                    pa.array(np.tile(m.explained, b)), pa.array(np.full(b * k, m.identity_error)),
                ],
                names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        release()

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit all usable rows and whiten them."""
    rows = usable(table, key, vector)
    m = fit(rows, components)
    if m is None:
        none = Model(1, 1, np.zeros(1, np.int64), np.zeros(1, np.int64), True, np.zeros((1, 0)), np.zeros(0, bool), np.zeros(0), 0.0)
        return whiten(rows.where("false"), none).withColumnRenamed("_id", key)
    return whiten(rows, m).withColumnRenamed("_id", key)
