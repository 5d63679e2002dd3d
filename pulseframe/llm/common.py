"""Shared helpers: tables in the cluster's shared folder, and a vectorised word hasher.

Words here are maximal runs of ASCII digits, ASCII letters (case folded for A-Z only) and any
non-ASCII character, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. In UTF-8
every byte of a non-ASCII character is 0x80 or more, so words can be found byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..store import discard, finished, stored  # noqa: F401  used by the operators

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bounds of training samples: the most groups learned, and about the most rows of all groups together.
MOST_GROUPS, MOST_ROWS = 10_000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, group: str, text: str, rows: int) -> DataFrame:
    """Labelled texts to learn from: (key, group, text), about ``rows`` of each value of ``group``.

    ``labels`` holds (key, group), or is ``docs`` itself. Which ids are taken depends on a hash of
    the id; of rows that repeat an id the least text trains, once. Rows with a null id, group or text
    are left out, and groups beyond the :data:`MOST_GROUPS` most frequent ones (ties by value). All
    groups together have about :data:`MOST_ROWS` rows at most, whatever the tables hold.
    """
    known = labels.select(key, group).where(F.col(key).isNotNull() & F.col(group).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), group).limit(MOST_GROUPS)
    found = sizes.collect()  # at most MOST_GROUPS rows
    each = min(rows, MOST_ROWS / max(len(found), 1))
    share = F.broadcast(docs.sparkSession.createDataFrame([(r[group], each / r["_n"]) for r in found], f"`{group}` {sizes.schema[group].dataType.simpleString()}, _share double"))
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.broadcast(known.join(share, group).where(place < F.col("_share")).select(key, group).distinct())
    own = docs.select(key, group, text).join(chosen, [key, group], "left_semi") if labels is docs else docs.select(key, text).join(chosen, key)
    return own.where(F.col(text).isNotNull()).groupBy(key, group).agg(F.min(text).alias(text))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, label: str) -> DataFrame:
    """Add ``name``: the row's place from 0 in its group, by ``order``, without gaps.

    A range shuffle sorts all rows by group, order and a salt, so a hot group (or a hot sort key)
    spreads over many partitions; each partition counts its own rows and only those counts, one
    per group and partition, are summed over. Rows equal in group and order are interchangeable.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in [*group, *order]]
    ranged = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(
        shuffle_partitions(spark), *keys, F.col("_salt")
    )
    local = stored(
        ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_salt"), label
    ).withColumn("_part", F.shiftright("_at", 33))
    per = local.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = local.alias("r").join(
        offset.alias("o"),
        [F.col("r._part") == F.col("o._part"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in group]],
    )
    return joined.select("r.*", (F.col("r._at") - F.col("o._first") + F.col("o._before")).alias(name)).drop("_at", "_part")


# --- word hashing inside Arrow batches -----------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18
_is_word = np.zeros(256, bool)
_is_word[ord("0") : ord("9") + 1] = _is_word[ord("a") : ord("z") + 1] = _is_word[ord("A") : ord("Z") + 1] = True
_is_word[128:] = True
_byte_value = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_byte_value[ord("A") : ord("Z") + 1] = _byte_value[ord("a") : ord("z") + 1]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _SEGMENT + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end in ``data`` and begin at ``starts``.

    Returns the words' first bytes, their ends and their 64-bit hashes. Long data go through in
    segments cut between words, so that temporary arrays stay small.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = np.unique(starts[(starts >= 0) & (starts < n)])
    first[heads] = inside[heads]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        lo = begin[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _SEGMENT, "right")))
        part = data[lo : end[j - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_value[part] * _power(_BASE, len(part)), out=total[1:])
        at = begin[i:j] - lo
        hashes[i:j] = (total[end[i:j] - lo] - total[at]) * _power(_BASE_INV, len(part) + 1)[at]
        i = j
    return begin, end, mix(hashes + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (also those that cross texts)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + m]
    return mix(out)


def hash_text(words: list[str]) -> int:
    """The run hash of a list of words, as :func:`hash_runs` gives it."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return int(hash_runs(hash_words(data, np.zeros(1, np.int64))[2], len(words))[0])


class Texts:
    """Some rows of a batch: their texts end to end, with words found and hashed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.rows, self.n = data, rows, len(offsets) - 1
        self.offsets = offsets

    @cached_property
    def _found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return hash_words(self.data, self.offsets[:-1])

    @property
    def begin(self) -> np.ndarray:
        return self._found[0]

    @property
    def end(self) -> np.ndarray:
        return self._found[1]

    @property
    def hashes(self) -> np.ndarray:
        return self._found[2]

    @cached_property
    def word_at(self) -> np.ndarray:
        """word_at[i]:word_at[i + 1] are the words of text i."""
        return np.searchsorted(self.begin, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    @cached_property
    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts' code points end to end, and the n + 1 places where texts begin and end."""
        points = np.frombuffer(self.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=leads[1:])
        return points, leads[self.offsets]

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of k words that lie within one text, and the runs' first words."""
        h = hash_runs(self.hashes, k)
        doc = self.doc
        at = np.flatnonzero(doc[: len(h)] == doc[k - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
        return h[at], at

    def words(self, lo: int, hi: int) -> list[str]:
        """Words lo..hi-1 (places in the whole chunk), lower-cased as they were hashed."""
        return [bytes(self.data[a:b]).translate(_TO_LOWER).decode() for a, b in zip(self.begin[lo:hi], self.end[lo:hi], strict=True)]


_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[Texts]:
    """Cut a string column into runs of rows of about ``size`` bytes (one text at least)."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slice(i, j))
        i = j


class HashSet:
    """Membership of 64-bit hashes in a fixed set: a bit table first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.shift = np.uint64(64 - max(12, int(np.ceil(np.log2(16 * len(self.keys) + 1)))))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a key, and which key (its place in ``keys``)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def release() -> None:
    """Give memory that Arrow no longer uses back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, text: str, carry: Sequence[str], fields: str, make: Callable[[], Callable[[Texts], list[pa.Array]]], size: int = 1 << 18) -> DataFrame:
    """Add columns that Python computes from the texts, a chunk of rows at a time.

    ``fields`` is their DDL; ``make`` runs once per task and returns a function from a chunk to one
    array per field. Only the columns in ``carry`` stay; new columns replace those of their names.
    """
    added = StructType.fromDDL(fields)
    kept = [c for c in carry if c not in added.fieldNames()]
    schema = StructType([df.schema[c] for c in kept] + added.fields)
    names = schema.fieldNames()
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for chunk in chunks(batch.column(source), size):
                own = [batch.column(c).slice(chunk.rows.start, chunk.n) for c in kept]
                new = [a.cast(types.field(f.name).type) for a, f in zip(compute(chunk), added.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *new], names=names)
        release()

    # a text that is carried anyway goes to Python once
    source = text if text in kept else "_text"
    return df.select(*kept, *([] if text in kept else [F.col(text).alias("_text")])).mapInArrow(run, schema)


def count_hashes(df: DataFrame, text: str, make: Callable[[], Callable[[Texts], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Sum what a function counts in each chunk: (hashes, counts) -> columns hash, n.

    Each task sums its own chunks first and emits a hash once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column("_text")):
                h, n = count(chunk)
                keys, back = np.unique(np.concatenate([keys, h]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([sums, n]), len(keys)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["hash", "n"])
        release()

    return df.select(F.col(text).alias("_text")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
