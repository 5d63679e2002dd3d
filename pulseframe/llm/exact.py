"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes of their texts, each text led by its length: first by length
and the first :data:`WIDTHS`\\ [0] bytes, then every group of two or more by the next run of bytes, and
so on until a group is a single document or its texts have ended. Members of an ended group agree in
every byte; no digest decides. Digits widen as groups get rarer, so that the number of rounds grows
with the logarithm of the longest repeated text, up to a last width that bounds what a row of a round
holds; beyond that it grows by one for each such width.

A round counts (group, digit) pairs, which combine before the shuffle however hot a group is, and
joins the pairs found at least twice to the rows. Both sides of that join are tables, so a group with a
third of all rows is split by adaptive execution, or nothing is shuffled where the pairs are few enough
to broadcast. Each round's rows are written, without the bytes already split by.

Documents whose first digit is theirs alone never move: a bit table of bounded size (2**26 bits, 8 MB,
broadcast) marks the digits found twice. It is a filter only. A document that it lets through by chance
is found single in the first round; on so many rows that the table fills up, all texts are shuffled once.

Nulls, ties, repeats: a null text counts as empty; of equal texts the row with the largest key stays, a
null key being less than any other; of rows equal in text and key one stays, any of them. ``keep_id`` is
null where all keys of a group are. Very long texts are split to their ends; an empty table gives an
empty result. Columns named like a result column are replaced, other names never clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Bytes of the digit of each round; the last one repeats.
WIDTHS = (64, 1 << 10, 1 << 14, 1 << 18)
FILTER_BITS = 1 << 26


def _digit(width: int) -> Column:
    return F.substring("_rest", 1, width)


def _shared_digits(rows: DataFrame) -> DataFrame:
    """Bit table of the (group, digit) pairs that at least two rows have: (_bucket, _bits)."""
    pairs = rows.groupBy("_group", _digit(WIDTHS[0]).alias("_digit")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    place = _place(F.col("_digit"))
    return pairs.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def _place(digit: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("_group"), digit), F.lit(FILTER_BITS)) + 1


def _marked(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``_shared``: whether the bit table has the row's first digit."""
    place = _place(_digit(WIDTHS[0]))
    position = F.bitmap_bit_position(place)
    joined = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_position": position}).join(F.broadcast(table), "_bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(F.col("_position") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, cast(_position % 8 AS int))")
    return joined.withColumn("_shared", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("_bucket", "_position", "_bits")


def _split(active: DataFrame, width: int, carried: Sequence[str], label: str) -> DataFrame:
    """One round: rows with their next group and what is left of their texts, null once they are decided."""
    cut = active.withColumn("_digit", _digit(width))
    classes = stored(
        cut.groupBy("_group", "_digit")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_best"), F.coalesce(F.max_by("_row", "_id"), F.min("_row")).alias("_best_row"))
        .where("_n > 1"),
        f"{label}-classes",
    )
    going = F.col("_best_row").isNotNull() & (F.octet_length("_rest") > width)
    single = F.col("_best_row").isNull()
    level = stored(
        cut.join(classes, ["_group", "_digit"], "left").select(
            "_row", "_id", *carried, F.col("_best_row").alias("_group"),
            F.when(going, F.expr(f"substring(_rest, {width + 1})")).alias("_rest"),
            F.when(single, F.col("_id")).otherwise(F.col("_best")).alias("_keep"),
            F.coalesce(F.col("_n"), F.lit(1).cast("long")).alias("_size"),
            (single | (F.col("_row") == F.col("_best_row"))).alias("_kept"),
        ),
        label,
    )
    discard(classes)
    return level


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row: the columns in ``carry``, ``keep_id`` (the key that stays), ``group_size`` and ``kept``."""
    own = [c for c in carry if c not in ("keep_id", "group_size", "kept")]
    carried = [f"_c{i}" for i in range(len(own))]
    rows = docs.select(
        F.col(f"`{key}`").alias("_id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(own, carried, strict=True)],
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_rest"),
    ).withColumn("_group", F.octet_length("_rest").cast("long"))
    marked = _marked(rows, stored(_shared_digits(rows), "radix-bits"))

    alone = marked.where(~F.col("_shared")).select(*carried, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    active = stored(marked.where("_shared").select("_id", *carried, "_rest", "_group", F.monotonically_increasing_id().alias("_row")), "radix-0")
    parts, before, round_ = [alone], active, 0
    while not active.isEmpty():
        level = _split(active, WIDTHS[min(round_, len(WIDTHS) - 1)], carried, f"radix-{round_ + 1}")
        if round_ == 0:
            discard(before)
        parts.append(level.where("_rest IS NULL").select(*carried, "_keep", "_size", "_kept"))
        active, round_ = level.where("_rest IS NOT NULL"), round_ + 1
    whole = reduce(DataFrame.unionAll, parts)
    return whole.select(
        *[F.col(n).alias(c) for c, n in zip(own, carried, strict=True)],
        F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, with its columns: that with the largest key."""
    numbers = [f"_k{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*numbers)
    marked = mark_copies(named, numbers[docs.columns.index(key)], numbers[docs.columns.index(text)], numbers)
    return marked.where("kept").select(*[F.col(n).alias(c) for n, c in zip(numbers, docs.columns, strict=True)])
