"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the record's key and its own; the record goes to the shard whose
weighted draw wins. A draw does not depend on the other shards, so one shard more takes rows only
into itself, and one shard less gives up only its own.

Nulls, ties, repeats: a null key counts as the text ``null``; a null text has no bytes; rows with
equal keys share a shard and get slots of their own; equal draws go to the lower shard number.
Very long texts are measured whole and stay where they are. An empty table gives an empty result, and columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

SHARDS = 24


def draws(key: Column, weights: Sequence[float]) -> Column:
    """One struct (cost, shard) per shard: -ln(u) / weight with u from 52 bits of md5(key:shard)."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def cost(s: Column) -> Column:
        digest = F.md5(F.concat(text, F.lit(":"), s["shard"].cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.ln(u) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.transform(shards, cost)


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = ()) -> DataFrame:
    """Add ``shard``, and ``grown_shard``: where the row goes once the shards ``grown`` are added."""
    if not weights or min([*weights, *grown]) <= 0:
        raise ValueError("every shard needs a positive weight")
    n = len(weights)
    drawn = df.withColumn("_draws", draws(F.col(key), [*weights, *grown]))
    shard = F.array_min(F.slice("_draws", 1, n))["shard"]
    return drawn.withColumns({"shard": shard, "grown_shard": F.array_min("_draws")["shard"]}).drop("_draws")


def shard_table(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """Per row: key, size and checksum of its text, its shard, its slot there and its shard after growth by one.

    The text itself never moves: only ids, sizes and checksums are sorted for the slots.
    """
    measured = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = stored(assign(measured, key, weights, weights[-1:]), "shards")
    out = numbered(placed, ["shard"], [key, "size", "text_crc32"], "slot", "shard-slots")
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def export(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS) -> None:
    """Write the rows as one folder per shard. A salt lets several tasks write a large shard."""
    placed = assign(docs, key, weights)
    salted = placed.drop("grown_shard").repartition("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8)))
    salted.write.partitionBy("shard").parquet(path)
