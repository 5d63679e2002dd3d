"""Exact ranks of one large key's values, spread over the cluster.

Equal values are counted first, before any shuffle. The distinct values are dealt out by ranges, each
range is summed up, and what lies before a range is a sum over one row per range. So no task sorts all
values of a key, and without keys nothing is a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored


def running_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _v, _c, _upto): each distinct value with its count and how many values of its key are no greater.

    Nulls are left out; NaN is the greatest value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored(counts.repartitionByRange(parts, *keys, "_v").withColumn("_range", F.spark_partition_id()), "ranks")
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_local", F.sum("_c").over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = own.join(offsets, [F.col("_range") == F.col("_r"), *same])
    return joined.select(*keys, "_v", "_c", (F.col("_local") + F.col("_before")).alias("_upto"))


def mean_ranks(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _v, _rank): the rank of each distinct value, ties at their mean."""
    return running_counts(df, column, keys).select(*keys, "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias("_rank"))


def quantiles(df: DataFrame, column: str, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Quantiles by the exclusive method, per key: place (n + 1) p between its two neighbours.

    Running counts find the neighbours, so no row holds a key's values. Null where a key has a single value.
    """
    running = running_counts(df.withColumn("_x", F.col(column).cast("double")), "_x", keys)
    total = running.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    n, least = F.col("_n"), lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_v")))
    place = lambda p: (n + 1) * F.lit(float(p))
    lower = lambda p: F.greatest(F.lit(1), F.least(n - 1, F.floor(place(p))))
    name = lambda p: f"q{round(p * 100)}"
    renamed = total.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = running.join(F.broadcast(renamed)) if not keys else running.join(renamed, same)  # without keys one row
    neighbours = both.groupBy(*keys, "_n").agg(*[least(lower(p) + i).alias(f"_{name(p)}_{i}") for p in points for i in (0, 1)])
    at = lambda p, i: F.col(f"_{name(p)}_{i}")
    return neighbours.select(*keys, *[F.when(n > 1, at(p, 0) + (at(p, 1) - at(p, 0)) * (place(p) - lower(p))).alias(name(p)) for p in points])


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per key, ties at mean ranks; null where a side has one value only.

    Equal pairs are counted before ranks are joined to them, so a hot pair is one row.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = known.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    for side, column in (("_x", x), ("_y", y)):
        ranks = mean_ranks(known, column, keys).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumnsRenamed({"_v": "_value", "_rank": f"{side}_rank"})
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        pairs = pairs.join(ranks, [F.col(side) == F.col("_value"), *same]).drop("_value", *[f"_k{i}" for i in range(len(keys))])
    w, a, b = F.col("_w"), F.col("_x_rank"), F.col("_y_rank")
    sums = pairs.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"))
    middle = F.col("n") * ((F.col("n") + 1) / 2) ** 2  # ranks have the mean (n + 1) / 2
    rho = F.try_divide(F.col("_ab") - middle, F.sqrt((F.col("_aa") - middle) * (F.col("_bb") - middle)))
    return sums.select(*keys, rho.alias("rho"), "n")
