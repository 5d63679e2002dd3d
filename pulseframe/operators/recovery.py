"""Recovery score and rule-based readiness."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Readiness, Recovery
from ..functions.scores import band, clip, normal_cdf

OPERATORS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
# The names that rules use, and the columns they stand for.
FIELDS = {
    "recovery.status": "recovery_status", "recovery.score": "recovery", "recovery.band": "recovery_band", "rhr.z": "rhr_z", "rhr.flag": "rhr_flag",
    "sleep.z": "tst_z", "sleep.flag": "tst_flag", "sleep.tst_min": "tst_min", "acwr.value": "acwr", "acwr.status": "acwr_status", "load.yesterday": "load_yesterday",
}
#: What speaks where there is no score.
REASONS = {"warming_up": "baseline needs 14 valid nights on this device", "insufficient_data": "resting HR or sleep missing for this night"}


@dataclass(frozen=True)
class Component:
    """One part of the score: the z-score of a baseline (by its prefix), turned so that more is better."""

    name: str
    prefix: str
    better: int  # 1: high values are good, -1: low ones
    weight: float = 0.0
    required: bool = False

    def cell(self, have: Sequence[str]) -> Column:
        """Its place in the score's array: z (null unless its baseline stands), weight, and what it means to lack it."""
        z, status = f"{self.prefix}_z", f"{self.prefix}_base_status"
        there = z in have and status in have
        value = F.when(F.col(status) == "ok", clip(self.better * F.col(z), -3, 3)) if there else F.lit(None).cast("double")
        young = F.coalesce(F.col(status) == "warming_up", F.lit(False)) if status in have else F.lit(False)
        return F.struct(
            value.alias("z"), F.lit(self.weight).alias("weight"), (F.lit(self.required) & value.isNull()).alias("missing"), (F.lit(self.required) & young).alias("young")
        )


#: The parts that there are; configuration gives them weights.
COMPONENTS = (Component("rhr", "rhr", -1), Component("sleep", "tst", 1))


def components(r: Recovery) -> list[Component]:
    """The configured parts, by their weights."""
    out = [replace(c, weight=float(r.weights[c.name]), required=c.name in r.required) for c in COMPONENTS if c.name in r.weights]
    if missing := set(r.required) - {c.name for c in out}:
        raise ValueError(f"required components without a weight: {sorted(missing)}")
    return out


def recovery(wide: DataFrame, r: Recovery = Recovery()) -> DataFrame:
    """Add the score, its split into points, its band, and a status with reason.

    The score is the percentile of the weighted z-scores, were they independent. The points add up
    to the score less 50. Without a required component there is no score. The parts are one array:
    a fold over it gives the sum and what is missing, a transform of it the points.
    """
    parts = components(r)
    spread = math.sqrt(sum(c.weight**2 for c in parts))

    def add(total: Column, part: Column) -> Column:
        known = F.coalesce(part["z"], F.lit(0.0))
        return F.struct(
            (total["sum"] + part["weight"] * known).alias("sum"), (total["missing"] | part["missing"]).alias("missing"), (total["young"] | part["young"]).alias("young")
        )

    nothing = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("missing"), F.lit(False).alias("young"))
    folded = wide.withColumn("_parts", F.array(*[c.cell(wide.columns) for c in parts])).withColumn("_total", F.aggregate("_parts", nothing, add))
    status = F.when(~F.col("_total.missing"), "ok").when(F.col("_total.young"), "warming_up").otherwise("insufficient_data")
    scored = folded.withColumns({"recovery_status": status, "recovery": F.when(~F.col("_total.missing"), 100 * normal_cdf(F.col("_total.sum") / spread))})
    share = F.transform(
        "_parts", lambda p: F.when(F.col("_total.sum") == 0, F.lit(0.0)).otherwise((F.col("recovery") - 50) * p["weight"] * F.coalesce(p["z"], F.lit(0.0)) / F.col("_total.sum"))
    )
    named = scored.withColumn("_share", F.when(F.col("recovery_status") == "ok", share))
    columns = {f"recovery_z_{c.name}": F.col("_parts")[i]["z"] for i, c in enumerate(parts)} | {f"recovery_pts_{c.name}": F.col("_share")[i] for i, c in enumerate(parts)}
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return named.withColumns(
        columns | {"recovery_band": band(F.col("recovery"), r.bands["low"], r.bands["high"]), "recovery_reason": F.try_element_at(reasons, F.col("recovery_status"))}
    ).drop("_parts", "_total", "_share")


def _term(t: dict, have: set[str]) -> Column:
    if FIELDS[t["field"]] not in have:
        return F.lit(False)
    return F.coalesce(OPERATORS[t["op"]](F.col(FIELDS[t["field"]]), F.lit(t["value"])), F.lit(False))


def _shown(wide: DataFrame, column: str) -> Column:
    """A value as text, doubles to three places."""
    if column not in wide.columns:
        return F.lit(None).cast("string")
    c = F.col(column)
    return F.when(c.isNotNull(), F.format_string("%.3f", c)) if dict(wide.dtypes)[column] == "double" else c.cast("string")


def readiness(wide: DataFrame, cfg: Readiness = Readiness()) -> DataFrame:
    """Add ``readiness_rule`` (the first rule whose terms all hold), its text, and the fields looked at.

    A term on a missing value is false; a rule without terms always holds. Fields are looked at as
    an evaluation from left to right would, which stops at the first false term of a rule.
    """
    unreadable = [t for rule in cfg.rules for t in rule.get("when", []) if t["field"] not in FIELDS or t["op"] not in OPERATORS]
    if unreadable:
        raise ValueError(f"cannot read {unreadable[0]} in a rule: fields are {', '.join(FIELDS)}, comparisons {' '.join(OPERATORS)}")
    have = set(wide.columns)
    rule_of, say = F.lit(None).cast("int"), F.lit(None).cast("string")
    looked: dict[str, Column] = {}
    reached = F.lit(True)
    chosen = []
    for i, rule in enumerate(cfg.rules):
        holds = F.lit(True)
        for t in rule.get("when", []):
            looked[t["field"]] = looked.get(t["field"], F.lit(False)) | (reached & holds)
            holds = holds & _term(t, have)
        chosen.append((i, holds, rule["say"]))
        reached = reached & ~holds
    for i, holds, text in reversed(chosen):
        rule_of, say = F.when(holds, F.lit(i)).otherwise(rule_of), F.when(holds, F.lit(text)).otherwise(say)
    seen = [
        F.when(at, F.concat(F.lit(f"{f}="), F.coalesce(_shown(wide, FIELDS[f]), F.lit("None"))))
        for f, at in looked.items()
    ]
    return wide.withColumns({"readiness_rule": rule_of, "readiness": say, "readiness_inputs": F.concat_ws(", ", *seen)})


def add_recovery_and_readiness(wide: DataFrame, r: Recovery = Recovery(), rules: Readiness = Readiness(), keys: Sequence[str] = ()) -> DataFrame:
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("date")
    before = F.lag("load").over(order) if "load" in wide.columns else F.lit(None).cast("double")
    return readiness(recovery(wide.withColumn("load_yesterday", before), r), rules)
