"""Quality rules as a bitmask ledger.

:func:`ledger` evaluates every rule once and keeps what it measured and one failure bit per rule.
Policies are named sets of rules: :func:`apply_policy` decides from the stored bits alone, and
:func:`ablation` tells what each rule of a policy removes by itself, without reading a text again.

A null text is an empty one; it has no words and fails ``few_words``. Rows are judged one by one,
so repeated rows and ids do not matter and nothing can tie but lines and windows of one text, of which
the first is the original; very long texts are read whole; an empty table gives an empty ledger. Columns of the input
other than the key and the text are not carried over, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_SPACES = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5


def rules() -> dict[str, Column]:
    """The rules in the order of their bits, true where a text fails; new rules go to the end."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")),
        "symbols": 4 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "capitals": 2 * c("n_capitals") > c("word_chars"),
    }


POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "capitals"),
}


def mask(policy: str | Iterable[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    order = list(rules())
    return sum(1 << order.index(x) for x in set(names))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, and only where this expression is."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash comes twice or more in the array."""
    n = F.lit(WINDOW)

    def twice(s: Column) -> Column:
        same = lambda e, at: F.coalesce(e["h"] == F.get(s, at)["h"], F.lit(False))
        return F.filter(F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"])), lambda i: i.isNotNull())

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(n, F.coalesce(F.get(p, k + 1) - i, n)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        _let(tagged, lambda s: _let(F.sort_array(twice(s)), covered))
    )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements of every text, each a long.

    Windows are compared by 64-bit hash within their own text.
    """
    word = lambda x: x != ""
    split = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).select(
        key,
        "_t",
        F.filter(F.split("_t", _SPACES), word).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(_NOT_SPACE)).alias("_l"),
    )
    hashed = split.withColumns(
        {
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
            "_c": F.array_join("_w", ""),
        }
    )
    at = lambda i, j: F.get(F.col("_h"), i + j)
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = hashed.withColumn("_g", F.transform(starts, lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)])))
    measures = {
        "n_words": F.size("_w"),
        "word_chars": F.char_length("_c"),
        "n_symbols": F.char_length(F.regexp_replace("_t", _NOT_SYMBOL, "")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _repeated_words(F.col("_g")),
        "n_capitals": F.char_length(F.regexp_replace("_c", "[^A-Z]+", "")),
    }
    return windows.select(key, *[m.cast("long").alias(k) for k, m in measures.items()])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``failed``: bit i is set where rule i of :func:`rules` fails."""
    measured = measure(docs, key, text)
    bits = F.lit(0).cast("long")
    for i, fails in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", bits)


def stored_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: filters by policy then read bits, and measure no text again.

    A filter on an unwritten ledger would be pushed down to the texts, with the measurements that it needs.
    """
    return stored(ledger(docs, key, text), "ledger")


def apply_policy(entries: DataFrame, policy: str | Iterable[str], name: str = "kept") -> DataFrame:
    """Add a boolean: no rule of the policy failed."""
    return entries.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(entries: DataFrame, policy: str | Iterable[str]) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it removes.

    The ledger is first counted by its bits, which has at most 2**rules groups.
    """
    m = mask(policy)
    by_bits = entries.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    order = list(rules())
    names = [x for i, x in enumerate(order) if m >> i & 1]
    each = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << order.index(x)).cast("long").alias("bit")) for x in names])
    return (
        by_bits.select("bits", "n", F.explode(each).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        )
    )
