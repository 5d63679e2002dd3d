"""JSON columns of unknown layout: their paths, and bounded statistics of the values at each path.

A text is parsed once, in the task that reads it, and walked there. What leaves a task are values
(:func:`json_values`) or, for paths and statistics, only what the task has counted. Paths read
``a.b[].c``; a list gives its length as ``a.b[].#len`` and its elements as ``a.b[]``. Only scalars and
lengths are values. Nodes deeper than the limit are left out, as the depth is the feature; lists are
walked whole.

Types are those of Spark's variants: whole numbers of 64 bits are BIGINT, other numbers without an
exponent DECIMAL up to 38 digits, all other numbers DOUBLE. As there, a text with an object that names a
key twice is no JSON, and what follows the outermost object or list is not looked at.

Nulls, ties, repeats: texts that are null or no JSON object or list have no values; JSON nulls and empty
strings are values that count as empty; equal counts are listed by value; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import stored

DEPTH, DISTINCT_KEPT = 8, 30
_NUMERIC = ("BIGINT", "DECIMAL", "DOUBLE", "NUMSTR")
_NUMBER = re.compile(r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*[\x85\u2028\u2029]?\Z", re.ASCII)
#: Paths whose names a task remembers.
_NAMES = 100_000

#: (path, type, value as text; that of a double as Python writes it)
Value = tuple[str, str, str | None]


def _number(text: str) -> tuple[str, str]:
    """Type and value of a JSON number."""
    plain = text.lstrip("-")
    if plain.isdigit():
        n = int(text)
        if -(1 << 63) <= n < 1 << 63:
            return "BIGINT", str(n)
    whole, dot, part = plain.partition(".")
    if plain.replace(".", "").isdigit() and len(part) <= 38 and len((whole + part).lstrip("0")) <= 38:
        kept = whole + "." + part.rstrip("0") if part.strip("0") else whole
        return "DECIMAL", kept if kept == "0" or text[0] != "-" else "-" + kept
    return "DOUBLE", repr(float(text))


def _integer(text: str) -> tuple[str, str]:
    return ("BIGINT", text) if len(text) < 19 and text != "-0" else _number(text)


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key twice")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _valid(text: str) -> str:
    """The text as UTF-8 can hold it."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _walker(depth: int) -> Callable[[str | None], list[Value]]:
    """A function from a text to its values, down to a depth."""
    decode = json.JSONDecoder(object_pairs_hook=_unique, parse_float=_number, parse_int=_integer, parse_constant=_no_constant).raw_decode
    names: dict[tuple[str, str], str] = {}
    number = _NUMBER.match

    def walk(path: str, node: dict | list, level: int, out: list[Value]) -> None:
        if type(node) is dict:
            if level == depth:
                return
            members = []
            for key, v in node.items():
                name = names.get((path, key))
                if name is None:
                    if len(names) >= _NAMES:
                        names.clear()
                    name = names[path, key] = f"{path}.{_valid(key)}" if path else _valid(key)
                members.append((name, v))
        else:
            below = path + "[]"
            out.append((below + ".#len", "BIGINT", str(len(node))))
            if level == depth:
                return
            members = [(below, v) for v in node]
        for name, v in members:
            kind = type(v)
            if kind is str:
                out.append((name, "NUMSTR" if number(v) else "STRING", v if v.isascii() else _valid(v)))
            elif kind is tuple:
                out.append((name, *v))
            elif kind is dict or kind is list:
                walk(name, v, level + 1, out)
            elif v is None:
                out.append((name, "VOID", None))
            else:
                out.append((name, "BOOLEAN", "true" if v else "false"))

    def values(text: str | None) -> list[Value]:
        own = "" if text is None else text.lstrip(" \t\r\n")
        if not own.startswith(("{", "[")):
            return []
        try:
            root = decode(own)[0]
        except (ValueError, RecursionError):
            return []
        out: list[Value] = []
        walk("", root, 0, out)
        return out

    return values


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def json_values(df: DataFrame, column: str, depth: int = DEPTH, keep: Sequence[str] = ()) -> DataFrame:
    """A row per value in the JSON texts: the columns in ``keep``, ``path``, ``type``, and ``value`` as text."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _walker(depth)
        for batch in batches:
            found, rows = [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                here = values(text)
                found += here
                rows += [i] * len(here)
            path, kind, value = zip(*found, strict=True) if found else ((), (), ())
            double = [float(v) if k == "DOUBLE" else None for k, v in zip(kind, value, strict=True)]
            text = [None if k == "DOUBLE" else v for k, v in zip(kind, value, strict=True)]
            kept = [batch.column(n).take(pa.array(rows, pa.int64())) for n in range(len(keep))]
            arrays = [*kept, pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(double, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "path", "type", "_text", "_double"])

    found = df.select(*keep, F.col(column).alias("_json")).mapInArrow(run, _ddl(df, keep) + "path string, type string, _text string, _double double")
    return found.select(*keep, "path", "type", F.coalesce("_text", F.col("_double").cast("string")).alias("value"))


def _tallied(df: DataFrame, column: str, depth: int, keys: Sequence[str], most: int) -> DataFrame:
    """What each task has seen, by path: (keys, path, _part, _key, _n, _least, _most).

    Parts: ``type`` with counts by type and extremes of numbers, ``empty`` with counts by type, ``value``
    with counts by value, and ``over`` once a task has seen more than ``most`` values, of which it then
    keeps none. Without ``most`` there are only types, empty values among them.
    """
    own = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _walker(depth)
        types: dict[tuple, list] = {}
        empty: Counter = Counter()
        plain: Counter = Counter()
        seen: dict[tuple, list[Counter] | None] = defaultdict(lambda: [Counter(), Counter()])
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(len(own) + 1)]
            for *key, text in zip(*columns, strict=True):
                at = tuple(key)
                if not most:
                    plain.update([(at, path, kind) for path, kind, _ in values(text)])
                    continue
                for path, kind, value in values(text):
                    if not value:
                        empty[at, path, kind] += 1
                        continue
                    t = types.get((at, path, kind))
                    if t is None:
                        t = types[at, path, kind] = [0, None, None]
                    t[0] += 1
                    if kind in _NUMERIC and value[-1] not in "\u2028\u2029":  # which a cast does not trim
                        number = float(value)
                        if t[1] is None or number < t[1]:
                            t[1] = number
                        if t[2] is None or number > t[2]:
                            t[2] = number
                    # how Spark writes a double is not known here, so doubles are counted beside the texts
                    counts = seen[at, path]
                    if counts is not None:
                        counts = counts[kind == "DOUBLE"]
                        counts[value] += 1
                        if len(counts) > most:
                            seen[at, path] = None
        out = [(*at, path, "type", kind, None, *t) for (at, path, kind), t in types.items()] + [(*at, path, "empty", kind, None, n, None, None) for (at, path, kind), n in empty.items()]
        out += [(*at, path, "type", kind, None, n, None, None) for (at, path, kind), n in plain.items()]
        for (at, path), counts in seen.items():
            if counts is None:
                out.append((*at, path, "over", None, None, 1, None, None))
            else:
                out += [(*at, path, "value", v, None, n, None, None) for v, n in counts[0].items()] + [(*at, path, "value", None, float(v), n, None, None) for v, n in counts[1].items()]
        if out:
            names = [*own, "path", "_part", "_text", "_double", "_n", "_least", "_most"]
            kinds = [*key_types, pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [to_arrow_type(df.schema[k].dataType) for k in own]
    columns = "path string, _part string, _text string, _double double, _n long, _least double, _most double"
    found = df.select(*own, F.col(column).alias("_json")).mapInArrow(run, _ddl(df, own) + columns)
    return found.select(*own, "path", "_part", F.coalesce("_text", F.col("_double").cast("string")).alias("_key"), "_n", "_least", "_most")


def json_paths(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """(path, type, n): how often each path holds a value of each type."""
    types = _tallied(df, column, depth, (), 0).where("_part = 'type'")
    return types.groupBy("path", F.col("_key").alias("type")).agg(F.sum("_n").alias("n"))


def value_stats(df: DataFrame, column: str, depth: int = DEPTH, keys: Sequence[str] = (), most: int = DISTINCT_KEPT) -> DataFrame:
    """Per path: values, empty ones, types with counts, extremes of numbers, and the distinct values with counts.

    Tasks keep at most ``most`` distinct values of a path and then only a mark that there are more;
    sets of that size are what is shuffled and merged, so a path of instants costs no more than one of
    codes. ``distinct`` and ``values`` are null where there are more than ``most``, whatever the tasks
    were dealt.
    """
    own = [*keys, "path"]
    merged = _tallied(df, column, depth, keys, most).groupBy(*own, "_part", "_key").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    merged = stored(merged, "tallies")  # read three times below, so that texts are not parsed as often
    part = lambda p: F.col("_part") == p
    listed = lambda what, sep: F.array_join(F.transform(F.sort_array(F.collect_list(what)), lambda s: F.concat(s["key"], F.lit(":"), (-s["n"]).cast("string"))), sep)
    by_count = F.struct((-F.col("_n")).alias("n"), F.col("_key").alias("key"))
    sums = merged.groupBy(*own).agg(
        F.sum(F.when(part("type") | part("empty"), F.col("_n"))).alias("n"), F.coalesce(F.sum(F.when(part("empty"), F.col("_n"))), F.lit(0).cast("long")).alias("empty"),
        listed(F.when(part("type"), by_count), ",").alias("types"), F.min("_least").alias("least"), F.max("_most").alias("most"),
        F.count_if(part("value")).alias("_values"), F.bool_or(part("over")).alias("_over"),
    )
    few = sums.where(~F.col("_over") & (F.col("_values") <= most))
    named = merged.where(part("value")).join(few.select(*own), own).groupBy(*own).agg(listed(by_count, ", ").alias("values"))
    within = ~F.col("_over") & (F.col("_values") <= most)
    return sums.withColumn("distinct", F.when(within, F.col("_values"))).drop("_values", "_over").join(named, own, "left").withColumn(
        "values", F.when(F.col("distinct") == 0, F.lit("")).otherwise(F.col("values"))
    )
