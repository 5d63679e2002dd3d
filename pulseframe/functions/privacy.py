"""Masks for what identifies a person: nested JSON by key, and account numbers in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import short_hash

# Parts of keys whose values are places, and whole keys (after a dot, too) whose values are identifiers.
GEO_PARTS = ("lat", "lon", "lng", "latitude", "longitude", "location", "gps", "coordinate", "address", "altitude")
ID_KEYS = ("uid", "did", "sid", "mac", "sn", "serial", "device_?id", "user_?id")

_GEO = f"(?:{'|'.join(GEO_PARTS)})"
_ID = rf"(?:[^\"\\]*\.)?(?:{'|'.join(ID_KEYS)})"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A key to be masked, up to its value.
_KEY = rf'"(?=[^"\\]*+"\s*+:)(?i:(?=[^"\\]*?{_GEO}[^"\\]*"|{_ID}"))[^"\\]*+"\s*+:\s*+'
DEPTH = 16
#: Strings and texts between them that make up one piece at most; the pattern's stack grows with it.
RUN = 64


def _value(depth: int) -> str:
    """A JSON value with at most so many levels of lists and objects; the pattern never backtracks into one."""
    inner = ""
    for _ in range(depth):
        inner = rf'[\[{{](?>[^\[\]{{}}"]++|{_STRING}{"|" + inner if inner else ""})*+[\]}}]'
    return rf'(?:{_STRING}|[^\s,:\[\]{{}}"]++|{inner})'


def scrub_json(text: Column, depth: int = DEPTH) -> Column:
    """The JSON text with the values of place and identifier keys masked at any level, all else byte for byte.

    A place becomes ``"<redacted>"``, an identifier the short hash of its text (of a string's content),
    be it a scalar, a list or an object. The text is cut into members whose key is to be masked and what
    lies between them; pieces are judged one by one and joined again. Where a value to be masked is
    nested deeper than ``depth`` or broken off, the whole text is masked rather than let through. Null
    stays null; a text that is no JSON is cut in the same way.
    """
    key, other = rf"{_KEY}(?:{_value(depth)}|(?=[\[{{\"]))", rf'(?:(?!{_KEY}){_STRING}|[^"]++){{1,{RUN}}}+'
    pieces = F.regexp_extract_all(text, F.lit(rf'(?s){key}|{other}|{_STRING}|"'), F.lit(0))
    parts = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, rf"(?s)^({_KEY})", 1).alias("head"), p.alias("all")))
    value = lambda p: F.substr(p["all"], F.char_length(p["head"]) + 1)
    content = lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)

    def masked(p: Column) -> Column:
        mask = F.when(p["head"].rlike(rf'^"[^"]*(?i:{_GEO})'), F.lit("<redacted>")).otherwise(short_hash(F.coalesce(content(value(p)), value(p))))
        return F.when(p["head"] == "", p["all"]).otherwise(F.concat(p["head"], F.lit('"'), mask, F.lit('"')))

    def joined(ps: Column) -> Column:
        unfit = F.exists(ps, lambda p: (p["head"] != "") & (value(p) == ""))
        return F.when(unfit, F.lit('"<redacted>"')).otherwise(F.array_join(F.transform(ps, masked), ""))

    return F.get(F.transform(F.array(parts), joined), F.lit(0))  # a list of one, so that the text is cut once


def mask_account(name: Column) -> Column:
    """A file name ``<digits>_<account>_<rest>`` without the account number."""
    return F.regexp_replace(name, r"^(\d+_)\d+(_)", "$1<account>$2")
