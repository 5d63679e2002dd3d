"""Chat formatting by schema fingerprints.

A record is JSON text in one of many layouts. The nested field paths of each record, without the
types of its leaves, are hashed; the hash selects a declarative mapping that reads the record into
canonical turns (role, text). A template then marks the turns, and a loss mask of spans covers the
assistants' texts. Control strings inside texts are escaped, so the formatted text reads back to
exactly the turns it was made of.

All of it is built-in functions on the JVM.

Records of any length go this way. The fingerprint is taken from a record's skeleton, in which string
values are empty and equal neighbours in a list are one, so it stays small; a mapping reads the fields
that its schema names from the record itself.

Nulls, ties, repeats: null roles and texts are empty; a record whose layout no mapping knows, or
that the parser refuses, keeps null turns and null output; an empty list of turns gives an empty text.
Turns of equal number go by role, then text; repeated records are formatted each for itself.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role:string,text:string>>"
#: Strings of any length are read.
_READER = {"maxStringLen": str((1 << 31) - 1)}

# The strings that mark turns.
CONTROL = r"(?:<</?(?:SYS|ROLE)>>|\[/?INST\]|</?s>)"
MARKS = {
    "system": ("<<SYS>> ", " <</SYS>>\n"),
    "user": ("[INST] ", " [/INST]\n"),
    "assistant": ("<s> ", " </s>\n"),
}
OTHER_ROLE = ("<<ROLE>> ", " <</ROLE>> ", " </s>\n")
_ESCAPABLE = rf"\\*{CONTROL}"
_ESCAPED = rf"\\(\\*{CONTROL})"
_SEGMENT = r"(?s)(?:<<SYS>>|\[INST\]|<s>|<<ROLE>>) .*? (?:<</SYS>>|\[/INST\]|</s>)\n"
_OTHER = r"(?s)^<<ROLE>> (.*?) <</ROLE>> (.*) </s>\n$"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``schema`` holds its field paths, in alphabetical order.

    ``single`` maps top-level text fields to roles, in order of the turns; ``listed`` then names a
    list of messages and their role and text fields.
    """

    name: str
    schema: str
    single: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.schema.encode()).hexdigest()[:16]

    def turns(self, record: Column) -> Column:
        """``record`` is the JSON text."""
        fields = [f"`{field}` string" for field, _ in self.single]
        if self.listed:
            path, role, text = self.listed
            fields.append(f"`{path}` array<struct<`{role}`:string,`{text}`:string>>")
        read = F.from_json(record, ", ".join(fields), _READER)
        fixed = [F.struct(F.lit(role).alias("role"), F.coalesce(read[field], F.lit("")).alias("text")) for field, role in self.single]
        out = F.array(*fixed).cast(_TURNS)
        if self.listed:

            def canonical(m: Column) -> Column:
                own = F.coalesce(m[role], F.lit(""))
                for theirs, ours in self.roles:
                    own = F.when(m[role] == theirs, F.lit(ours)).otherwise(own)
                return F.struct(own.alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))

            out = F.concat(out, F.transform(F.coalesce(read[path], F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), canonical).cast(_TURNS))
        return out


_SHARE = (("human", "user"), ("gpt", "assistant"))
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", listed=("messages", "role", "content")),
    Mapping("system_messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>, system>", (("system", "system"),), ("messages", "role", "content")),
    Mapping("share", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", listed=("conversations", "from", "value"), roles=_SHARE),
    Mapping("prompt", "OBJECT<prompt, response>", (("prompt", "user"), ("response", "assistant"))),
    Mapping("system_prompt", "OBJECT<prompt, response, system>", (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", "OBJECT<instruction, output>", (("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", "OBJECT<input, instruction, output>", (("instruction", "system"), ("input", "user"), ("output", "assistant"))),
)


def skeleton(record: Column) -> Column:
    """The JSON text with empty strings as values, and one of each run of equal flat objects in a list."""
    text = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    # from one value to the next: whatever is no string, and keys
    bare = F.regexp_replace(record, rf'(?s)\G([^"]*+(?:{text}\s*+:[^"]*+)*+){text}', '$1""')
    return F.regexp_replace(bare, r"(\{[^{}\[\]]*+\})(?:\s*,\s*\1)++", "$1")


def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON text, without the types of the leaves; null if it is none."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(skeleton(record))), r": (?!OBJECT|ARRAY)[A-Z_]+(?:\([0-9,]+\))?", "")


def fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(field_paths(record).cast("binary"), 256), 1, 16)


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` to JSON records."""
    marked = records.withColumn("fingerprint", fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        mine = F.col("fingerprint") == m.fingerprint
        layout = F.when(mine, F.lit(m.name)).otherwise(layout)
        turns = F.when(mine, m.turns(F.col(record))).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns})


def escape(text: Column) -> Column:
    """Put one backslash before every control string, and before any backslashes that precede it."""
    return F.regexp_replace(text, _ESCAPABLE, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_mask``: spans (first, length in code points) of the assistants' texts."""

    def marks(role: Column, side: int) -> Column:
        other = F.concat(F.lit(OTHER_ROLE[0]), escape(role), F.lit(OTHER_ROLE[1])) if side == 0 else F.lit(OTHER_ROLE[2])
        for known, pair in MARKS.items():
            other = F.when(role == known, F.lit(pair[side])).otherwise(other)
        return other

    def segment(t: Column) -> Column:
        return F.struct(
            marks(t["role"], 0).alias("before"), escape(t["text"]).alias("body"), marks(t["role"], 1).alias("after"), (t["role"] == "assistant").alias("loss")
        )

    long = lambda c: c.cast("long")
    start = F.struct(long(F.lit(0)).alias("at"), F.array().cast("array<struct<first:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + F.char_length(s["before"])
        body = long(F.char_length(s["body"]))
        span = F.array(F.struct(first.alias("first"), body.alias("length")))
        return F.struct(
            (first + body + F.char_length(s["after"])).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    with_parts = df.withColumn("_segments", F.transform(turns, segment))
    return with_parts.withColumns(
        {
            "formatted": F.array_join(F.transform("_segments", lambda s: F.concat(s["before"], s["body"], s["after"])), ""),
            "loss_mask": F.aggregate("_segments", start, step, lambda acc: acc["spans"]),
        }
    ).drop("_segments")


def read_back(df: DataFrame, name: str = "read_turns") -> DataFrame:
    """Add the turns that the formatted text holds, read from that text alone."""

    def turn(s: Column) -> Column:
        role = unescape(F.regexp_extract(s, _OTHER, 1))
        body = F.regexp_extract(s, _OTHER, 2)
        for known, (before, after) in MARKS.items():
            mine = s.startswith(before)
            role = F.when(mine, F.lit(known)).otherwise(role)
            body = F.when(mine, F.substring(s, F.lit(len(before) + 1), F.char_length(s) - len(before) - len(after))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return df.withColumn(name, F.transform(F.regexp_extract_all("formatted", F.lit(_SEGMENT), F.lit(0)), turn))


def loss_text(formatted: Column, mask: Column) -> Column:
    """What the mask covers, unescaped, joined without separators."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["first"] + 1).cast("int"), m["length"].cast("int")))), "")


def records_of(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn -> one JSON ``record`` per conversation, in the layout that suits its roles.

    A conversation is one record of the output, so its rows come together; it is the unit that
    grows with its own length only.
    """
    own = F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    grouped = rows.select(conversation, own.alias("_o")).groupBy(conversation).agg(F.sort_array(F.collect_list("_o")).alias("_m"))
    roles = F.transform("_m", lambda m: m["role"])
    are = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    at = lambda i: F.get("_m", F.lit(i))["content"]
    messages = lambda c: F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(are("system", "user", "assistant"), F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("input"), at(2).alias("output"))))
        .when(
            (F.get(roles, F.lit(0)) == "system") & (F.size("_m") > 1),
            F.to_json(F.struct(at(0).alias("system"), messages(F.slice("_m", F.lit(2), F.size("_m"))).alias("messages"))),
        )
        .otherwise(F.to_json(F.struct(messages(F.col("_m")).alias("messages"))))
    )
    return grouped.select(conversation, record.alias("record"))
