"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Best fit looks at lengths only, and documents of one length are interchangeable. So the plan is
made from the histogram of piece lengths, which has at most ``capacity`` entries at any scale: for
each length, from long to short, a segment tree over remaining capacities finds the tightest open
sequences in logarithmic time, and whole runs of equal sequences are filled at once. The plan is
that of handling all pieces one by one. Pieces then look up their place by length and rank; ranks
come from a range sort (see :func:`~pulseframe.llm.common.numbered`), so that neither a frequent
length nor the corpus ever meets in one task.

Nulls, ties, repeats: a null text is an empty one and gives the end token alone; pieces of equal
length go by id, number and content; repeated rows are packed each for itself; an empty table
gives no sequences. Very long texts are cut into full pieces and a rest. Other columns are not
carried, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .common import numbered, release, stored

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers.
REMEMBERED = 250_000

# The normalizer and word pattern of the tokenizer whose words may be remembered.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER = r"a-z\xdf-\xf6\xf8-\xff"
_SIMPLE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+").findall
#: Texts of these characters alone are in normal form, and their letters are those of _LETTER.
_NOT_SIMPLE = re.compile(r"[^\x20-\x7e\t\n\r\xc0-\xff]").search


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary lies; drivers and executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Where the tokenizer splits texts into words by a known pattern and a text has Latin characters
    only, the ids of its words are remembered; other texts go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        first = (splitter.get("pretokenizers") or [{}])[0]
        self.by_word = (
            [x["type"] for x in normalizer.get("normalizers", [])] == _NORMALIZERS
            and first.get("pattern", {}).get("Regex") == _WORDS
            and not spec.get("post_processor")
        )
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        suffix = spec.get("model", {}).get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of single words: encoded as one spaced text, and cut where a token ends a word."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._plain(words)
        data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words. ASCII words stand for themselves at byte level and go to the model alone."""
        tokenize = self.model.tokenize
        rest = []
        for w in words:
            if w.isascii():
                self.words[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
            else:
                rest.append(w)
        self.words.update(zip(rest, self._each(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._plain(texts)
        split = [None if _NOT_SIMPLE(t) or any(s in t for s in self.special) else _SIMPLE_WORDS(t.lower()) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self._learn(list(set().union(*(ws for ws in split if ws)) - self.words.keys()))
        get = self.words.__getitem__
        rest = [i for i, ws in enumerate(split) if ws is None]
        out = [b"" if ws is None else b"".join(map(get, ws)) for ws in split]
        for i, ids in zip(rest, self._plain([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokens: bool = False) -> DataFrame:
    """Tokenise and cut: one row per piece with ``piece``, ``start``, ``length``, ``ids_crc32``.

    With ``tokens``, also ``ids``: the piece's ids as little-endian 32-bit binary, which
    ``ids_crc32`` is the checksum of.
    """
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * tokens
    schema = StructType([docs.schema[key], *StructType.fromDDL(fields).fields])
    types = to_arrow_schema(schema)
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            texts = batch.column("_text")
            for lo in range(0, batch.num_rows, 256):
                rows, out = [], []
                for i, ids in enumerate(encode([t or "" for t in texts.slice(lo, 256).to_pylist()]), lo):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(i)
                        out.append((piece, at // 4, len(part) // 4, zlib.crc32(part), *[part] * tokens))
                columns = [pa.array(c, types.field(j + 1).type) for j, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), *columns], names=schema.names)
        release()

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


class SegmentTree:
    """The tightest open remaining capacity, by a tree of 'something is open below here'."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            now = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == now:
                break
            self.open[i] = now

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least ``need``."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: pieces}.

    Returns runs (length, first rank, pieces, first sequence, offset): the pieces of that length
    whose ranks lie in the run go to consecutive sequences, all at the offset.
    """
    tree = SegmentTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> (first sequence, how many)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0

    def add(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_[remaining].append((first, n))
            tree.put(remaining, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                n = -(-left // (capacity // length))
                first, made = made, made + n
            else:
                first, n = open_[remaining].pop()
                if not open_[remaining]:
                    tree.put(remaining, False)
            # the tightest sequence stays the tightest until the length no longer fits
            each = remaining // length
            full, over = min(n, left // each), left % each if left < n * each else 0
            offset = capacity - remaining
            for j in range(each):
                if full:
                    runs.append((length, rank, full, first, offset + j * length))
                    rank += full
            for j in range(over):
                runs.append((length, rank, 1, first + full, offset + j * length))
                rank += 1
            add(remaining - each * length, first, full)
            if over:
                add(remaining - over * length, first + full, 1)
            untouched = n - full - bool(over)
            add(remaining, first + full + bool(over), untouched)
            left -= full * each + over
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``; other columns of the pieces stay."""
    spark = cut.sparkSession
    order = [key, "piece", "start", *(["ids_crc32"] if "ids_crc32" in cut.columns else [])]
    ranked = numbered(cut, ["length"], order, "_rank", "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().toLocalIterator()}  # at most `capacity` rows
    runs = sorted(best_fit(histogram, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)
    schema = StructType([*[f for f in ranked.schema.fields if f.name != "_rank"], *StructType.fromDDL("sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        firsts = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(firsts, (length << 44) + rank, "right") - 1
            own = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])], names=schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sequences themselves: ``ids`` of the pieces joined in order, and where each document lies.

    Needs pieces made with ``tokens=True``. A group is one sequence, at most ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(key), "piece", "length")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("_p"))
        .select(
            "sequence_id",
            F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
            F.transform("_p", lambda p: F.struct(p[key].alias(key), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("parts"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokens: bool = False) -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(stored(pieces(docs, tokenizer, key, text, capacity, tokens), "tokenised"), capacity, key)
