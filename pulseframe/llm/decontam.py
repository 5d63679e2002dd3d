"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 consecutive words, or all words of a shorter item) are sets of word
shingles. The shingles are counted over all documents and ordered by rarity. A document can hold a
whole window only if it holds the window's necessary prefix, which for full containment is the
rarest shingle. Occurrences of prefix shingles are joined with the windows; the shingle's place in
the window and the bounds of the document say where the window would have to lie (positional and
length bounds), and there all its words are compared.

The items go to the tasks as flat arrays (their words end to end, and per window where it begins
and its prefix: some 25 bytes a word), so a benchmark of millions of windows takes two readings of
the documents: one to count shingles, one to match. Beyond :data:`ROUND` words of items there are
several rounds, of which each counts by itself; matching is one reading even then, and nothing of
the documents is written on the way.

Nulls, ties, repeats: a null text has no words; items without words have no windows; windows that
several items share count for each of them; an item with a null id marks words but is not listed;
ids may have any type that can be ordered; repeated documents are judged row by row; equally rare
shingles go by hash. Very long texts are hashed in segments. Empty tables give no hits or an empty
result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashSet, Texts, count_hashes, hash_runs, list_array, map_texts, utf8, word_array

WINDOW = 13
SHINGLE = 5
#: About the most item words that one round sends to the tasks.
ROUND = 4_000_000


@dataclass
class Windows:
    """Distinct windows of some items, as arrays over the words of all of them."""

    words: Texts  # the items' words, one item per text
    ids: pa.Array  # the items' distinct ids
    begin: np.ndarray  # per window: its first word
    size: np.ndarray  # its number of words
    holders: np.ndarray  # items[holders[i]:holders[i + 1]] are the places in ``ids`` of its items
    items: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows whose shingles have k words, and their hashes, one row per window."""
        own = np.flatnonzero(np.minimum(self.size, SHINGLE) == k)
        n = WINDOW - SHINGLE + 1 if k == SHINGLE else 1
        # a window of fewer shingles repeats its last one
        at = self.begin[own][:, None] + np.minimum(np.arange(n)[None, :], (self.size[own] - k)[:, None])
        return own, hash_runs(self.words.hashes, k)[at]

    def text(self, window: int) -> list[str]:
        return self.words.words(int(self.begin[window]), int(self.begin[window] + self.size[window]))


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> Windows:
    """The distinct windows of the items, on the driver; the items are bounded by their round."""
    spaced = items.select(F.col(key).alias("id"), F.array_join(word_array(F.col(text)), " ").alias("w")).where("w <> ''")
    table = spaced.toArrow().combine_chunks()
    data, offsets = utf8(table.column("w"))
    chunk = Texts(data, offsets, slice(0, table.num_rows))
    n, first = chunk.n_words, chunk.word_at[:-1]
    each = np.maximum(n - size + 1, 1)  # windows of each item
    item = np.repeat(np.arange(len(n)), each)
    begin = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(n, size)[item]
    # equal windows have equal words: two hashes of the whole run tell them apart (128 bits)
    one, two = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
    for k in np.unique(length):
        own = length == k
        one[own] = hash_runs(chunk.hashes, int(k))[begin[own]]
        two[own] = hash_runs(chunk.hashes ^ np.uint64(0x5851F42D4C957F2D), int(k))[begin[own]]
    order = np.lexsort((item, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    at = np.flatnonzero(new)
    encoded = table.column("id").combine_chunks().dictionary_encode()
    coded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
    code = coded.indices.cast(pa.int64()).fill_null(-1).to_numpy()[item[order]]
    group = np.cumsum(new) - 1
    listed = np.unique(np.stack([group[code >= 0], code[code >= 0]], axis=1), axis=0) if len(code) else np.zeros((0, 2), np.int64)
    holders = np.searchsorted(listed[:, 0], np.arange(len(at) + 1))
    return Windows(chunk, coded.dictionary, begin[order][at], length[order][at], holders, listed[:, 1])


def _counts(docs: DataFrame, text: str, windows: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shingle size: the windows' shingles that documents hold, in order, and how often they do."""
    known_of = {k: np.unique(windows.shingles(k)[1]) for k in range(1, SHINGLE + 1)}
    sent = docs.sparkSession.sparkContext.broadcast({k: v for k, v in known_of.items() if len(v)})

    def counter():
        known = {k: HashSet(v) for k, v in sent.value.items()}

        def count(chunk: Texts):
            found = [s.keys[s.find(chunk.runs(k)[0])[1]] for k, s in known.items()]
            return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)

        return count

    # bounded by the round's own shingles, whatever the size of the corpus
    table = count_hashes(docs, text, counter).toArrow()
    h, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    return {k: (h, n) for k in known_of}


def _prefixes(windows: Windows, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By shingle size: prefix hashes in order, and the window and place in it of each.

    A window with a shingle that no document holds is nowhere and has no prefix.
    """
    out = {}
    for k, (h, n) in counts.items():
        own, shingle = windows.shingles(k)
        if not len(own) or not len(h):
            continue
        at = np.minimum(np.searchsorted(h, shingle), len(h) - 1)
        there = (h[at] == shingle).all(axis=1)
        own, shingle, often = own[there], shingle[there], n[at][there]
        rarest = np.lexsort((shingle, often), axis=1)[:, 0] if len(own) else np.zeros(0, np.int64)
        prefix = shingle[np.arange(len(own)), rarest]
        order = np.argsort(prefix, kind="stable")
        out[k] = (prefix[order], own[order], rarest[order])
    return out


def _match(docs: DataFrame, text: str, carry: Sequence[str], windows: Windows, prefixes: dict, kind: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((windows, prefixes))
    id_type = windows.ids.type

    def matcher():
        held, by_size = sent.value
        known = [(k, HashSet(p), p, window, place) for k, (p, window, place) in by_size.items() if len(p)]

        def match(chunk: Texts):
            spans, items = defaultdict(list), defaultdict(set)
            for k, s, prefix, window, offset in known:
                h, at = chunk.runs(k)
                places, keys = s.find(h)
                docs_of = np.searchsorted(chunk.word_at, at[places], "right") - 1
                lows, highs = np.searchsorted(prefix, s.keys[keys]), np.searchsorted(prefix, s.keys[keys], "right")
                for place, d, low, high in zip(at[places].tolist(), docs_of.tolist(), lows.tolist(), highs.tolist(), strict=True):
                    for i in range(low, high):
                        w, lo = int(window[i]), place - int(offset[i])
                        hi = lo + int(held.size[w])
                        if lo < chunk.word_at[d] or hi > chunk.word_at[d + 1] or chunk.words(lo, hi) != held.text(w):
                            continue
                        spans[d].append((lo - int(chunk.word_at[d]), hi - int(chunk.word_at[d])))
                        items[d].update(held.items[held.holders[w] : held.holders[w + 1]].tolist())
            merged = [_merged(spans[d]) if d in spans else [] for d in range(chunk.n)]
            flat = np.array([x for m in merged for x in m], np.int64).reshape(-1, 2)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["first", "end"])
            listed = [sorted(items[d]) if d in items else [] for d in range(chunk.n)]
            ids = held.ids.take(pa.array([i for own in listed for i in own], pa.int64())) if len(held.ids) else pa.nulls(0, id_type)
            return [
                pa.array(chunk.n_words.astype(np.int64)),
                list_array(struct, np.array([len(m) for m in merged])),
                list_array(ids, np.array([len(own) for own in listed])),
            ]

        return match

    return map_texts(docs, text, carry, f"n_words long, hits array<struct<first:long,end:long>>, items array<{kind}>", matcher)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _rounds(items: DataFrame, key: str, text: str) -> Iterator[DataFrame]:
    """The items in parts of about :data:`ROUND` words; an item is in one part."""
    size = items.agg(F.sum(F.floor(F.octet_length(text) / 2) + 1)).first()[0] or 0  # a word takes two bytes at least
    parts = max(1, -(-int(size) // (3 * ROUND)))
    for r in range(parts):
        yield items if parts == 1 else items.where(F.pmod(F.xxhash64(key, text), F.lit(parts)) == r)


def find_windows(docs: DataFrame, items: DataFrame, text: str = "text", carry: Sequence[str] | None = None, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add to each document its ``n_words``, ``hits`` (spans of hit words) and ``items`` (ids found).

    ``carry`` names the columns of the documents to keep (default: all).
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "hits", "items", "n_hit")]
    kind = items.schema[item].dataType.simpleString()
    out, held = docs.withColumnsRenamed({c: f"_{c}" for c in ("n_words", "hits", "items", "n_hit") if c in docs.columns and c not in carry and c != text}), False
    for part in _rounds(items, item, item_text):
        windows = item_windows(part, item, item_text)
        prefixes = _prefixes(windows, _counts(docs, text, windows))
        kept = carry
        if held:  # what earlier rounds found, and the text for this one
            out = out.withColumnsRenamed({"hits": "_hits", "items": "_items"})
            kept = [*carry, "_hits", "_items"]
        out = _match(out, text, [*kept, *([] if text in carry else [text])], windows, prefixes, kind)
        if held:
            out = out.withColumns({"hits": F.concat("_hits", "hits"), "items": F.array_distinct(F.concat("_items", "items"))}).drop("_hits", "_items")
        held = True
    # spans of different rounds may overlap: count each word once
    covered = F.aggregate(
        F.sort_array("hits"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["first"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return out.select(*carry, "n_words", "hits", "items", covered.alias("n_hit"))


def contaminated():
    """At least one word is hit, and one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
