"""Toxicity scores of texts restored through a noisy channel.

Disguised words are found first: tokens with digits or signs in the place of letters, at any place
and next to each other too, letters or signs written apart (by blanks, line breaks, marks), letters
repeated three times or more, and listed words cut in two. Each but the last is a lattice: a sign may stand for several letters, an
accented letter for its base, a separator for none, a repeated letter for itself or none. A Viterbi search finds
the likeliest letters under a character trigram model, which is counted over all documents and
interpolated with the learned word list. Restored words stand in the text beside the plain ones:
what a restored word holds and its disguise did not adds to the counts that features ask for.

The word list is learned from labelled rows, of which one per group of near copies counts. Features
are whole words and word beginnings of 4 to 9 bytes, held once, twice or three times; those that
toxic rows favour by a significant log-likelihood ratio stay, less beginnings
and those that clean rows hold too where they add little to better ones. The restored text is scored as a whole: the log-likelihood ratios of all
features that it holds add up to the log-odds of the label, one feature for each listed word. A feature
of few rows weighs little, as some more clean rows are taken to hold it than were seen to, so
such features need others beside them. Neither tokens nor texts are judged by their lengths.

:data:`SETTING` was chosen by :func:`fold_report`, which learns from two thirds of
the rows that may train and scores the others; rows that are held out had no part in it.

The list is fitted on at most about :data:`TRAIN_ROWS` labelled rows per label (a documented bound,
which holds when ids repeat: an id trains once);
the character model and the scores cover all rows and whole texts.

Nulls, ties, repeats: a null or empty text holds no feature and gets the rate of toxic rows without
any; conflicting labels of one id train with the larger; repeated
rows are scored each for itself; without labelled toxic rows every score is 0 or the rate;
an empty table gives an empty result. Columns named like a result column are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, HashSet, Texts, _byte_value, count_hashes, crc_fold, discard, hash_runs, hash_text, map_texts, mix, stored, training_rows

TRAIN_ROWS = 4000
LEAST = 5
TIMES = 3
PREFIXES = tuple(range(4, 10))
_BASE = 0x9E3779B97F4A7C15 | 1


class Setting(NamedTuple):
    """What a feature must show: a log-likelihood ratio, and a precision if ``pseudo`` more clean rows than were seen held it."""

    ratio: float
    least: float
    pseudo: float


#: Chosen by :func:`fold_report`. Of the rows that may train, on the 0.1 sample tables (305 toxic, 2,331 clean) it
#: found 284 and flagged 9; ratios of 27 and 20 with two pseudo rows 285 and 14, 287 and 20; 34 with four 276 and 7.
#: On the 0.1 GB check table (1,444 and 12,206) it found all and flagged none, as did 20 with two.
SETTING = Setting(34.0, 0.5, 1.0)

# What signs may stand for, and what may stand between letters.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
SEPARATORS = " .-_*/,\n\r\t:;()[]{}<>\"'=~^&#%?`\\"
#: Costs (negative logarithms): a sign read as a letter, and a repeated letter left out or kept.
SIGN_COST, DROP_COST, KEEP_COST = 0.5, 0.3, 1.0
#: What is decoded at once: the beginning of a token, which no listed word outgrows once repeats are folded,
#: and parts of a run of letters apart, each of which overlaps half of the next, so that any word lies in one.
PART = 128

# letters of the character model: 0 for what is no letter, a-z, and one for all others
_model_letter = np.zeros(256, np.int64)
_model_letter[ord("a") : ord("z") + 1] = _model_letter[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_model_letter[128:] = 27
_LETTERS = 28
# capitals of Latin letters beyond ASCII count as small ones
_folded_value = _byte_value.copy()
_folded_value[0x80:0x9F] = _byte_value[0xA0:0xBF]


# --- features ------------------------------------------------------------------------------------


def features(chunk: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hashes, words) of word beginnings by length in bytes, then of whole words (length 0)."""
    n = len(chunk.begin)
    if not n:
        return
    size = chunk.end - chunk.begin
    total = np.zeros(n, np.uint64)
    power = 1
    for j in range(max(PREFIXES)):
        live = np.minimum(chunk.begin + j, len(chunk.data) - 1)
        total += _folded_value[chunk.data[live]] * np.uint64(power)
        power = power * _BASE % (1 << 64)
        if j + 1 in PREFIXES:
            words = np.flatnonzero(size > j + 1)
            yield j + 1, mix(total[words] + np.uint64((j + 1) * 0xA24BAED4963EE407 % (1 << 64))), words
    yield 0, chunk.hashes, np.arange(n)


def _feature_text(chunk: Texts, word: int, length: int) -> str:
    raw = bytes(chunk.data[chunk.begin[word] : chunk.end[word]])
    return (raw[:length] if length else raw).decode("utf-8", "ignore").lower()


def _variant(hashes: np.ndarray, times: int) -> np.ndarray:
    """The feature 'at least so many times in the text'."""
    return hashes if times == 1 else mix(hashes + np.uint64(times * 0x9FB21C651E98DF25 % (1 << 64)))


def counted(chunk: Texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, times, base hashes, texts, words): each feature once per text that has it so often."""
    for length, h, words in features(chunk):
        owner = chunk.doc[words]
        order = np.lexsort((h, owner))
        h, owner, words = h[order], owner[order], words[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(h)))
        for times in range(1, TIMES + 1):
            yield length, times, h[at[n >= times]], owner[at[n >= times]], words[at[n >= times]]


@dataclass
class WordList:
    """Learned features: hash -> [(times, log-likelihood ratio, length in bytes or 0, text)], the rate without any, and the log-odds of the label."""

    entries: dict[int, list[tuple[int, float, int, str]]] = field(default_factory=dict)
    rest: float = 0.0
    prior: float = 0.0

    def texts(self) -> list[tuple[str, bool, int]]:
        """(text, whole word?, base hash) of what occurrences of features look like."""
        return sorted({(t, not length, base) for base, es in self.entries.items() for _, _, length, t in es if t})


    def score(self, held: dict[int, int]) -> tuple[float, list[str]]:
        """The chance of the label given how often a text holds each feature, and the features that tell it.

        Of features that begin alike only the most telling one counts: they tell of one word.
        """
        told = sorted(((w, t) for base, n in held.items() for times, w, _, t in self.entries[base] if n >= times), key=lambda x: (-x[0], x[1]))
        kept: list[str] = []
        logit = self.prior
        for w, t in told:
            if not any(t.startswith(k) or k.startswith(t) for k in kept):
                kept.append(t)
                logit += w
        return (self.rest, []) if not kept else (float(max(self.rest, 1 / (1 + np.exp(-logit)))), sorted(kept))


def _one_per_group(own: DataFrame, key: str, text: str) -> DataFrame:
    """One labelled row of each group of near copies, by the least hash of the five-word runs."""

    def make():
        def sign(chunk: Texts):
            out = np.zeros(chunk.n, np.uint64)
            for k in (1, 5):  # texts under five words go by their words
                h, at = chunk.runs(k)
                d = chunk.doc[at] if len(at) else at
                some, first = np.unique(d, return_index=True)
                if len(some):
                    out[some] = np.minimum.reduceat(h, first)
            return [pa.array(out.view(np.int64))]

        return sign

    signed = map_texts(own.withColumn("_own", F.col(text)), text, [key, "_label", "_own"], "sign long", make)
    return stored(signed.groupBy("sign", "_label").agg(F.min_by("_own", key).alias(text), F.min(key).alias(key)).drop("sign"), "labelled")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, setting: Setting | None = None) -> WordList:
    """Learn the word list from labelled rows."""
    ratio, least, pseudo = setting or SETTING
    one = labels.where(F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_label"))
    totals = {r["_label"]: r["count"] for r in one.groupBy("_label").count().collect()}  # two rows
    own = _one_per_group(training_rows(docs, one, key, "_label", text, rows), key, text)

    def counter():
        def count(chunk: Texts):
            found = [_variant(h, times) for _, times, h, _, _ in counted(chunk)]
            return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)

        return count

    size = {r["_label"]: r["count"] for r in own.groupBy("_label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return WordList()
    t = count_hashes(own.where("_label = 1"), text, counter).withColumnRenamed("n", "t").where(f"t >= {LEAST}")
    c = count_hashes(own.where("_label = 0"), text, counter).withColumnRenamed("n", "c")
    favoured = t.join(c, "hash", "left").fillna(0, ["c"]).where(F.col("t") / F.lit(toxic) > 4 * F.col("c") / F.lit(max(clean, 1)))
    table = favoured.toArrow()  # bounded, as the sample is
    base = toxic / (toxic + clean)
    chosen_features = {
        h: (a, b)
        for h, a, b in zip(table.column("hash").to_numpy().view(np.uint64).tolist(), table.column("t").to_pylist(), table.column("c").to_pylist(), strict=True)
        if _likelihood_ratio(a, b, base) >= ratio and _odds(a, toxic, b, clean, totals, pseudo) >= least
    }
    sent = docs.sparkSession.sparkContext.broadcast(np.array(sorted(chosen_features), np.uint64))

    def finder():
        known = HashSet(sent.value)

        def find(chunk: Texts):
            out: list[list[tuple]] = [[] for _ in range(chunk.n)]
            for length, times, h, owner, words in counted(chunk):
                places, keys = known.find(_variant(h, times))
                for i, k in zip(places.tolist(), keys.tolist(), strict=True):
                    feature, plain = int(known.keys[k].view(np.int64)), int(h[i].view(np.int64))
                    out[owner[i]].append((feature, plain, times, length, _feature_text(chunk, int(words[i]), length)))
            names = ("feature", "base", "times", "length", "name")
            return [pa.array([[dict(zip(names, x, strict=True)) for x in o] for o in out], _FOUND)]

        return find

    held = map_texts(own.where("_label = 1"), text, [key], "f array<struct<feature:long,base:long,times:int,length:int,name:string>>", finder)
    named: dict[int, tuple[int, int, int, str]] = {}
    rows_of: dict[int, set[int]] = defaultdict(set)
    for i, r in enumerate(held.select("f").toLocalIterator()):
        for x in r["f"]:
            feature = x["feature"] % (1 << 64)
            named[feature] = (x["base"] % (1 << 64), x["times"], x["length"], x["name"])
            rows_of[feature].add(i)
    out, covered = WordList(), set()
    precision = {h: _odds(chosen_features[h][0], toxic, chosen_features[h][1], clean, totals, pseudo) for h in named}
    out.prior = float(np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)))
    # whole words before beginnings, long beginnings before short ones, where they are equally telling
    for h in sorted(named, key=lambda h: (chosen_features[h][1] > 0, -precision[h], named[h][2] > 0, -named[h][2], named[h])):
        # a beginning, and whatever clean rows hold too, must earn its place among the rows that better ones leave
        if (named[h][2] or chosen_features[h][1]) and len(rows_of[h] - covered) < max(3, 4 * chosen_features[h][1]):
            continue
        plain, times, length, name = named[h]
        out.entries.setdefault(plain, []).append((times, float(np.log(precision[h] / (1 - precision[h]))) - out.prior, length, name))
        covered |= rows_of[h]
    out.rest = min(_odds(toxic - len(covered), toxic, clean, clean, totals), 0.5)
    discard(own)
    return out


_FOUND = pa.list_(pa.struct([("feature", pa.int64()), ("base", pa.int64()), ("times", pa.int32()), ("length", pa.int32()), ("name", pa.string())]))


def _odds(t: float, toxic: int, c: float, clean: int, totals: dict[int, int], pseudo: float = 0.5) -> float:
    """Chance of the label given a feature in t of the toxic and c of the clean sampled rows, and in ``pseudo`` clean ones besides."""
    prior = (totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)
    odds = ((t + 0.5) / (toxic + 1)) / ((c + pseudo) / (clean + 2 * pseudo)) * prior
    return odds / (1 + odds)


def _likelihood_ratio(a: int, b: int, base: float) -> float:
    n = a + b
    if not a or a / n <= base:
        return 0.0
    out = a * np.log(a / n / base)
    if b:
        out += b * np.log(b / n / (1 - base))
    return 2 * out


# --- the character model and the lattice ---------------------------------------------------------


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of letter trigrams over all texts; ``hash`` is the trigram's number."""

    def counter():
        def count(chunk: Texts):
            letters = np.zeros(len(chunk.data) + 2 * chunk.n + 1, np.int64)
            # two boundaries between texts
            shift = np.repeat(np.arange(chunk.n) * 2, np.diff(chunk.offsets)) + 2
            letters[np.arange(len(chunk.data)) + shift] = _model_letter[chunk.data]
            code = (letters[:-2] * _LETTERS + letters[1:-1]) * _LETTERS + letters[2:]
            n = np.bincount(code, minlength=_LETTERS**3)
            some = np.flatnonzero(n)
            return some.astype(np.uint64), n[some]

        return count

    return count_hashes(docs, text, counter)


class CharacterModel:
    """Costs of letters after two others, interpolated with a word list."""

    def __init__(self, counts: np.ndarray, words: Sequence[str] = ()):
        own = counts.reshape(_LETTERS, _LETTERS, _LETTERS).astype(np.float64)
        own[0, 0, 0] = 0
        listed = np.zeros_like(own)
        for w in words:
            c = [0, 0, *(int(_model_letter[b]) for b in w.encode()), 0]
            for x, y, z in zip(c, c[1:], c[2:], strict=False):
                listed[x, y, z] += 1
        two = own.sum(axis=0)
        backoff = (two + 0.5) / (two + 0.5).sum(axis=1, keepdims=True)
        plain = (own + 5 * backoff[None]) / (own.sum(axis=2, keepdims=True) + 5)
        in_list = (listed + 0.5 * plain) / (listed.sum(axis=2, keepdims=True) + 0.5)
        self.cost = (-np.log(0.5 * plain + 0.5 * in_list)).tolist()

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token."""
        return self.aligned(token)[0]

    def aligned(self, token: str) -> tuple[str, str]:
        """The likeliest letters behind a token, and for each ``+`` if it was drawn out, else a blank."""
        marks = [" "] * len(token)
        for run in _DRAWN_OUT.finditer("".join(c.lower()[0] for c in token)):
            marks[run.start() : run.end()] = "+" * len(run[0])
        paths: dict[tuple[int, int], tuple[float, str, str]] = {(0, 0): (0.0, "", "")}
        for step, mark in zip(arcs(token), marks, strict=True):
            new: dict[tuple[int, int], tuple[float, str, str]] = {}
            for (a, b), (cost, out, drawn) in paths.items():
                for letter, more in step:
                    if letter:
                        z = letter_number(letter)
                        state, total, text, at = (b, z), cost + more + self.cost[a][b][z], out + letter, drawn + mark * len(letter)
                    else:
                        state, total, text, at = (a, b), cost + more, out, drawn
                    if state not in new or total < new[state][0]:
                        new[state] = (total, text, at)
            paths = new
        return min((cost + self.cost[a][b][0], text, drawn) for (a, b), (cost, text, drawn) in paths.items())[1:]


@lru_cache(4096)
def letter_number(letter: str) -> int:
    return int(_model_letter[letter.encode()[0]])


def arcs(token: str) -> list[list[tuple[str, float]]]:
    """The token's lattice: for each character what it may stand for (a letter, or nothing) and at what cost."""
    out, before = [], ""
    for raw in token:
        c = raw.lower()
        own: list[tuple[str, float]] = []
        again = KEEP_COST if c == before else 0.0
        if c.isalpha():
            own.append((c, again))
            base = unicodedata.normalize("NFD", c)[0]
            if c > "\x7f" and "a" <= base <= "z":
                own.append((base, SIGN_COST + again))
        elif c in SEPARATORS:
            own.append(("", 0.0))
        own += [(letter, SIGN_COST + again) for letter in SIGNS.get(c, "")]
        if c.isalpha() or c in SIGNS:
            if again:
                own.append(("", DROP_COST))
            before = c
        out.append(own or [("", 0.0)])
    return out


_INNER = "._-"
_EDGE_SIGNS = re.compile(r"^[@$!|+*._-]+|[@$!|+*._-]+$")
_SOME_SIGN = re.compile(f"[{re.escape(''.join(SIGNS))}]")
_LONG_REPEAT = re.compile(r"(.)\1{3,}", re.S)


def _table(test: Callable[[str], bool]) -> np.ndarray:
    """By code point up to 0xFFFF; the last place stands for all beyond."""
    return np.array([test(chr(i)) for i in range(1 << 16)] + [True])


_letter_point = _table(lambda c: ("a" <= c <= "z" or "A" <= c <= "Z") if c < "\x80" else unicodedata.category(c)[0] in "LM")
_sign_point, _separator_point, _inner_point = (np.isin(np.arange((1 << 16) + 1), [ord(c) for c in of]) for of in (SIGNS, SEPARATORS, _INNER))


def _token_forms(run: str) -> Iterator[str]:
    """What a run of letters, signs and inner separators may be as a word: whole or in part, with and without the signs at its edges.

    Long repeats count as three. What is still longer than any word goes out by its beginning, which is
    all that a listed beginning asks for.
    """
    run = _LONG_REPEAT.sub(r"\1\1\1", run).strip(_INNER)
    parts = [p for p in re.split(r"[._-]+", run) if p]
    seen = set()
    for part in [run, *parts] if len(parts) > 1 else [run]:
        for form in (part, _EDGE_SIGNS.sub("", part)):
            if form in seen or len(form) < 3 or not any(c.isalpha() for c in form):
                continue
            seen.add(form)
            if _SOME_SIGN.search(form) or _DRAWN_OUT.search(form.lower()):
                yield form[:PART]


def disguised(chunk: Texts) -> Iterator[tuple[int, bool, str]]:
    """(text, whether written apart, token) of what may be words in disguise."""
    points, bounds = chunk.code_points
    n = len(points)
    if n < 3:
        return
    text = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
    at = np.minimum(points, 1 << 16)
    letter, sign, separator = _letter_point[at], _sign_point[at], _separator_point[at]
    first = np.zeros(n + 1, bool)  # where texts begin
    first[bounds] = True
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    drawn = np.zeros(n, bool)
    drawn[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    letters, signs, drawns, separators = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, sign, drawn, separator))

    body = letter | sign | _inner_point[at]
    opens, closes = body.copy(), body.copy()
    opens[1:] &= ~body[:-1] | first[1:n]
    closes[:-1] &= ~body[1:] | first[1:n]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    some = (hi - lo >= 3) & (letters[hi] > letters[lo]) & ((signs[hi] > signs[lo]) | (drawns[hi] > drawns[lo]))
    lo, hi = lo[some], hi[some]
    for d, i, j in zip((np.searchsorted(bounds, lo, "right") - 1).tolist(), lo.tolist(), hi.tolist(), strict=True):
        for token in _token_forms(text[i:j]):
            yield d, False, token

    # written apart: at least three single letters or signs with nothing but separators between
    single = (letter | sign) & ~separator
    alone = single.copy()
    alone[1:] &= ~single[:-1] | first[1:n]
    alone[:-1] &= ~single[1:] | first[1:n]
    at = np.flatnonzero(alone)
    if len(at) < 3:
        return
    doc = np.searchsorted(bounds, at, "right") - 1
    gap = np.diff(at) - 1
    linked = (gap > 0) & (separators[at[1:]] - separators[at[:-1] + 1] == gap) & (doc[1:] == doc[:-1])
    cuts = np.concatenate([[0], np.flatnonzero(~linked) + 1, [len(at)]])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j - i < 3 or letters[at[j - 1] + 1] == letters[at[i]]:
            continue
        token = _apart(text, at[i:j].tolist())
        for k in range(0, max(1, len(token) - PART // 2), PART // 2):
            yield int(doc[i]), True, token[k : k + PART]


def _apart(text: str, places: list[int]) -> str:
    """Letters written apart, each with one separator before it; of a letter that goes on and on three stay."""
    out, again = [text[places[0]]], 1
    for a, b in zip(places, places[1:], strict=False):
        again = again + 1 if text[b].lower() == text[a].lower() else 1
        if again <= 3:
            between = text[a + 1 : b]
            out.append(("*" if "*" in between else (between.strip() or " ")[0]) + text[b])
    return "".join(out)


_DRAWN_OUT = re.compile(r"(.)\1{2,}", re.S)


def _once(text: str) -> str:
    """Without repetitions of letters."""
    return re.sub(r"(.)\1+", r"\1", text)


def _places(word: str, drawn: str) -> list[tuple[str, bool]]:
    """The letters of a word and whether each may stand for several: repetitions are one place where they were drawn out."""
    out: list[tuple[str, bool]] = []
    for c, mark in zip(word, drawn, strict=True):
        if out and out[-1][0] == c and (mark == "+" or out[-1][1]):
            out[-1] = (c, True)
        else:
            out.append((c, mark == "+"))
    return out


def _stands(places: list[tuple[str, bool]], text: str, whole: bool) -> bool:
    """Whether the places begin with a text, or are it."""
    i = 0
    for c, several in places:
        if i == len(text):
            return not whole
        if text[i] != c:
            return False
        i += 1
        while several and i < len(text) and text[i] == c:
            i += 1
    return i == len(text)


class CutWords:
    """Finds listed whole words that are written in two pieces with one separator between."""

    def __init__(self, words: Sequence[str]):
        self.words = {w for w in words if len(w) >= 4}
        pieces = [(w[:i], w[i:]) for w in self.words for i in range(1, len(w))]
        self.heads, self.tails = (HashSet(np.array([hash_text([p[side]]) for p in pieces], np.uint64)) for side in (0, 1))

    def find(self, chunk: Texts) -> Iterator[tuple[int, str, str]]:
        """(text, what stands there, listed word)."""
        if not self.words or len(chunk.begin) < 2:
            return
        head, tail = np.zeros(len(chunk.begin), bool), np.zeros(len(chunk.begin), bool)
        head[self.heads.find(hash_runs(chunk.hashes, 1))[0]] = True
        tail[self.tails.find(hash_runs(chunk.hashes, 1))[0]] = True
        near = np.flatnonzero(head[:-1] & tail[1:] & (chunk.begin[1:] - chunk.end[:-1] == 1) & (chunk.doc[1:] == chunk.doc[:-1]))
        for i in near.tolist():
            word = "".join(chunk.words(i, i + 2))
            between = chr(chunk.data[chunk.end[i]])
            if word in self.words and between in SEPARATORS and between != "\n":
                yield int(chunk.doc[i]), between.join(chunk.words(i, i + 2)), word


@dataclass
class Model:
    words: WordList
    counts: np.ndarray


def _model_counts(docs: DataFrame, text: str) -> np.ndarray:
    counts = np.zeros(_LETTERS**3, np.int64)
    for code, n in letter_counts(docs, text).toLocalIterator():  # at most 28**3 rows
        counts[code] = n
    return counts


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The word list from labelled rows, the character model from all documents."""
    return Model(learn(docs, labels, key, text, label), _model_counts(docs, text))


def fold_report(docs: DataFrame, labels: DataFrame, settings: Sequence[Setting], folds: int = 3, limit: float = 0.7) -> list[tuple[Setting, int, int, int, int]]:
    """What each setting (least precision, pseudo rows) does on rows that it did not learn from.

    ``labels`` are those that may train, and are cut into folds by a hash of the id. Returns
    (setting, toxic rows, found, clean rows, flagged), summed over the folds.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).withColumn("_fold", crc_fold(F.concat(F.lit("fold"), F.col("doc_id").cast("string")), folds))
    counts, out = _model_counts(docs, "text"), []
    for setting in settings:
        sums = np.zeros(4, np.int64)
        for f in range(folds):
            model = Model(learn(docs, one.where(F.col("_fold") != f), setting=setting), counts)
            own = docs.join(one.where(F.col("_fold") == f).groupBy("doc_id").agg(F.max("toxic").alias("_toxic")), "doc_id")
            flag = F.col("score") >= limit
            r = score(own, model, carry=["_toxic"]).agg(F.count_if(F.col("_toxic") > 0), F.count_if((F.col("_toxic") > 0) & flag), F.count_if(F.col("_toxic") == 0), F.count_if((F.col("_toxic") == 0) & flag)).first()
            sums += np.array(r, np.int64)
        out.append((setting, *sums.tolist()))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Add ``score``, ``found`` (the listed words and beginnings the text holds) and ``restored`` (token, word)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        words = sent.value.words
        known = HashSet(np.array(sorted(words.entries), np.uint64))
        listed = words.texts()
        decoder = CharacterModel(sent.value.counts, sorted({t for t, _, _ in listed}))
        numbered = [(t, whole, int(np.searchsorted(known.keys, np.uint64(base)))) for t, whole, base in listed]
        # no word that holds none of these, repetitions aside, holds a feature
        some_feature = re.compile("|".join(sorted({re.escape(_once(t)) for t, _, _ in numbered})) or "(?!)")
        cut_words = CutWords(sorted({t for t, whole, _ in listed if whole}))
        place_of = {t: k for t, whole, k in numbered if whole}
        memory: dict[tuple[bool, str], tuple[str, list[int]]] = {}

        def restore(apart: bool, token: str) -> tuple[str, list[int]]:
            """The word behind a token, and which features it holds that the token did not."""
            got = memory.get((apart, token))
            if got is None:
                if len(memory) > 20_000:
                    memory.clear()
                (word, drawn), plain = decoder.aligned(token), token.lower()
                before = re.findall(WORD_PATTERN, plain)
                places = _places(word, drawn)
                hits = set()
                for t, whole, k in numbered if (word != plain or "+" in drawn) and some_feature.search(_once(word)) else ():
                    if any(w == t if whole else w.startswith(t) for w in before):
                        continue
                    if any(_stands(places[i:], t, whole and not apart) for i in range(len(places) if apart else 1)):
                        hits.add(k)
                got = memory[apart, token] = (word, sorted(hits))
            return got

        def score_chunk(chunk: Texts):
            held: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # text -> feature -> how often
            restored: list[list[dict]] = [[] for _ in range(chunk.n)]
            for _, h, of in features(chunk):
                places, keys = known.find(h)
                if len(places):
                    pairs, n = np.unique(np.stack([chunk.doc[of[places]], keys]), axis=1, return_counts=True)
                    for d, k, times in zip(*pairs.tolist(), n.tolist(), strict=True):
                        held[d][k] += times
            for d, apart, token in disguised(chunk) if listed else ():
                word, hits = restore(apart, token)
                if hits:
                    restored[d].append({"token": token, "word": word})
                for k in hits:
                    held[d][k] += 1
            for d, token, word in cut_words.find(chunk):
                restored[d].append({"token": token, "word": word})
                held[d][place_of[word]] += 1
            best = np.full(chunk.n, words.rest)
            found: list[list[str]] = [[] for _ in range(chunk.n)]
            for d, features_of in held.items():
                best[d], found[d] = words.score({int(known.keys[k]): times for k, times in features_of.items()})
            return [
                pa.array(best),
                pa.array(found, pa.list_(pa.string())),
                pa.array(restored, pa.list_(pa.struct([("token", pa.string()), ("word", pa.string())]))),
            ]

        return score_chunk

    fields = "score double, found array<string>, restored array<struct<token:string,word:string>>"
    return map_texts(docs, text, list(docs.columns if carry is None else carry), fields, make)
