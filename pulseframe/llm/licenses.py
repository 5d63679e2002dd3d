"""License scans by an exact set-similarity join of text blocks with license templates.

A block is what lies between lines without words and sentence ends; the lines of a hard-wrapped
notice are one block. Templates are the telling sentences of licenses, and callers may give others.
A template is in a block where at least 85 % of its distinct words are. Template words are counted over all documents and ordered
from rare to frequent; a block that meets the threshold must hold one of the first
``n - ceil(0.85 n) + 1`` of them (prefix filter) and as many words as the threshold asks (length
filter); while the overlap is counted in that order, a pair is dropped as soon as the words that
are left cannot reach it (positional filter). What remains is compared word by word. The filters
lose nothing, so the result is that of comparing all blocks with all templates.

Named phrases are found beside it, wherever their words stand consecutively.

Nulls, ties, repeats: a null or empty text has no words and no labels; a block that meets several
templates counts for each; equally frequent words go by alphabet; repeated rows are scanned row by
row; an empty table gives an empty result. Very long texts are hashed in segments and scanned whole.
Other columns are not carried unless named; a carried column named like a result column is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashSet, Texts, count_hashes, hash_text, map_texts

# Notices as licenses word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "You may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
PHRASES: Mapping[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = (17, 20)

_FIELDS = (
    "n_words long, phrases array<struct<label:string,word:long>>, "
    "blocks array<struct<label:string,first:long,end:long,containment:double>>"
)


def template_words(text: str) -> list[str]:
    chunk = _chunk(text)
    return sorted(set(chunk.words(0, int(chunk.word_at[-1]))))


def _chunk(text: str) -> Texts:
    data = np.frombuffer(text.encode(), np.uint8)
    return Texts(data, np.array([0, len(data)], np.int64), slice(0, 1))


def needed(n: int) -> int:
    """Words of n that the threshold asks for."""
    return -(-n * THRESHOLD[0] // THRESHOLD[1])


def block_starts(chunk: Texts) -> np.ndarray:
    """For each word the number of its block: blocks end at lines without words, sentence ends and texts."""
    data, begin = chunk.data, chunk.begin
    if not len(begin):
        return np.zeros(0, np.int64)
    space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    stop = (data == 46) | (data == 33) | (data == 63) | (data == 59)
    ends = np.zeros(len(data), bool)
    ends[:-1] = stop[:-1] & space[1:]
    stops, breaks = (np.cumsum(x, dtype=np.int64)[begin] for x in (ends, data == 10))
    new = np.zeros(len(begin), np.int64)
    # one line break between two words wraps a line, two leave a line without words
    new[1:] = (np.diff(stops) > 0) | (np.diff(breaks) > 1)
    return np.cumsum(new) + chunk.doc  # a text begins a new block


def scan(
    docs: DataFrame,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """Per document ``n_words``, ``phrases`` (label, first word) and ``blocks`` (label, words, containment)."""
    context = docs.sparkSession.sparkContext
    sets = [(label, template_words(t)) for label, t in templates]
    vocabulary = {w: hash_text([w]) for _, ws in sets for w in ws}
    hashes = context.broadcast(np.array(sorted(vocabulary.values()), np.uint64))

    def counter():
        known = HashSet(hashes.value)

        def count(chunk: Texts):
            return np.unique(known.keys[known.find(word_runs(chunk))[1]], return_counts=True)

        return count

    # one number per template word
    frequency = {int(np.int64(h).view(np.uint64)): n for h, n in count_hashes(docs, text, counter).toLocalIterator()}
    order = {w: (frequency.get(h, 0), w) for w, h in vocabulary.items()}
    ordered = [(label, sorted(ws, key=order.__getitem__)) for label, ws in sets]
    prefixes = defaultdict(list)
    for i, (_, ws) in enumerate(ordered):
        for w in ws[: len(ws) - needed(len(ws)) + 1]:
            prefixes[vocabulary[w]].append(i)
    named = {p: (tuple(p.split(" ")), label) for p, label in phrases.items()}
    sent = context.broadcast((ordered, dict(prefixes), list(named.values())))

    def scanner():
        ordered, prefixes, named = sent.value
        prefix = HashSet(np.array(sorted(prefixes), np.uint64))
        by_size = defaultdict(dict)
        for ws, label in named:
            by_size[len(ws)][hash_text(list(ws))] = (list(ws), label)
        phrase_sets = [(k, HashSet(np.array(sorted(v), np.uint64)), v) for k, v in by_size.items()]

        def scan_chunk(chunk: Texts):
            phrases_of, blocks_of = defaultdict(list), defaultdict(list)
            base = chunk.word_at
            for k, s, held in phrase_sets:
                h, at = chunk.runs(k)
                places, keys = s.find(h)
                docs_of = np.searchsorted(base, at[places], "right") - 1
                for place, key, d in zip(at[places].tolist(), keys.tolist(), docs_of.tolist(), strict=True):
                    ws, label = held[int(s.keys[key])]
                    if chunk.words(place, place + k) == ws:
                        phrases_of[d].append({"label": label, "word": place - int(base[d])})
            places, keys = prefix.find(word_runs(chunk))
            if len(places):
                number = block_starts(chunk)
                pairs = {(int(number[p]), t) for p, key in zip(places.tolist(), keys.tolist(), strict=True) for t in prefixes[int(prefix.keys[key])]}
                words_of: dict[int, tuple[int, int, set]] = {}
                for block, t in sorted(pairs):
                    if block not in words_of:
                        lo, hi = np.searchsorted(number, [block, block + 1]).tolist()
                        words_of[block] = (lo, hi, set())
                    lo, hi, held = words_of[block]
                    label, ws = ordered[t]
                    need = needed(len(ws))
                    if hi - lo < need:
                        continue
                    if not held:
                        held.update(chunk.words(lo, hi))
                    overlap = 0
                    for left, w in zip(range(len(ws) - 1, -1, -1), ws, strict=True):
                        overlap += w in held
                        if overlap + left < need:
                            break
                    if overlap >= need:
                        d = int(np.searchsorted(base, lo, "right")) - 1
                        blocks_of[d].append({"label": label, "first": lo - int(base[d]), "end": hi - int(base[d]), "containment": overlap / len(ws)})
            return [
                pa.array(chunk.n_words.astype(np.int64)),
                pa.array([sorted(phrases_of.get(d, []), key=lambda x: (x["word"], x["label"])) for d in range(chunk.n)], _PHRASES),
                pa.array([blocks_of.get(d, []) for d in range(chunk.n)], _BLOCKS),
            ]

        return scan_chunk

    return map_texts(docs, text, carry, _FIELDS, scanner)


_PHRASES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def word_runs(chunk: Texts) -> np.ndarray:
    """Hashes of single words, comparable with those of :func:`hash_text`."""
    return chunk.runs(1)[0]


def label_list(*arrays):
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.sort_array(F.array_distinct(F.concat(*arrays))), ",")
