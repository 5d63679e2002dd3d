"""Audit of how the sources of a language differ in their terms, with equal count columns evaluated once.

Terms are runs of ASCII letters (A-Z lower-cased) and non-ASCII characters. A language keeps its terms
found in at least ``least_docs`` of its documents. A source gives a kept term with c occurrences there
the share p = 1 + floor(10**9 (c + 5) / (N + 5 V)), N being its occurrences of kept terms and V the
number of kept terms; the language as a whole does so too. All of it is integer arithmetic.

Most terms are rare, so many have the same sparse vector of counts by source. Terms are grouped by that
vector; each pair of sources is evaluated once per distinct vector, times the number of its terms. The
vectors are spread over all tasks: a task adds up a matrix of source pairs, and only sums by pair are
shuffled. For the ranks of terms, vectors are ranked first by the share they exceed the language's by;
those that 50 better ones precede are left out, the rest get their terms back, which are ranked by
value and name.

Counting adds up occurrences in each task and gives sums out whenever :data:`FLUSH` terms are held, so
hot terms and sources combine before the shuffle; texts are cut into parts between terms. A row of a
vector has as many entries as the language has sources, and the pair part has their square by contract.

Nulls, ties, repeats: a null text, language or source counts as ''; rows that repeat count each; terms
of equal value rank by their bytes, sources too. A group without terms has pairs (value 0 if the
language keeps no term) but no terms. Very long texts are counted whole, and a term may be of any
length; an empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, release, shuffle_partitions, stored

TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP = 30, 50
#: Terms that a task holds before it gives its sums out, and bytes of a text that are counted at once.
FLUSH, PART = 200_000, 1 << 20
#: Source pairs that a task holds before it gives its sums out.
MOST_PAIRS = 1 << 22

_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def count_terms(text: bytes) -> Counter[bytes]:
    """Occurrences of each term of a UTF-8 text, part by part."""
    spaced = text.translate(_TERM_BYTES)
    if len(spaced) <= PART:
        return Counter(spaced.split())
    found: Counter[bytes] = Counter()
    i = 0
    while i < len(spaced):
        j = spaced.find(b" ", i + PART)
        j = len(spaced) if j < 0 else j
        found.update(spaced[i:j].split())
        i = j
    return found


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n occurrences, docs documents); a row with a null term counts each group's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}
        held = 0

        def sums() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for (l, s), n in documents.items():
                terms = list(n)
                own = occurrences[l, s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([l] * len(terms)), pa.array([s] * len(terms)), pa.array([None if t is None else t.decode("utf-8", "replace") for t in terms], pa.string()),
                     pa.array([own[t] for t in terms], pa.int64()), pa.array([n[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            occurrences.clear()
            documents.clear()
            held = 0

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for i, (l, s) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                found = count_terms(texts[i].as_py())
                own, docs_of = occurrences.setdefault((l, s), Counter()), documents.setdefault((l, s), Counter())
                before = len(docs_of)
                own.update(found)
                docs_of.update(found.keys())
                docs_of[None] += 1
                held += len(docs_of) - before
                if held >= FLUSH:
                    yield from sums()
        yield from sums()
        release()

    filled = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    per_task = filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return per_task.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (total + 5 kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(10**9).cast("decimal(10,0)") * wide(count + 5), wide(total + 5 * kept)
    return F.call_function("div", above, below) + 1


def _kept_vectors(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, vector): kept terms with their counts by source, ordered by source."""
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term")
    pairs = F.sort_array(F.collect_list(F.struct("source", "n")))
    return by_term.agg(F.sum("docs").alias("_docs"), pairs.alias("vector")).where(F.col("_docs") >= least_docs).drop("_docs")


def _languages(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, sources, totals, kept): the sources in order, their occurrences of kept terms, the number of kept terms."""
    totals = vectors.select("lang", F.explode("vector").alias("e"), "terms").groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("terms")).alias("total"))
    sizes = vectors.groupBy("lang").agg(F.sum("terms").alias("kept"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    rows = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("g"))
    return rows.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


def _with_shares(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """Add ``shares`` (each source's p, in order) and ``whole`` (the language's p)."""
    joined = vectors.join(languages, "lang").withColumn("_of", F.map_from_entries("vector"))
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at("_of", s), F.lit(0).cast("long")))
    shares = F.transform(F.arrays_zip(counts.alias("c"), F.col("totals").alias("t")), lambda z: share(z["c"], z["t"], F.col("kept")))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return joined.select("lang", "vector", "terms", "sources", shares.alias("shares"), share(add(F.transform("vector", lambda e: e["n"])), add(F.col("totals")), F.col("kept")).alias("whole"))


def pair_sums(vectors: DataFrame) -> DataFrame:
    """(lang, first, second, value): places of two sources, first below second, and their distance summed over all kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, m in sums.items():
                a, b = np.triu_indices(len(m), 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m[a, b])], names=["lang", "first", "second", "value"])
            sums.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            terms = batch.column("terms").to_numpy()
            shares = batch.column("shares")
            for lang in dict.fromkeys(langs):
                at = np.flatnonzero(langs == lang)
                p = shares.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                if lang not in sums:
                    if held and held + p.shape[1] ** 2 > MOST_PAIRS:
                        yield from out()
                        held = 0
                    sums[lang] = np.zeros((p.shape[1], p.shape[1]), np.int64)
                    held += p.shape[1] ** 2
                m = sums[lang]
                for i in range(p.shape[1] - 1):
                    m[i, i + 1 :] += (np.abs(p[:, i + 1 :] - p[:, i : i + 1]) * terms[at, None]).sum(axis=0)
        yield from out()
        release()

    per_task = vectors.select("lang", "terms", "shares").mapInArrow(run, "lang string, first int, second int, value long")
    return per_task.groupBy("lang", "first", "second").agg(F.sum("value").alias("value"))


def _pairs(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("second").alias("b")), F.struct(F.col("second").alias("a"), F.col("first").alias("b"))))
    found = pair_sums(vectors).select("lang", "value", both.alias("e")).select("lang", "e.a", "e.b", "value")
    places = languages.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    every = places.select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).where("a <> b")
    return every.join(found, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def _ranked(df: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))


def _terms(terms: DataFrame, vectors: DataFrame, top: int) -> DataFrame:
    """The terms of each group that exceed the language most, ``top`` of them."""
    places = F.transform("vector", lambda e: F.struct(e["source"].alias("source"), (F.element_at("shares", F.array_position("sources", e["source"]).cast("int")) - F.col("whole")).alias("value")))
    above = vectors.select("lang", "vector", F.explode(places).alias("e")).where("e.value > 0").select("lang", "vector", "e.source", "e.value")
    # a vector that `top` vectors precede has that many better terms before its own
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    best = above.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
    named = terms.join(best, ["lang", "vector"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return named.withColumn("rank", _ranked(named)).where(F.col("rank") <= top)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to other sources, and the terms that stand out."""
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    terms = stored(_kept_vectors(counts, least_docs), "term-vectors")
    distinct = stored(terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("terms")), "count-vectors")
    languages = stored(_languages(counts, distinct), "languages")
    spread = distinct.repartition(shuffle_partitions(docs.sparkSession))
    shared = stored(_with_shares(spread, languages), "vector-shares")
    pairs = _pairs(shared, languages)
    return pairs.withColumn("rank", _ranked(pairs)).unionByName(_terms(terms, shared, top))


#: DuckDB SQL of :func:`audit` over the table ``documents``, with its default parameters.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '@U', '@L'), '@T') AS ws
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= @D),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total, coalesce(any_value(v.v), 0)::HUGEINT AS v FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
a AS (SELECT lang, sum(total)::HUGEINT AS total FROM t GROUP BY lang),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * t.v) AS p
  FROM t JOIN kept k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(a.total) + 5 * any_value(v.v)) AS q
  FROM c JOIN a USING (lang) JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (
    SELECT b.lang, b.source, e.source AS item, sum(abs(b.p - e.p)) AS value FROM p b JOIN p e ON b.lang = e.lang AND b.term = e.term AND b.source <> e.source GROUP BY ALL
  ) s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
), named AS (
  SELECT lang, source, 'term' AS part, term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM named)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= @K
""".replace("@U", UPPER).replace("@L", LOWER).replace("@T", TERM_PATTERN).replace("@D", str(LEAST_DOCS)).replace("@K", str(TOP))
