"""Radix partitioning, residue-number scatter and deduplicated count columns against brute force and SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import prod

import numpy as np
import pytest

from pulseframe.llm import divergence, exact, queries, sql, whitening
from tests.conftest import DATA, duck, rows_of

FOLDER = str(DATA / "sf0.01")


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, FOLDER).toPandas()) == rows_of(duck(sql.oracle_sql()[name], FOLDER))


# --- radix partitioning ----------------------------------------------------------------------------


def copies_by_hand(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[text or ""].append(ident)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = []
    for t, ids in groups.items():
        stays = True
        for i in ids:
            out.append((i, best[t], len(ids), i == best[t] and stays))
            stays = stays and i != best[t]
    return Counter(out)


def test_copies_match_brute_force_at_every_width(spark, monkeypatch):
    monkeypatch.setattr(exact, "WIDTHS", (2, 3, 5))
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 14))) for _ in range(400)] + [None, "", "é" * 9, "é" * 9, "\U0001f600", "\U0001f600x"] * 3
    rows = [(None if rng.random() < 0.1 else rng.randint(0, 200), t) for t in texts]
    rows += rows[:30]
    got = exact.mark_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == copies_by_hand(rows)


def test_bytes_decide_and_not_the_filter(spark, monkeypatch):
    monkeypatch.setattr(exact, "FILTER_BITS", 8)  # every digit is marked
    rows = [(i, f"text {i % 50}") for i in range(120)] + [(500, "text 1 "), (501, "Text 1")]
    got = exact.mark_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == copies_by_hand(rows)


def test_one_large_group_and_texts_that_part_late(spark):
    long = "x" * 300_000
    rows = [(i, "one text for all of them " * 20) for i in range(5000)] + [(10_000, long + "a"), (10_001, long + "b"), (10_002, long + "a"), (10_003, "y" + long)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.mark_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()}
    assert all(got[i] == (4999, 5000, i == 4999) for i in range(5000))
    assert [got[10_000 + i] for i in range(4)] == [(10_002, 2, False), (10_001, 1, True), (10_002, 2, True), (10_003, 1, True)]


def test_keep_one_returns_rows_as_they_came(spark):
    rows = [("b", "same", 1), ("a", "same", 2), ("c", "other", 3), (None, "same", 4)]
    df = spark.createDataFrame(rows, "keep_id string, _rest string, _group long")
    kept = exact.keep_one(df, key="keep_id", text="_rest")
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [("b", "same", 1), ("c", "other", 3)]


# --- residue numbers -------------------------------------------------------------------------------


def test_primes_and_remainders():
    ps = whitening.primes(12)
    assert all(p < 1 << 20 and all(p % q for q in range(2, 1025)) for p in ps) and len(set(ps)) == 12
    assert whitening.BLOCK * (max(ps) // 2 + 1) ** 2 < 1 << 53
    rng = random.Random(1)
    for bound in (0, 1, 10**6, 10**30, 10**80):
        values = np.array([[rng.randint(-bound, bound) for _ in range(4)] for _ in range(3)] + [[bound, -bound, 0, 0]], object)
        moduli = whitening.enough_primes(bound)
        assert prod(moduli) > 2 * bound
        assert (whitening.remaindered({p: (values % p).astype(np.int64) for p in moduli}) == values).all()


def by_hand(vectors):
    """Everything in Python integers, then one double decomposition."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    exact_scatter = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
    return n, y, exact_scatter, np.array([[v / n**3 for v in r] for r in exact_scatter])


def test_scatter_is_exact_and_values_are_white(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 1, 5, 1, 100, 0.1]).tolist()
    n, y, scatter, v = by_hand(vectors)
    table = spark.createDataFrame([(i, r) for i, r in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    rows = whitening.usable(table, "vec_id", "embedding")
    count, sums, least, most = whitening._moments(rows, 6)
    far = max(abs(e) for r in y for e in r)
    assert count == n and whitening.scatter(rows, 6, n, sums, whitening.enough_primes(n * far * far)).tolist() == scatter
    got = whitening.whitened(table).collect()
    assert len(got) == n * 6
    values = np.full((n, 6), np.nan)
    for r in got:
        values[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert int(r["deviation"]) == sum(e * e for e in y[r["vec_id"]]) and r["n"] == n and r["identity_error"] < 1e-9
    assert np.abs(np.cov(values.T, bias=True) - np.eye(6)).max() < 1e-9
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = np.array(y, float) / n @ u / np.sqrt(e)
    assert np.abs(np.abs(values) - np.abs(want)).max() < 1e-6
    explained = {r["component"]: r["explained"] for r in got}
    assert all(abs(explained[i + 1] / (e[i] / np.trace(v)) - 1) < 1e-9 for i in range(6))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [2.0, 2.5, 3.0], [4.0, 1.0, 3.0], [4.0, 1.0, 3.0], [-1e16, 0.25, 3.0]]
    bad = [None, [1.0, None, 2.0], [nan, 0.0, 0.0], [0.0, inf, 0.0], [1.0, 2.0], [], [1e300, 0.0, 0.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(100 + i, v, "y") for i, v in enumerate(bad)] + [(None, [3.0, 3.0, 3.0], "z")]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3, 4, None} and len(got) == 18
    _, y, _, _ = by_hand([*good, [3.0, 3.0, 3.0]])
    large = {r["vec_id"]: r["deviation"] for r in got}
    assert all(large[i] == (d if (d := sum(e * e for e in y[i])) < 10**38 else None) for i in range(5))
    assert all(r["whitened"] is None for r in got if r["component"] == 3)  # the last dimension does not vary
    for v in ([[5.0, 1.0]], []):
        few = whitening.whitened(spark.createDataFrame([(i, r) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()
        assert [r["whitened"] for r in few] == [None] * 2 * len(v)


def test_whitening_query_over_the_table(spark):
    got = queries.op12_embedding_whitening(spark, FOLDER).toPandas()
    vectors = duck("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL", FOLDER)
    assert len(got) == 32 * len(vectors) and dict(got.dtypes)["deviation"] == "int64" and got.identity_error.max() < 1e-4
    _, y, _, _ = by_hand(vectors.embedding.tolist()[:0] or [list(map(float, v)) for v in vectors.embedding])
    want = {i: sum(e * e for e in r) for i, r in zip(vectors.vec_id, y, strict=True)}
    assert all(want[i] == d for i, d in zip(got.vec_id, got.deviation, strict=True))


# --- count columns ---------------------------------------------------------------------------------

TERM = re.compile(divergence.TERM_PATTERN)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_by_hand(rows, least, top):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(LOW)):
            docs[lang, t].add(i)
            counts[lang, source][t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), d in docs.items() if l == lang and len(d) >= least)
        own = sorted(s for l, s in groups if l == lang)
        n = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: share(n[s]) for s in own}
        q = share({t: sum(n[s][t] for s in own) for t in kept})
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize("pairs_held", [1 << 22, 1])
def test_audit_matches_brute_force(spark, monkeypatch, pairs_held):
    monkeypatch.setattr(divergence, "FLUSH", 20)
    monkeypatch.setattr(divergence, "PART", 16)
    monkeypatch.setattr(divergence, "MOST_PAIRS", pairs_held)
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "GAMMA", "éa", "É", "z", "zz", "日本", "tail\U0001f600"] + [f"w{c}" for c in "abcdefgh"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) + rng.choice(["", "!", "1x"]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None])) for _ in range(300)]
    rows += [(None, "xx", "only"), ("12 34", "yy", "p"), ("", "yy", "q"), ("alpha", "zz", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.audit(df, least_docs=3, top=4).collect()
    assert {tuple(r) for r in got} == audit_by_hand(rows, 3, 4) and len(got) == len(set(got))


def test_equal_vectors_are_evaluated_once(spark):
    rows = [(" ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)), "en", s) for s in "ab" for _ in range(30)] + [("more", "en", "a")] * 31
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    counts = divergence.term_counts(df, "text", "lang", "source")
    vectors = divergence._kept_vectors(counts, 30)
    assert vectors.count() == 401 and vectors.select("vector").distinct().count() == 2
    assert {tuple(r) for r in divergence.audit(df).collect()} == audit_by_hand(rows, 30, 50)


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**17, 9 * 10**17 + 10, 7), (0, 5, 0), (10**15, 10**18, 10**10)], "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(*(divergence.F.col(c) for c in "cnv"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in [(9 * 10**17, 9 * 10**17 + 10, 7), (0, 5, 0), (10**15, 10**18, 10**10)]]
