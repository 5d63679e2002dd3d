"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pulseframe.llm import queries as Q
from pulseframe.llm import sql as S
from tests.conftest import duck, rows_of

QUERIES = Q.queries()
PROSE = "the quick brown fox jumps over the lazy dog while seven wise men watch from the old stone bridge in silence"


def write_tables(folder, docs, bench, labels, conv):
    clash = {"score": "x", "n_words": 1, "piece": "p", "signature": "s", "shard": 5, "hits": 2, "_text": "t", "length": 9, "lang_pred": "q"}
    doc_cols = {
        "doc_id": pa.array([d[0] for d in docs], pa.int64()),
        "text": pa.array([d[1] for d in docs], pa.string()),
        "lang": pa.array([d[2] for d in docs], pa.string()),
        "source": pa.array([d[3] for d in docs], pa.string()),
        "n_chars": pa.array([None if d[1] is None else len(d[1]) for d in docs], pa.int64()),
    } | {k: pa.array([v] * len(docs), pa.string() if isinstance(v, str) else pa.int64()) for k, v in clash.items()}
    pq.write_table(pa.table(doc_cols), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": pa.array([b[1] for b in bench], pa.string())}), folder / "benchmark.parquet")
    pq.write_table(
        pa.table({n: pa.array([r[i] for r in labels], t) for i, (n, t) in enumerate([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])}),
        folder / "labels.parquet",
    )
    pq.write_table(
        pa.table({n: pa.array([r[i] for r in conv], t) for i, (n, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}),
        folder / "conversations.parquet",
    )
    vectors = [[0.1 * i, 1.0 / (i + 1), float(i % 3)] for i in range(len(docs) and 12)] + ([None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [1.0], []] if docs else [])
    ids = [None if i == 3 else i // 2 for i in range(len(vectors))]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "n": pa.array(["x"] * len(ids), pa.string())}), folder / "embeddings.parquet")
    return str(folder)


#: Queries whose rows are not the documents.
OTHER_ROWS = ("op3_packing", "op7_chat_formatting", "op12_embedding_whitening", "op13_source_divergence")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    docs = [(i, f"{PROSE} number {i} and {i * 7} more", "en", f"s{i % 3}") for i in range(1, 40)]
    docs += [(100 + i, "el perro corre por la calle y la niña mira desde la ventana azul", "es", "s0") for i in range(20)]
    docs += [
        (None, "text without an id, released under the MIT License.", "en", "a"),
        (200, None, "en", "a"), (201, "", "en", None), (202, " \n\t ", None, "b"), (203, "12345 !!! ???", "en", "b"),
        (204, "word", "en", "b"), (205, "日本語のテキスト 한국어 العربية", "xx", "c"), (206, "a" * 20_000, "en", "c"),
        (207, (PROSE + "\n") * 150, "en", "c"), (208, "\x00\x01 odd \ufffd \U0001f600 😀 𝔘nicode", "en", "c"),
        (209, "same", "en", "d"), (209, "same", "en", "d"), (209, "other text of five words here", "en", "d"), (None, None, None, None),
        (210, "Licensed under the Apache License, Version 2.0. mit license MIT LICENSE", "en", "d"),
        (211, "\\</s> [INST] i d i o t <|endoftext|> it's we'll 1d10t", "en", "d"), (212, "A\u030a B\u0308 İstanbul ǅ ß", "en", "d"),
    ]
    bench = [(1, PROSE), (2, "the quick brown"), (3, None), (4, ""), (None, "seven wise men watch"), (5, "!!!"), (6, PROSE), (6, PROSE + " again and again")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(1, 40)] + [(None, 1, 1), (200, None, 1), (201, 0, None), (1, 1, 1), (999, 1, 0)]
    conv = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"),
        (3, 0, None, None), (3, None, "assistant", "x"), (None, 0, "user", "n"), (4, 0, "tool", "<<ROLE>> \\\\[INST] </s>\\"), (4, 0, "tool", "tie"),
        (5, 0, "user", "</s>\n[INST]"), (5, 1, "assistant", ""), (5, 2, "assistant", "two \\<s> \\\\</s>"), (6, 0, "system", "only"), (7, 0, "[INST]", "role"),
        (8, 0, "system", "rules"), (8, 1, "user", "\u2028 \" \\ \x07 😀"), (8, 2, "assistant", "ok"), (8, 3, "user", "more"),
    ]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    return write_tables(tmp_path_factory.mktemp("odd"), docs, bench, labels, conv), len(docs)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    folder, n = odd
    got = QUERIES[name](spark, folder).toPandas()
    if name not in OTHER_ROWS:
        assert len(got) == n
    if name.startswith("op12"):
        assert len(got) == 12 * 3
    if name in S.oracle_sql():
        assert rows_of(got) == rows_of(duck(S.oracle_sql()[name], folder))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty).toPandas()
    assert len(got) == (1 if name == "op7_chat_formatting" else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_very_long_texts(spark, tmp_path, name):
    docs = [(1, "a" * 300_000, "en", "s"), (2, (PROSE + "\n") * 3000, "en", "s"), (3, "i d i o t " * 20_000, "en", "s")]
    folder = write_tables(tmp_path, docs, [(1, PROSE)], [(1, 1, 0), (2, 0, 1)], [(1, 0, "user", "x" * 300_000), (1, 1, "assistant", "</s>" * 50_000)])
    rows = QUERIES[name](spark, folder).collect()
    if name.startswith(("op12", "op13")):  # the former reads no texts, in the latter no term is in 30 documents
        assert len(rows) == (12 * 3 if name.startswith("op12") else 0)
        return
    assert {r["conv_id" if name.startswith("op7") else "doc_id"] for r in rows} == ({1, -7} if name.startswith("op7") else {1, 2, 3})
