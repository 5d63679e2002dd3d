"""Operators against brute force, exact round trips, and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import chat, common, decontam, graph, jaccard, langid, licenses, packing, queries, rules, sharding, toxicity
from tests.conftest import DATA

FOLDER = str(DATA / "sf0.01")
WORD = re.compile(common.WORD_PATTERN)
LOWER = str.maketrans(common.UPPER, common.LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# --- words -----------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Hello, World", None, "", "ÀB c-d 1２ 日本", "x" * 3000 + " y", "hello world", "!!"] * 3
    for size in (10, 1 << 18):
        got, hashes = [], []
        for chunk in common.chunks(pa.array(texts), size):
            for i in range(chunk.n):
                lo, hi = chunk.word_at[i : i + 2]
                got.append(chunk.words(lo, hi))
                hashes.append(chunk.hashes[lo:hi].tolist())
        assert got == [words(t) for t in texts]
        by_word = defaultdict(set)
        for ws, hs in zip(got, hashes, strict=True):
            for w, h in zip(ws, hs, strict=True):
                by_word[w].add(h)
        assert all(len(h) == 1 for h in by_word.values()) and len({h for s in by_word.values() for h in s}) == len(by_word)


def test_long_text_is_hashed_in_segments(monkeypatch):
    data = np.frombuffer(("word " * 200 + "Ünïcode x" * 50).encode(), np.uint8)
    whole = common.hash_words(data, np.zeros(1, np.int64))
    monkeypatch.setattr(common, "_SEGMENT", 64)
    parts = common.hash_words(data, np.zeros(1, np.int64))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


# --- decontamination -------------------------------------------------------------------------------


@pytest.mark.parametrize("per_round", [4_000_000, 20])
def test_decontamination_matches_brute_force(spark, monkeypatch, per_round):
    monkeypatch.setattr(decontam, "ROUND", per_round)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 13, 15])))) for i in range(12)]
    texts = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))] + [rng.choice(items)[1].upper() for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        texts.append((i, " | ".join(parts)))
    got = decontam.find_windows(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        w = words(dict(texts)[r["doc_id"]])
        hit, found = set(), set()
        for ident, text in items:
            own = words(text)
            n = min(13, len(own))
            for window in {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == window:
                        hit.update(range(i, i + n)), found.add(ident)
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (len(w), len(hit), sorted(found))


def test_items_with_ids_of_text(spark):
    items = spark.createDataFrame([("a", "the quick brown fox"), ("b", "the quick brown fox"), (None, "jumps over the")], "item_id string, text string")
    rows = spark.createDataFrame([(1, "THE quick brown fox jumps over the dog", 3), (2, None, 4)], "doc_id long, text string, hits int")
    got = {r["doc_id"]: r for r in decontam.find_windows(rows, items).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[2]["n_hit"]) == (7, ["a", "b"], 0)


# --- near duplicates -------------------------------------------------------------------------------


def shingle_sets(rows) -> dict[int, frozenset]:
    out = {}
    for r in rows:
        w = words(r["text"])
        out[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_classes(sets: dict[int, frozenset]) -> tuple[dict[int, int], Counter]:
    holders, common_ = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for held in holders.values():
        for x in range(len(held)):
            for y in range(x):
                common_[held[y], held[x]] += 1
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common_.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, links


@pytest.mark.parametrize("block", [1024, 40])
def test_jaccard_join_matches_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    near = []
    for i in range(150):  # a large group of near copies, which small blocks must split
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(999)}"
        near.append((10_000 + i, " ".join(w)))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    classes, links = brute_classes(shingle_sets(rows.collect()))
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(rows).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == classes
    assert {i: r["n_links"] for i, r in got.items() if r["n_links"]} == dict(links)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(rows).collect()) == sorted(set(classes.values()))


def test_chains_make_no_large_groups(spark):
    rng, w, rows = random.Random(5), [f"c{i}" for i in range(60)], []
    for i in range(1200):  # each differs a little from the one before: similar, but under the threshold
        for _ in range(3):
            w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = common.stored(jaccard.signed(df, "doc_id", "text").withColumn("node", F.col("doc_id")), "chain")
    sizes = [r["count"] for r in jaccard._candidates(nodes).groupBy("root").count().collect()]
    assert sum(n * n for n in sizes) < 12_000 and max(sizes, default=0) < 60  # of 1.4 million
    classes, links = brute_classes(shingle_sets(df.collect()))
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == classes and {i: r["n_links"] for i, r in got.items() if r["n_links"]} == dict(links)


def test_of_rows_equal_in_id_and_text_the_first_by_its_columns_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, s, m) for s, m in (("b", {"x": 1}), ("a", {"x": 2}), ("a", {"x": 1}), (None, None))] + [(2, text + " eleven", "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    for n in (1, 3, 7):
        got = jaccard.keep_one(df.repartition(n)).collect()
        assert [(r["source"], r["m"]) for r in got] == [("a", {"x": 1})]


def test_one_of_each_class_stays(spark):
    a, b, c = "a b c d e f", "b x y z w q", "only here now yes"
    rows = [(0, a), (1, a), (1, b), (1, b), (2, None), (2, None), (None, b), (None, c), (None, c), (5, "!!")]
    df = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, _key int, rows int, _own string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(0, a), (1, b), (2, None), (2, None), (None, c), (5, "!!")], key=str)


def test_jaccard_bounds():
    least = jaccard.least_matches()
    assert len(least) == jaccard.HASHES // jaccard.STEP and all(a < b for a, b in zip(least, least[1:], strict=False))
    assert least[-1] < 0.8 * jaccard.HASHES


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# --- packing ---------------------------------------------------------------------------------------


def greedy_bins(lengths, capacity):
    left, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(left, x)
        if i < len(left):
            room = left.pop(i)
        else:
            room, n = capacity, n + 1
        insort(left, room - x)
    return n


def test_best_fit_matches_one_by_one():
    rng = random.Random(2)
    for trial in range(200):
        capacity = rng.choice([7, 16, 100, 2048])
        lengths = [max(1, rng.randint(1, capacity) // (rng.randint(1, 9) if trial % 3 else 1)) for _ in range(rng.randint(0, 300))]
        held, places = defaultdict(list), set()
        for length, rank, n, first, offset in packing.best_fit(Counter(lengths), capacity):
            for k in range(n):
                places.add((length, rank + k))
                held[first + k].append((offset, length))
        assert len(places) == len(lengths)
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(held) == greedy_bins(lengths, capacity)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    packed = packing.pack_documents(docs, path, tokens=True)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: [*e.ids, 0] for i, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    rows = packed.collect()
    got = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["length"] == len(ids) <= 2048 and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["start"] == 2048 * r["piece"]
        got[r["doc_id"]][r["piece"]] = ids.tolist()
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in got.items()} == want
    sequences = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in rows:
        s = np.frombuffer(sequences[r["sequence_id"]]["ids"], "<u4")
        assert len(s) <= 2048 and s[r["offset"] : r["offset"] + r["length"]].tolist() == np.frombuffer(r["ids"], "<u4").tolist()
    assert len(sequences) == greedy_bins([r["length"] for r in rows], 2048)


def test_encoder_matches_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = ["", "<|endoftext|> a", "Ünï ² ½ ª º × ÷ İstanbul ß ẞ", "it's we'll don't I'VE", "a b\u0085c", "日本語 text 12345", "!!!??? ...'s", "\x0b\x0c x", "e\u0301"]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(path).encode(texts) == want


# --- classifiers -----------------------------------------------------------------------------------


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    return query(spark, f"{DATA}/sf0.1").join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()


def auc(y, score):
    rank = score.rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, queries.op2_quality, "quality")
    assert auc(got.y, got.score) > 0.99 and (got.y == got.predicted).mean() > 0.98 and got.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, queries.op6_toxicity, "toxic")
    assert auc(got.y, got.score) > 0.93 and (got.y == got.predicted).mean() > 0.96 and got.score.between(0, 1).all()


def test_language_on_held_out_rows(spark):
    langs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, f"{DATA}/sf0.1").join(langs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.995 and got.score.between(0, 1).all()


def test_language_prototypes_bind_by_place():
    import pyarrow as pa

    (chunk,) = common.chunks(pa.array(["abc", "cba", "ABC", "123", None]))
    vectors, letters = langid.bundles(chunk)
    assert letters.tolist() == [True, True, True, False, False]
    assert vectors[0] @ vectors[2] == pytest.approx(1, abs=1e-5) and abs(vectors[0] @ vectors[1]) < 0.5


def test_disguised_words_are_restored(spark):
    rng = random.Random(8)
    plain = "we walked along the quiet river and talked about weather while old friends were reading books near stone houses under tall green trees".split()
    prose = lambda n: " ".join(rng.choices(plain, k=n))  # noqa: E731  no near copies: those count once
    clean = [(i, prose(40)) for i in range(60)]
    toxic = [(100 + i, " ".join([prose(10), "idiot", prose(8), "moron", prose(6), "pathetic clown", prose(5)])) for i in range(40)]
    hidden = ["1d10t", "m0r0n", "i d i o t", "m.o.r.o.n", "idiooooot", "p@thet1c", "cl0wn", "m*ron"]
    more = [(200 + i, f"the weather was nice, {h} walked along the river") for i, h in enumerate(hidden)] + [(300, "number 10 and 3d or a b, 4x4 and $5"), (301, None), (302, "")]
    schema = "doc_id long, text string"
    train, test = spark.createDataFrame(clean + toxic, schema), spark.createDataFrame(more, schema)
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(test, toxicity.fit(train.unionByName(test), labels)).collect()}
    assert [h for i, h in enumerate(hidden) if got[200 + i]["score"] < 0.7] == []
    assert all(got[i]["score"] < 0.5 for i in (300, 301, 302)) and got[200]["restored"][0]["word"] == "idiot"


def test_decoding_matches_enumeration():
    from itertools import product

    rng = random.Random(12)
    counts = np.array([rng.randrange(60) for _ in range(28**3)])
    model = toxicity.CharacterModel(counts, ["idiot", "moron", "dämlich"])

    def cost(path):
        total, a, b = 0.0, 0, 0
        for letter, more in path:
            total += more
            if letter:
                z = toxicity.letter_number(letter)
                total, a, b = total + model.cost[a][b][z], b, z
        return total + model.cost[a][b][0]

    for token in ["1d10t", "m*ron", "i.d.1.o.t", "aaab", "a$$h01e", "ïd1öt", "||l", "0", "d/ä\nm", *["".join(rng.choices("ab10$*.|iö", k=7)) for _ in range(40)]]:
        paths = [(cost(p), "".join(letter for letter, _ in p)) for p in product(*toxicity.arcs(token))]
        best = min(paths)[0]
        assert any(text == model.decode(token) and c == pytest.approx(best, abs=1e-9) for c, text in paths)


# --- rules, chat, licenses, shards -----------------------------------------------------------------


def test_ablation(spark, docs):
    entries = rules.stored_ledger(docs)
    rows = entries.collect()
    m = rules.mask("v2")
    names = list(rules.rules())
    got = {r["rule"]: (r["failing"], r["only_this"]) for r in rules.ablation(entries, "v2").collect()}
    for i, name in enumerate(names):
        assert got.get(name, (0, 0)) == (sum(r["failed"] >> i & 1 for r in rows), sum(r["failed"] & m == 1 << i for r in rows))


def test_chat_layouts_and_escapes(spark):
    import json

    hard = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]\\", "<<SYS>><</SYS>>\n </s>\n", "", "<<s>>", "[INST] [INST]"]
    records, want = [], {}

    def add(record, turns):
        want[len(records)] = turns
        records.append((len(records), json.dumps(record) if record is not None else None))

    for h in hard:
        add({"messages": [{"role": "system", "content": h}, {"role": "user", "content": h}, {"content": h, "role": "assistant"}]}, [("system", h), ("user", h), ("assistant", h)])
        add({"prompt": h, "response": h}, [("user", h), ("assistant", h)])
        add({"conversations": [{"from": "human", "value": h}, {"from": "gpt", "value": h}, {"from": h, "value": "x"}]}, [("user", h), ("assistant", h), (h, "x")])
        add({"instruction": h, "input": "i", "output": h}, [("system", h), ("user", "i"), ("assistant", h)])
        add({"system": "s", "messages": [{"role": "user", "content": h}]}, [("system", "s"), ("user", h)])
    add({"unknown": 1}, None)
    add(None, None)
    df = chat.canonical_turns(spark.createDataFrame(records, "id long, record string"))
    got = chat.read_back(chat.format_turns(df)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()
    for r in got:
        turns = want[r["id"]]
        if turns is None:
            assert r["layout"] is None and r["formatted"] is None
        else:
            assert [tuple(t) for t in r["read_turns"]] == turns == [tuple(t) for t in r["turns"]]
            assert r["loss"] == "".join(t for role, t in turns if role == "assistant")


def test_chat_loses_no_conversation(spark):
    long = "x </s> " * 3_600_000  # 25 million characters, over the parser's limits
    rows = [
        (1, 0, "user", long), (1, 1, "assistant", "ok"), (2, 0, "user,assistant", "one turn"), (3, 0, "system,user", "two"), (3, 1, "assistant", "turns"),
        (4, 0, "user\nassistant", "a"), (5, 0, "user", "u"), (5, 1, "assistant", long),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(chat.records_of(df))
    assert all(r["fingerprint"] and r["layout"] for r in turns.select("fingerprint", "layout").collect())
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).select("conv_id", "read_turns", "loss").collect()}
    for i in range(1, 6):
        want = [(role, text) for c, _, role, text in rows if c == i]
        assert [tuple(t) for t in got[i]["read_turns"]] == want and got[i]["loss"] == "".join(t for role, t in want if role == "assistant")


def test_layouts_give_what_rows_give(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    turns = chat.canonical_turns(chat.records_of(df))
    assert turns.where("layout IS NULL OR fingerprint IS NULL").count() == 0
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in turns.select("conv_id", "turns").collect()}
    want = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["turn"], r["role"] or "", r["text"] or "")):
        want[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    assert got == want and len(got) > 50


def test_fingerprints_of_many_turns_and_odd_values(spark):
    import json

    many = {"messages": [{"role": "user" if i % 2 else "assistant", "content": f"{i} \"}},{{\" : \\"} for i in range(300_000)]}
    odd = [
        {"messages": [{"role": "user", "content": 'a": "b'}, {"role": "x", "content": "\\"}]}, {"messages": []}, {"messages": [{"role": "user", "content": None}, {"content": "x", "role": "user"}]},
        {"prompt": "messages", "response": '{"messages": []}'}, {"prompt": "", "response": "x", "more": 1}, ["prompt", "response"], {"prompt": ["a"], "response": "b"},
    ]
    rows = [json.dumps(many), *map(json.dumps, odd), json.dumps(odd[0], indent=2), '{"prompt": "a", "response": ', None, ""]
    got = chat.canonical_turns(spark.createDataFrame(list(enumerate(rows)), "i int, record string")).orderBy("i").collect()
    assert len(got[0]["turns"]) == 300_000 and [tuple(t) for t in got[0]["turns"][:2]] == [("assistant", '0 "},{" : \\'), ("user", '1 "},{" : \\')]
    assert [r["layout"] for r in got] == ["messages", "messages", None, "messages", "prompt", None, None, None, "messages", None, None, None]
    assert [tuple(t) for t in got[1]["turns"]] == [("user", 'a": "b'), ("x", "\\")] == [tuple(t) for t in got[8]["turns"]] and got[4]["turns"][1]["text"] == '{"messages": []}'


def test_training_rows_are_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text", "concat('l', id) AS lang")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, _label int")
    got = common.training_rows(docs, labels, "doc_id", "_label", "text", 2000).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(0, "text 0"), (1, "text 1"), (2, "text 1001")]
    monkey = pytest.MonkeyPatch()
    monkey.setattr(common, "MOST_GROUPS", 7)
    assert len(langid.fit(docs)[0]) == 7
    monkey.undo()


def test_votes_match_a_plain_loop(spark):
    from pulseframe.llm import quality

    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    (chunk,) = common.chunks(docs.limit(60).toArrow().column("text").combine_chunks(), 1 << 30)
    vectors = model.project(chunk.n, *quality.terms(chunk))
    for v, got in zip(vectors, model.vote(vectors), strict=True):
        near = sorted(((float(np.dot(v.astype(np.float64), w.astype(np.float64))), i) for i, w in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** 8 for c, _ in near]
        assert got == pytest.approx(sum(w * model.labels[i] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights), abs=2e-3)


def test_bundles_match_a_plain_loop():
    import pyarrow as pa

    texts = ["Hello, wörld 12 x", "a", "Ça va? 日本 ok", "--", "the end the end"]
    (chunk,) = common.chunks(pa.array(texts))
    vectors, _ = langid.bundles(chunk)
    first, second, third = langid._vectors()
    for text, got in zip(texts, vectors, strict=True):
        slots = [0]
        for c in text:
            slots.append(langid._slot(c) if c.isalpha() else 0)
        slots.append(0)
        squeezed = [s for i, s in enumerate(slots) if s or i == 0 or slots[i - 1]]
        total = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:], strict=False):
            if b:
                total += first[a] * second[b] * third[c]
        norm = np.linalg.norm(total)
        assert got == pytest.approx(total / norm if norm else total, abs=1e-4)


def test_license_filters_lose_nothing(spark):
    rng = random.Random(4)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)}) + ["zeta", "eta", "theta"]
    texts = [(i, ". ".join(" ".join(rng.sample(pool, rng.randint(1, 20))) for _ in range(4)) + (rng.choice(["\n", "\n\n"]) + rng.choice(licenses.TEMPLATES)[1] if i % 3 == 0 else "")) for i in range(80)]
    got = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        labels = set()
        for block in re.split(r"\n[^\w\n]*\n|[.!?;][ \t\n\r]", text):
            own = set(words(block))
            labels |= {label for label, t in licenses.TEMPLATES if 20 * len(own & set(words(t))) >= 17 * len(set(words(t)))}
        assert got[i] == labels


def test_shards_move_little(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    rows = sharding.shard_table(keys, weights=[1.0, 1.0, 2.0]).collect()
    counts = Counter(r["shard"] for r in rows)
    assert 1.7 < counts[2] / counts[0] < 2.3 and all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
