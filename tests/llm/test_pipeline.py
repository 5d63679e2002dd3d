"""The corpus pipeline against a brute-force version of its exact stages, and its stages' contracts."""

from __future__ import annotations

import corpus_pipeline as P
from pulseframe.llm import common
from tests.conftest import DATA
from tests.llm.test_operators import brute_classes, greedy_bins, shingle_sets, words

FOLDER = str(DATA / "sf0.01")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    kept = {"": {r["doc_id"]: r for r in docs.collect()}}
    last = ""
    for name, stage in P.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert set(kept[name]) <= set(kept[last]) and all(kept[name][i] == kept[last][i] for i in kept[name])
        last = name
    clean = [i for i in kept[""] if i in labels and not labels[i]["toxic"]]
    assert sum(i in kept["toxicity"] for i in clean) >= 0.99 * len(clean) and len(kept["toxicity"]) < len(kept[""])
    assert len(kept["language"]) >= 0.99 * len(kept["toxicity"])
    classes, _ = brute_classes(shingle_sets(kept["language"].values()))
    assert set(kept["near_duplicates"]) == set(classes.values())
    for i, r in kept["near_duplicates"].items():
        w = words(r["text"])
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
        assert (i in kept["decontamination"]) == (not (hit and 20 * len(hit) >= len(w)))
    rows = P.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(kept["decontamination"])
    assert len({r["sequence_id"] for r in rows}) == greedy_bins([r["length"] for r in rows], 2048)
    again = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in P.run(spark, FOLDER).collect()}
    assert again == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows}
