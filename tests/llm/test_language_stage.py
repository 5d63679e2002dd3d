"""The language stage goes by the predicted language, and loses no document of a wanted one."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import DATA


def test_no_lettered_document_is_lost(spark):
    folder = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # the languages as they are, and once more under other names: every share falls to a half at most
    twice = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "lang": F.concat("lang", F.lit("2"))}))
    lettered = {r["doc_id"] for r in twice.where(F.col("text").rlike("[A-Za-z]")).select("doc_id").collect()}
    kept = {r["doc_id"] for r in P.drop_other_languages(spark, twice, folder).select("doc_id").collect()}
    assert lettered <= kept and len(lettered) > 1000


def test_unwanted_languages_go_whatever_they_claim(spark):
    folder = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    prose = {}
    for r in docs.where("lang IS NOT NULL AND length(text) > 400").orderBy("doc_id").collect():
        prose.setdefault(r["lang"], []).append(r)
    names = sorted(prose)
    unwanted = names[0]
    # held out from the fit, and claiming another language than they are in
    claims = [(int(r["doc_id"]), names[(names.index(lang) + 1) % len(names)]) for lang in names for r in prose[lang]]
    turned = docs.join(spark.createDataFrame(claims, "doc_id long, _claim string"), "doc_id").where("pmod(crc32(cast(doc_id AS string)), 4) = 2")
    turned = turned.withColumns({"lang": F.col("_claim"), "doc_id": F.col("doc_id") + 0}).select(docs.columns)
    both = docs.where("pmod(crc32(cast(doc_id AS string)), 4) <> 2").unionByName(turned)
    kept = {r["doc_id"] for r in P.drop_other_languages(spark, both, folder, [n for n in names if n != unwanted]).select("doc_id").collect()}
    judged = {r["doc_id"] for r in turned.select("doc_id").collect()}
    there = {lang: {r["doc_id"] for r in prose[lang]} & judged for lang in names}
    assert min(map(len, there.values())) >= 10
    assert not there[unwanted] & kept
    assert all(there[n] <= kept for n in names if n != unwanted)
    assert P.drop_other_languages(spark, docs, folder, []).count() == 0
