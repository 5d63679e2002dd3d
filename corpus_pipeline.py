"""The corpus pipeline: toxicity, language, near duplicates, decontamination, packing.

Each stage is a function of (session, documents, folder of the tables). It works on all rows that
its predecessor kept and returns the columns of the documents, all but the last, which returns the
packed pieces. :func:`run` writes each stage's result to the shared folder and reads it again; what a
stage stored on the way, and its input, are removed then.

Nulls, ties, repeats, in every stage: further columns of the documents come through unchanged, whatever
their names; empty tables give empty results; very long texts are read whole; rows that repeat are
judged each for itself, but for near duplicates. A null or empty text

* is not toxic (its score is the rate of toxic rows without listed words);
* has no language, so it goes in the language stage, as do texts without letters;
* would be no near duplicate of anything, nor contaminated; packed, it is the end token alone.

A null id is an id like others: such rows never train, and of near duplicates they come last. Of equal
ids in a class of near duplicates the text with the lesser hash stays, of equal rows one. Without
labelled rows the toxicity stage keeps all; without languages to learn from the language stage keeps
none.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import decontam, jaccard, langid, packing, toxicity
from pulseframe.llm.common import crc_fold, discard, finished

TOXIC_FROM = 0.7
#: Languages to keep, as ``lang`` names them; None for all that can be learned from the documents.
WANTED: Collection[str] | None = None


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str, list[str]], DataFrame], keep: Column) -> DataFrame:
    """Rows of the documents that ``keep`` holds for, given the columns that ``judge`` adds to (rows, text, columns).

    The documents' own columns are numbered on the way, so their names cannot clash with those.
    """
    numbers = [f"_{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*numbers), numbers[docs.columns.index("text")], numbers)
    return judged.where(keep).select(*[F.col(n).alias(c) for n, c in zip(numbers, docs.columns, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the limit; labels of a third of the ids are left out of the fit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_fold(F.col("doc_id"), 3) != 1))
    return _kept(docs, lambda d, text, own: toxicity.score(d, model, text, own), F.col("score") < TOXIC_FROM)


def drop_other_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Collection[str] | None = WANTED) -> DataFrame:
    """Documents whose predicted language is a wanted one; those without letters have none.

    The language that the documents claim is not looked at, but for the fit. The share of the best
    language is no criterion: it falls with every similar language learned.
    """
    model = langid.fit(langid.train_rows(docs))
    accepted = [name for name in model[0] if wanted is None or name in wanted]
    return _kept(docs, lambda d, text, own: langid.identify(d, model, text, own), F.col("lang_pred").isin(accepted))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, lambda d, text, own: decontam.find_windows(d, items, text, own), ~decontam.contaminated())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_other_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the learned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        given = docs
        docs = finished(lambda stage=stage, given=given: stage(spark, given, sf_dir), f"stage-{name}")
        discard(given)
    return STAGES[-1][1](spark, docs, sf_dir)
