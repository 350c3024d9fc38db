"""Corpus preparation: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of docs. Every stage works on all rows that its
predecessor kept. Nulls: a null or empty text has no language and goes in the first stage; null keys pass all
stages, and only equal rows of theirs are near duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import langid, neardup, packing, toxicity
from tracklens.llm.common import Scratch, free, kept, table
from tracklens.llm.queries import vocabulary_path

#: Documents go from this toxicity on, the operator's own threshold, and below this certainty of their language. Of
#: 1,500 held-out documents at sf0.1 the least certain right answer, a text of one word, has 0.40; texts in other
#: scripts have about 0.25 of four languages.
TOXIC_FROM = toxicity.THRESHOLD
LANGUAGE_FROM = 0.35
#: And below this share of n-grams that the learned texts have, whatever the languages: of the held-out documents at sf0.1 the
#: least is 0.84 (0.76 of two languages), texts in other scripts have 0.23 at most, of other languages 0.4 as a rule.
KNOWN_FROM = 0.45


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; learns from the ones whose lang is given."""
    model = langid.fit(docs, langid.remainder(F.col("doc_id"), 5) != 0)
    judged = langid.predict(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LANGUAGE_FROM) & (F.col("lang_known") >= KNOWN_FROM)).select(*docs.columns)


def mild(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below TOXIC_FROM; learns from the labels of documents that are left."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), langid.remainder(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).where(F.col("toxic_score") < TOXIC_FROM).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest key of each group of near duplicates, and one of rows that are repeated."""
    found = neardup.near_duplicates(docs)
    own, rows = free(docs, "own", "rows")
    stay = found.where("kept or doc_id is null").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias(rows))
    # not by broadcast, whatever its size: it grows with the documents
    left = docs.join(kept(stay, "stay").hint("merge"), docs["doc_id"].eqNullSafe(F.col(own)))
    once = left.where(F.col(rows) == 1).select(*docs.columns)
    again = left.where(F.col(rows) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, each of one document."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("toxicity", mild),
    ("near_duplicates", distinct_documents),
    ("packing", packed),
]

#: SQL can express neither the string kernels nor byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            work = Scratch(spark, f"stage-{name}")
            docs = work.kept(docs, "documents")
            if before:
                before.clear()
            before = work
    return docs
