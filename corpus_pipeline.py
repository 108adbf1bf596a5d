"""A training corpus from raw documents, stage by stage.

1. Quality: documents that the classifier, fitted on the labels, holds toxic or poor go.
2. Near-duplicates: of each group linked by SimHash one document stays. Copies of which some words were changed differ in
   more than three of the 64 bits too often for one fingerprint of three-word shingles, so five fingerprints of
   two-word shingles are taken, and any of them links that differs in up to five bits: of pairs that share 0.8 or more
   of their five-word shingles this catches over nine in ten.
3. Repeated passages: words in windows of 35 that occur elsewhere go; documents left without words go.
4. Secrets: every span found is replaced by a mark.
5. Packing: what is left, tokenized, in as few sequences of 2048 as the configuration program finds.

A stage returns the columns of ``documents``, the last one the pieces and their places. Stages accept null texts and ids,
repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm import bpe, packing, quality, secrets, simhash, substrings
from cityloom.llm.common import packed, table, unpacked
from cityloom.llm.queries import vocabulary_path
from cityloom.runtime import Rounds

#: No SQL trains the classifier or runs the tokenizer; tests/llm holds the stages' rows against known ones on small tables.
ORACLE_SQL = None


def _cleaned(rows: DataFrame, docs: DataFrame, text, changed) -> DataFrame:
    """The columns of ``docs`` out of ``rows`` with the new ``text``, and ``n_chars`` of it where it changed."""
    n_chars = {}
    if "n_chars" in docs.columns:
        n_chars["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return unpacked(rows, docs, text=text, **n_chars)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    return quality.select(docs, model)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=2, tables=5, radius=5)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(packed(docs, "text", text=F.col("text")))
    left = cleaned.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    return _cleaned(left, docs, F.when(changed, F.col("kept")).otherwise(F.col("text")), changed)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(packed(docs, "text", doc_id=F.col("doc_id"), text=F.col("text"), before=F.xxhash64("text")))
    return _cleaned(cleaned, docs, F.col("text"), F.col("before") != F.xxhash64("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, bpe.vocabulary(spark, vocabulary_path())))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_stage),
    ("substring dedup", passage_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    rounds, docs = Rounds(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = rounds.keep(stage(spark, docs, sf_dir), "stage")
    return docs
