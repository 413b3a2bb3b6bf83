"""From raw documents to token ids, in four stages; each works on all that its predecessor kept.

Toxic documents go; of each class of near-duplicates the one with the least id stays; documents of which benchmark
passages make up a twentieth or more go, and smaller passages are cut out of the others; the rest becomes token ids,
with the text that these give back.

Cases: null and empty texts are documents like others, of which near_dup.py says what copies they are, and have no
tokens. Rows with one id, or none, are judged each on its own text, and a class keeps one row. Other columns stay as they are, whatever their
names; null labels and labels of unknown documents teach nothing. Without documents no rows come out; without labels or
benchmark those stages keep all."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.decontaminate import remove_contamination
from veilspark.llm.near_dup import NearDuplicates
from veilspark.llm.sentencepiece_viterbi import encode_texts
from veilspark.llm.shared import new_dir, remove, table, temporary
from veilspark.llm.toxicity import reject_toxic, train

MODEL = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return NearDuplicates(docs).kept()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c != "text")
    found = encode_texts(docs, public_tokenizers.path(MODEL), keep=others)
    own = {c: F.col(f"k{i}") for i, c in enumerate(others)} | {"text": F.col("decoded")}
    return found.select(*[own[c].alias(c) for c in docs.columns], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written into the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_dir(spark, name)
        with temporary(spark):  # what a stage writes for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: SQL cannot express the classifier, the classes or the ids; tests/llm holds the stages against brute force.
ORACLE_SQL = None
