"""A corpus cleaned in stages; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrail.llm.common import Scratch, read
from fieldrail.llm.decontaminate import drop_leaks
from fieldrail.llm.minhash_dedup import drop_near_duplicates
from fieldrail.llm.queries import tokenizer_path
from fieldrail.llm.sentencepiece_codec import encode
from fieldrail.llm.substring_dedup import remove_repeats
from fieldrail.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from labels of the rows it is given."""
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document only."""
    out = remove_repeats(docs, size=50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within a fifth of its words go."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left."""
    return encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]
#: Hash sketches and a trained model have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(name, docs)
        if 0 < k < len(STAGES) - 1:  # what this stage has read is written anew
            scratch.drop(STAGES[k - 1][0])
    return docs
