"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the
last return the columns of ``docs``. Between stages the result is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitlake.llm import decontam, jaccard_join, packing, pii, toxicity
from pitlake.llm.common import materialize, read_table

WORD_BPE = "word_bpe_49k.json"


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, with a lexicon learned from the labels of ``docs``.

    A null text is empty; null and repeated ids keep their rows; without labels all documents stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")), at=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word n-grams (similarity 0.8 or more) connect: its smallest id.

    Texts without a word are linked to nothing and stay; of rows that repeat an id and its n-grams, one stays.
    """
    return jaccard_join.representatives(docs, words=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; those that mostly consist of such passages go.

    Null texts and repeated rows stay as they are; an empty benchmark changes nothing.
    """
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind in brackets; nulls and repeated rows stay."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    A null text is an empty document; null and repeated ids are packed like others.
    """
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", best_fit_packing),
]

#: Tokenisers, fitted lexicons and trees are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
