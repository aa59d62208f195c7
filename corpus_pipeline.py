"""From raw documents to packed training sequences: five stages, each stored and reread as the next one's input.

Counted as part of ``linkloom.llm``.

Rows with a null id or text, repeated rows and empty tables go through every stage as its operator defines: a null
text has no words and no values and is packed as one end token if the rules keep it, of repeated rows one stays in the
second stage, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.functions.scratch import cut
from linkloom.llm import decontam, jaccard, packing, pii, quality_rules
from linkloom.llm.common import documents, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the rules are learned from the labels of what is there."""
    rules = quality_rules.learn_rules(quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return quality_rules.keep_good(docs, rules)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of similarity 0.8 or more."""
    return jaccard.keep_one(docs, k=5, num=4, den=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal values, under the session's key or one of this run alone."""
    return pii.pseudonymize(docs, pii.run_key(spark))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("pii_pseudonyms", private_values),
    ("best_fit_packing", sequences),
]

#: Learned rules, similarity components, keyed permutations and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
