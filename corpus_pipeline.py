"""A corpus pipeline of five training-data operators; each stage's Parquet is the next one's documents.

language_id drops documents without a known language and sets `lang`; near_duplicates keeps one document of each class
of texts whose five-word shingles reach a Jaccard similarity of 0.8; repeated_passages removes passages of 50 words or
more that a document before holds; private_data replaces personal data by pseudonyms; packing fills sequences.

Cases, by stage. Null and empty texts, and texts without a letter, have no language and go with language_id. Very long texts are
read whole by every stage. Rows that share a doc_id are judged each by language_id; near_duplicates keeps one of them, with
the least text; rows without a doc_id are kept by near_duplicates and repeated_passages as they are, pseudonymised and packed.
Copies and ties: the lower doc_id stays. repeated_passages drops documents that lose all their words. Other columns, whatever
their names, are kept by all stages but the last. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import best_fit, language_id, lsh_forest, paragraph_dedup, pii_feistel
from cairn.llm.common import discard, documents, stored

#: A prediction with a score at or below this is no known language.
LEAST_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.one_of_each(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paragraph_dedup.without_repeats(docs)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymised(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack_default(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("private_data", replace_private_data),
    ("packing", pack_sequences),
]

#: SQL has no SVM, MinHash, Feistel network or tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
