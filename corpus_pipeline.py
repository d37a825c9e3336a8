"""A training-text pipeline of five stages over the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaybook.llm import entries, jaccard, packing, pii, rules, toxicity
from quaybook.llm.shared import settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the learned decision list keeps; an empty or null text fails its base rules, repeated rows are judged alike."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is predicted toxic; an empty or null text is clean, as is everything where no label tells toxic from clean."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each group of near copies, once; a text without words, or a row without an id, is no copy and stays."""
    return jaccard.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; all rows stay, a null text stays null, and ``n_chars`` follows the text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens; a null text is an empty one, and repeated rows are packed each."""
    # the stages share their Python workers, so this one remembers fewer words
    return packing.pack(docs, entries.pack_config(cached_words=250_000))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", ngram_jaccard),
    ("personal_data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            # the next stage reads its documents more than once
            docs = settle(docs)
    return docs


ORACLE_SQL = None
