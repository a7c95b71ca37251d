"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage reads what the one before kept; all but the last return the columns of ``documents``. Empty tables give
empty results of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastertab.functions.state import settle
from rastertab.llm import byte_bpe, line_templates, ngram_join, positional_index, quality_llr
from rastertab.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; texts stay as they are.

    NULL, empty and blank texts have no words and go. Rows are judged one by one by their text, so repeated rows, repeated
    and NULL ids get equal verdicts. Without usable labels only the base rules judge. Extra columns pass through.
    """
    return quality_llr.keep_good(docs, quality_llr.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines whose template recurs across them; n_chars follows the text.

    NULL and empty texts stay as they are, a text of template lines alone becomes empty. Equal texts are treated alike,
    whatever their ids. Extra columns pass through.
    """
    return line_templates.drop_template_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by 5-word shingles at a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays. Texts without words link with nothing and stay, so do rows without a doc_id; rows that
    share the doc_id that stays all stay. Extra columns pass through.
    """
    return ngram_join.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or all words of a shorter one).

    NULL and empty texts have no words and stay; items without words hit nothing, items without an item_id hit like any
    other. Rows are judged by their text alone. Extra columns pass through.
    """
    return positional_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document left, decoded again and compared with its text.

    NULL and empty texts have no ids; repeated rows and rows without a doc_id are rows of their own.
    """
    return byte_bpe.round_trip(docs).selectExpr("doc_id", "cast(size(ids) AS bigint) AS n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode_tokens", encode_tokens),
]
ORACLE_SQL = None  # scores, similarity classes and token ids are beyond SQL; tests/llm/test_pipeline.py has plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
