"""Training text from raw documents: five stages, each one of the text operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brisa.llm import language, line_dedup, mixing, ngram_join, sentencepiece_fst
from brisa.llm.common import staged, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or neither a language with half of their letters nor a long span of any."""
    return language.kept(docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with words go that match an earlier one with a Jaccard similarity of 0.8, in scripts
    without spaces by runs of characters; documents of which nothing is left go with them."""
    return line_dedup.without_repeated_lines(docs, num=80, den=100, least_words=1, marks=False, drop_emptied=True, runs=True)


def documents_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of five-word shingles with a similarity of 0.8."""
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to weights that go with the square root of their sizes."""
    return mixing.mix(docs, temperature=0.5, budget=1.0, seed="mix", marks=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, checked by decoding them again."""
    return sentencepiece_fst.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language identification", known_language), ("line dedup", lines_once), ("n-gram Jaccard join", documents_once),
          ("mixing sources", mixed), ("SentencePiece encoding", tokens)]

#: A learned model, a similarity join and a tokenizer are beyond SQL: tests/llm/test_pipeline.py has
#: the same five steps in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are left. Documents with a null text have no letter and go; null ids are kept
    by all stages, and rows of the same id are documents of their own. A null source is a source like others. An empty
    table gives no rows; other columns, whatever their names, are carried through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage-{number + 1}")
    return docs
