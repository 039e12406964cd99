"""Corpus pipeline over ``documents``: rules, lines, near copies, leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on what the one before it kept;
all but the last return the columns they got. ``run`` writes each stage's result
to the shared folder and rereads it for the next.

In every stage: a null text counts as empty; null and repeated ids each keep
their rows unless a stage says otherwise; columns of any name travel along
unchanged; an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import decontaminate, line_dedup, near_dup, packing, quality
from twinfold.llm.common import documents, save


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule go; null, empty and short texts fail the base."""
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, closely or exactly, the first stays; ``n_chars`` follows.

    First by document id, null last, then by line. Documents that lose all their
    words go, those that had none stay. Rows equal in id and text are one document and keep the same lines.
    """
    return line_dedup.remove_lines(docs, min_words=1)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies: five-word shingles, similarity of 0.8 or more.

    The least id stays, null last; of repeated rows one; documents without words all stay.
    """
    return near_dup.deduplicate(docs, 80, 100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an empty benchmark takes none."""
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens; an empty text is a piece of the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("dedup_lines", dedup_lines),
    ("dedup_near", dedup_near),
    ("drop_leaks", drop_leaks),
    ("pack", pack),
]

#: SQL has no tokenizer and no packing of this kind; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
