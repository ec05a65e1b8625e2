"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, with extra columns of any name unchanged. Whole texts are read, however long; an empty table gives an
empty one. ``run`` writes each stage's result to the shared folder and reads it back for the next.

SQL can't express the classifier, the groups of similar lines, the shingle groups or the packing; each stage is tested
against a brute-force version of its operator, and ``run`` against the stages' composition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callspark.llm.decontaminate import drop_contaminated
from callspark.llm.line_dedup import clean_lines
from callspark.llm.minhash_dedup import drop_near_duplicates
from callspark.llm.packing import pack_online
from callspark.llm.quality import keep_good
from callspark.llm.staging import Stage, passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go.

    A null or empty text has fewer words than a document needs and goes. Each row is judged by its own text, so repeated
    rows stay or go together, and a score at the threshold stays.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines said before, in this or another document, go; ``n_chars`` follows the new text.

    No row goes: a null text stays null, an empty one empty, and a document may lose all its lines. Of similar lines the one
    with the smallest (doc_id, text hash, line number) stays, null ids first; rows that repeat id and text lose the same lines.
    """
    return clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id, null ids last.

    Texts without words (null, empty, blank) are in no group and all stay; rows that repeat a kept id and text stay once.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go, or all words of a shorter one.

    Null and empty texts hold nothing and stay; repeated rows stay or go together. Items that are null or without words ask for nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, a row per piece.

    A null or empty text is its end id only; each of repeated rows is packed. Where two levels are equally good, the choice is fixed by
    the packing's own order, but which documents share a sequence depends on how the rows are dealt over tasks.
    """
    return pack_online(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs, last = Stage(spark, "corpus"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        with passing():
            docs = stage.write(step(spark, docs, sf_dir), name)
        if last is not None:
            stage.drop(last)
        last = docs
    return docs
