"""Corpus pipeline: language ID, line dedup, near-duplicates, passage dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Null and empty texts pass as each stage's docstring
says; an empty table passes through; extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import langid, lines, neardup, packing, passages
from tagloom.llm.common import materialise, table

#: In this order; each calls one operator (numbers 5, 8, 3, 6 and 7).
STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", lines.pipeline_stage),
    ("near_duplicates", neardup.stage),
    ("passage_dedup", passages.stage),
    ("packing", packing.stage),
]

#: A trained classifier and 64-bit hashes can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
