"""From raw documents to packed training sequences, one corpus operator per stage.

Quality rules drop repetitive and junk texts, exact and near duplicates leave one document
of each group, the mix brings the sources to their target weights (a document taken twice
is there twice), and packing places every piece of every document in a sequence.

Defined results: a null text counts as empty, and too short for the quality rules; a row without
id takes part like any other and is the first to go among copies; of repeated rows one stays;
other columns pass through all stages but the last, whatever their names; an empty table
gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitspark.llm import exact, mixing, near, packing, quality
from pitspark.llm.common import dataset, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_rows(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_file())


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage),
          ("source mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dataset(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot tokenise. Tests hold the rows of every other stage against its operator's SQL over the
#: stage's own input, and the packed pieces against the tokenizer.
ORACLE_SQL = None
