"""Alternative data: captured CSV files bound to source contracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import truthy
from ..schemas import ALT_DATA_CSV

BOUNDARY = "source_contract_status_only"


def check_contracts(contracts: DataFrame) -> DataFrame:
    """Required fields filled, the claim boundary kept, no key twice."""
    blank = F.lit(False)
    for name in ("source", "dataset", "authority_url", "pin"):
        blank = blank | (F.trim(F.coalesce(name, F.lit(""))) == "")
    loose = F.coalesce("claim_boundary", F.lit(BOUNDARY)) != BOUNDARY
    wrong = (F.when(blank, F.raise_error(F.lit("a contract states its source, dataset, authority and pin")).cast("string"))
             .when(loose, F.raise_error(F.lit("a contract claims no more than its status")).cast("string")))
    twice = contracts.groupBy("source", "dataset").agg(F.count("*").alias("n"))
    repeated = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate contract "), F.col("source"), F.lit("/"), F.col("dataset"))).cast("string"))
    known = twice.withColumn("source", F.coalesce(repeated, F.col("source"))).select("source", "dataset")
    return contracts.withColumn("source", F.coalesce(wrong, F.col("source"))).join(known, ["source", "dataset"])


def observations(rows: DataFrame, contracts: DataFrame, as_of: str, strict: bool = True) -> DataFrame:
    """Rows (source, dataset, event_date, available_date, value, is_approximate text)
    under their contracts, as known at ``as_of`` (ISO text, compared as text)."""
    terms = check_contracts(contracts).select("source", "dataset", "status", F.coalesce("claim_boundary", F.lit(BOUNDARY)).alias("claim_boundary"))
    joined = rows.join(terms, ["source", "dataset"], "left")
    ready = F.col("status") == "available"
    problem = F.when(F.col("status").isNull(), F.raise_error(F.concat(F.lit("missing source contract for "), F.col("source"), F.lit("/"), F.col("dataset"))).cast("string"))
    if strict:
        problem = problem.when(~ready, F.raise_error(F.concat(F.lit("source contract is not ready: "), F.col("source"))).cast("string"))
    known = joined.withColumn("claim_boundary", F.coalesce(problem, F.col("claim_boundary")))
    return known.filter(F.trim("available_date") <= as_of).select(
        "source", "dataset", F.trim("event_date").alias("event_date"), F.trim("available_date").alias("available_date"),
        F.col("value"), truthy(F.col("is_approximate")).alias("is_approximate"), "claim_boundary")


def read_bundle(spark: SparkSession, files: Mapping[tuple[str, str], str], contracts: DataFrame, as_of: str,
                strict: bool = True) -> DataFrame:
    """One CSV path per (source, dataset), ordered by source, dataset, event and available date."""
    rows = None
    for (source, dataset), path in files.items():
        one = spark.read.schema(ALT_DATA_CSV).option("header", True).csv(path).withColumns(
            {"source": F.lit(source), "dataset": F.lit(dataset)})
        rows = one if rows is None else rows.unionByName(one)
    return observations(rows, contracts, as_of, strict).orderBy("source", "dataset", "event_date", "available_date")


def read_csv(spark: SparkSession, path: str, contract: tuple[str, str], contracts: DataFrame, as_of: str, strict: bool = True) -> DataFrame:
    """S5"""
    return read_bundle(spark, {contract: path}, contracts, as_of, strict)
