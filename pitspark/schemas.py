"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql import types as T

TS = T.TimestampNTZType()

PRICES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("event_date", TS),
    T.StructField("available_date", TS),
    T.StructField("close", T.DoubleType()),
    T.StructField("is_approximate", T.BooleanType()),
])

MACRO = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("event_date", TS),
    T.StructField("available_date", TS),
    T.StructField("value", T.DoubleType()),
    T.StructField("is_approximate", T.BooleanType()),
])

LISTINGS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("list_date", TS),
    T.StructField("delist_date", TS),
])

SNAPSHOT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("available_date", T.StringType()),
    T.StructField("is_approximate", T.BooleanType()),
    T.StructField("captured_at", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("event_date", T.StringType()),
    T.StructField("backfill", T.BooleanType()),
    T.StructField("gap_fill", T.BooleanType()),
    T.StructField("gap_window_since", T.StringType()),
    T.StructField("history_start", T.StringType()),
])

# The nesting of the chart payload.
CHART = (
    "struct<chart: struct<result: array<struct<timestamp: array<bigint>, "
    "indicators: struct<quote: array<struct<close: array<double>>>>>>>>"
)

ALT_DATA_CSV = T.StructType([
    T.StructField("event_date", T.StringType()),
    T.StructField("available_date", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("is_approximate", T.StringType()),
])

ALT_CONTRACT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("authority_url", T.StringType()),
    T.StructField("pin", T.StringType()),
    T.StructField("default_enabled", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("claim_boundary", T.StringType()),
])

METRIC = T.StructType([
    T.StructField("cumulative_return", T.DoubleType()),
    T.StructField("annualized_return", T.DoubleType()),
    T.StructField("annualized_vol", T.DoubleType()),
    T.StructField("max_drawdown", T.DoubleType()),
    T.StructField("sharpe", T.DoubleType()),
    T.StructField("turnover", T.DoubleType()),
    T.StructField("basis", T.StringType()),
    T.StructField("segment", T.StringType()),
])

RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("strategy_name", T.StringType()),
    T.StructField("strategy_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.ArrayType(METRIC)),
    T.StructField("is_baseline", T.BooleanType()),
    T.StructField("created_at", TS),
])

EXPERIMENT = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("strategy_name", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("run_ids", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("claim_boundary", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

SOURCE_HEALTH = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("default_enabled", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])
