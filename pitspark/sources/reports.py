"""Report and ladder files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, required: tuple[str, ...] = ("status", "claim_boundary")) -> None:
    """One JSON object per row; a report without its status or claim is refused before the write."""
    missing = [c for c in required if c not in report.columns]
    if missing:
        raise ValueError(f"report lacks {', '.join(missing)}")
    allowed = F.col("status").isin("computed", "insufficient_data", "oversampled", "degenerate") & (F.col("claim_boundary") == "no_alpha_claim")
    checked = report.withColumn("status", F.when(allowed, F.col("status")).otherwise(F.raise_error(F.lit("invalid report row")).cast("string")))
    checked.write.mode("overwrite").json(path)


def write_ladders(levels: DataFrame, totals: DataFrame, path: str) -> None:
    """Levels and totals as two CSV outputs with headers."""
    # Headings of the level file.
    heads = {"level": "Lv.", "price": "Unit Price($)", "units": "Share", "amount": "Amount of Invest.($)", "share_pct": "Invest.(%)",
             "cumulative_pct": "Accu. Invest.(%)", "cumulative_amount": "Accu. Invest. Total($)", "drop_pct": "Price Drop(%)"}
    rows = levels.select("plan", *[F.col(c).alias(h) for c, h in heads.items()])
    rows.sortWithinPartitions("plan", "`Lv.`").write.mode("overwrite").option("header", True).csv(f"{path}/levels")
    totals.write.mode("overwrite").option("header", True).csv(f"{path}/totals")
