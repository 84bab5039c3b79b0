"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound in days and label of the native cadences.
CADENCE_BOUNDS = [(4, "daily"), (10, "weekly"), (45, "monthly"), (135, "quarterly")]
# Days between two rebalances; any other label counts as monthly.
CADENCE_DAYS = {"daily": 1.0, "weekly": 7.0, "monthly": 30.4375, "quarterly": 91.3125}
DAYS_PER_MONTH = 30.4375
OVERSAMPLE_TOLERANCE = 0.5


def trading_cost(turnover: Column, bps: Column) -> Column:
    """F1"""
    return F.greatest(turnover, F.lit(0.0)) * bps / 10000.0


def cadence(days: Column) -> Column:
    """F3"""
    label = F.when(days <= 0, "irregular")
    for bound, name in CADENCE_BOUNDS:
        label = label.when(days <= bound, name)
    return label.otherwise("irregular")


def cadence_days(rebalance: Column) -> Column:
    """F4"""
    days = F.lit(CADENCE_DAYS["monthly"])
    for name, value in CADENCE_DAYS.items():
        days = F.when(rebalance == name, value).otherwise(days)
    return days


def oversampled(coarsest_days: Column, rebalance_days: Column, tolerance: float = OVERSAMPLE_TOLERANCE) -> Column:
    """rebalancing clearly finer than the coarsest asset is sampled."""
    return coarsest_days > rebalance_days * (1.0 + tolerance)


def whole_days(start: Column, end: Column) -> Column:
    """Full days from start to end; zone-free timestamps, so no clock change counts."""
    return F.extract(F.lit("DAY"), end - start)


def months_between_dates(start: Column, end: Column) -> Column:
    """Whole days over the mean month length; -1 when the span is empty."""
    return F.when(end >= start, whole_days(start, end) / DAYS_PER_MONTH).otherwise(-1.0)


def file_safe(source: Column) -> Column:
    """source id as a file name."""
    return F.replace(F.replace(source, F.lit(":"), F.lit("_")), F.lit("^"), F.lit("idx_"))


def source_symbol(source: Column) -> Column:
    """what follows the first colon."""
    return F.regexp_extract(source, "^[^:]*:(.*)$", 1)


def truthy(text: Column) -> Column:
    """F7"""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "y")


def last_csv_date(raw: Column) -> Column:
    """F8: first field of the last non-empty line, null for a header only."""
    lines = F.filter(F.split(F.trim(raw), "\r?\n"), lambda line: line != "")
    return F.when(F.size(lines) > 1, F.get(F.split(F.element_at(lines, -1), ","), F.lit(0)))


def last_chart_date(raw: Column, schema: str) -> Column:
    """F8: UTC day of the last timestamp that has a close."""
    result = F.get(F.from_json(raw, schema)["chart"]["result"], F.lit(0))
    pairs = F.arrays_zip(result["timestamp"].alias("t"), F.get(result["indicators"]["quote"], F.lit(0))["close"].alias("c"))
    kept = F.filter(pairs, lambda p: p["t"].isNotNull() & p["c"].isNotNull())
    return F.date_format(F.timestamp_seconds(F.try_element_at(kept, F.lit(-1))["t"]), "yyyy-MM-dd")


def canonical_hash(value: Column, length: int | None = None) -> Column:
    """SHA-256 over the JSON of a struct whose fields stand in sorted order."""
    digest = F.sha2(F.to_json(value), 256)
    return digest if length is None else F.substring(digest, 1, length)


def regime(trend: Column, curve: Column, threshold: float = 0.0) -> Column:
    """struct(label, confidence)."""
    def signal(label, confidence):
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    return (F.when(trend.isNull() & curve.isNull(), signal("unknown", 0.0))
            .when(curve < 0, signal("defensive", 0.75))
            .when(trend < threshold, signal("defensive", 0.65))
            .otherwise(signal("risk_on", 0.60)))


def oos_net(metrics: Column) -> Column:
    """the first out-of-sample net metric of a run, or null."""
    found = F.filter(metrics, lambda m: (m["segment"] == "out_of_sample") & (m["basis"] == "net"))
    return F.try_element_at(found, F.lit(1))


def uniform(seed: int, *parts: Column) -> Column:
    """A reproducible uniform number in [0, 1): 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def round_to_step(units: Column, step: Column) -> Column:
    """F16: at least one step, then half-even to the digits the step implies."""
    digits = -F.log10(step).cast("int")
    power = F.pow(F.lit(10.0), digits)
    return F.rint(F.greatest(units, step) * power) / power


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7."""
    # Coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + p * x)
    series = F.lit(0.0)
    for coefficient in reversed(a):
        series = (series + coefficient) * t
    tail = series * F.exp(-x * x) / 2.0
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)
