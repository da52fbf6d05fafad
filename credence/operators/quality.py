"""Data-quality counts of a raw frame: one aggregate over the input, one window pass for those per user."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import truth
from credence.functions.durations import micros, shifted
from credence.schema import ColumnMapping, SchemaError

#: Points that a finding of a severity costs.
PENALTY = {"INFO": 0, "LOW": 2, "MEDIUM": 7, "HIGH": 15, "CRITICAL": 30}


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    message: str
    count: int = 0
    details: dict = field(default_factory=dict)
    metric_name: str | None = None
    value: float | None = None
    recommendation: str | None = None


def deductions(findings: list[Finding]) -> dict[str, float]:
    """Points lost by code."""
    out: dict[str, float] = {}
    for f in findings:
        out[f.code] = min(30.0, PENALTY[f.severity] + min(f.count, 100) / 10)
    return out


def score(findings: list[Finding]) -> float:
    return max(0.0, 100.0 - sum(deductions(findings).values()))


def _raw(events: DataFrame, mapping: ColumnMapping) -> tuple[DataFrame, dict[str, str]]:
    found = mapping.sources(events.columns)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    conv = truth.lenient(F.col(f"`{found['conversion']}`"), kinds[found["conversion"]])
    columns = [F.col(f"`{found['user_id']}`").alias("user_id"), F.col(f"`{found['timestamp']}`").alias("raw_ts"), F.col(f"`{found['timestamp']}`").try_cast("timestamp").alias("ts"), F.col(f"`{found['channel']}`").cast("string").alias("channel"), F.col(f"`{found['conversion']}`").alias("raw_conversion"), conv.alias("conv")]
    for name in ("conversion_timestamp", "conversion_id", "order_id", "conversion_value"):
        if name in found:
            columns.append(F.col(f"`{found[name]}`").alias(name))
    return events.select(*columns), found


def spread(column: str):
    """A second key that deals rows without a value out; with one it is the same for all of a value."""
    return F.when(F.col(column).isNull(), F.pmod(F.xxhash64("user_id", "raw_ts"), F.lit(1024)))


def quality_counts(events: DataFrame, columns: ColumnMapping | dict | None = None, reference_time: str | datetime | None = None, future_tolerance="0s", minimum_timestamp: str = "1970-01-01") -> DataFrame:
    """One row with every count; a check whose columns are missing counts null."""
    frame, found = _raw(events, ColumnMapping.of(columns))
    reference = F.lit(reference_time or datetime.now(UTC)).cast("timestamp")
    user = Window.partitionBy("user_id")
    conv_ts = F.coalesce(F.col("conversion_timestamp").try_cast("timestamp"), F.col("ts")) if "conversion_timestamp" in found else F.col("ts")
    frame = frame.withColumn("first_exposure", F.min(F.when(~F.col("conv"), F.col("ts"))).over(user)).withColumn("has_exposure", F.max(~F.col("conv")).over(user) & F.col("user_id").isNotNull())
    ids = [c for c in ("conversion_id", "order_id") if c in found]
    for c in ids:
        frame = frame.withColumn(f"times_{c}", F.when(F.col(c).isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(c, spread(c)))))
    repeated = F.lit(False)
    for c in ids:
        repeated = repeated | F.coalesce(F.col(f"times_{c}") > 1, F.lit(False))
    row = lambda when: F.coalesce(when, F.lit(False))
    bad = {
        "null_user_id": F.col("user_id").isNull(), "null_timestamp": F.col("raw_ts").isNull(), "null_channel": F.col("channel").isNull(), "null_conversion": F.col("raw_conversion").isNull(),
        "invalid_timestamp": F.col("raw_ts").isNotNull() & F.col("ts").isNull(),
        "future_timestamps": F.col("ts") > shifted(reference, micros(future_tolerance)),
        "impossible_timestamps": F.col("ts") < F.lit(minimum_timestamp).cast("timestamp"),
        "empty_channel": F.trim("channel") == "",
        "invalid_conversion_timestamp": F.col("conversion_timestamp").isNotNull() & F.col("conversion_timestamp").try_cast("timestamp").isNull() if "conversion_timestamp" in found else None,
        "conversion_before_exposure": F.col("conv") & (F.col("first_exposure").isNull() | (conv_ts < F.col("first_exposure"))),
        "malformed_journeys": F.col("conv") & ~F.col("has_exposure"),
        "repeated_conversion_ids": F.col("conv") & repeated if ids else None,
    }
    none = F.lit(None).cast("long")
    value = F.sum(F.when(F.col("conv"), F.col("conversion_value").try_cast("double"))) if "conversion_value" in found else F.lit(None).cast("double")
    # one row a user first, so that affected users are counted without a distinct aggregate for each check
    users = frame.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("conv").alias("conversions"), value.alias("conversion_value"),
        *(F.count_if(row(c)).alias(k) for k, c in bad.items() if c is not None),
        *(F.count_if(row(c) & row(F.col("conv"))).alias(f"conversions_{k}") for k, c in bad.items() if c is not None),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return users.agg(
        total("rows"), F.count("user_id").alias("users"), total("conversions"),
        *(total(k) if c is not None else none.alias(k) for k, c in bad.items()),
        F.sum("conversion_value").alias("conversion_value"),
        *((F.count_if((F.col(k) > 0) & F.col("user_id").isNotNull()) if c is not None else none).alias(f"users_{k}") for k, c in bad.items()),
        *(total(f"conversions_{k}") if c is not None else none.alias(f"conversions_{k}") for k, c in bad.items()),
    )


#: Severity of each finding.
SEVERITY = {
    "null_user_id": "HIGH", "null_timestamp": "HIGH", "null_channel": "HIGH", "null_conversion": "MEDIUM", "invalid_timestamp": "HIGH", "future_timestamps": "HIGH", "impossible_timestamps": "HIGH",
    "empty_channel": "HIGH", "invalid_conversion_timestamp": "HIGH", "conversion_before_exposure": "HIGH", "malformed_journeys": "MEDIUM", "repeated_conversion_ids": "HIGH", "zero_conversion_value": "CRITICAL",
}


def quality_findings(events: DataFrame, columns: ColumnMapping | dict | None = None, **options) -> list[Finding]:
    """Findings of all checks; a missing column is the only finding then."""
    try:
        got = quality_counts(events, columns, **options).first().asDict()
    except SchemaError as e:
        return [Finding("missing_columns", "CRITICAL", str(e), 1)]
    out = []
    for code in SEVERITY:
        if got.get(code):
            affected = {"affected_rows": got[code], "affected_users": got[f"users_{code}"], "affected_conversions": got[f"conversions_{code}"], "rate": got[code] / got["rows"], "unit": "rows"}
            out.append(Finding(code, SEVERITY[code], f"{got[code]} rows: {code.replace('_', ' ')}", got[code], affected))
    if got["conversion_value"] == 0 and got["conversions"]:
        out.append(Finding("zero_conversion_value", "CRITICAL", "all conversion values are 0", got["conversions"], {"affected_conversions": got["conversions"], "unit": "conversions"}))
    return out
