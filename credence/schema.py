"""The canonical event schema: mapping, validation and coercion."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import truth

REQUIRED = ("user_id", "timestamp", "channel", "conversion")


class SchemaError(ValueError):
    """Events that cannot be read as the canonical schema."""


@dataclass(frozen=True)
class ColumnMapping:
    """Canonical field -> the caller's column. ``campaign`` is another name of ``campaign_id``."""

    user_id: str = "user_id"
    timestamp: str = "timestamp"
    channel: str = "channel"
    conversion: str = "conversion"
    conversion_value: str | None = None
    conversion_timestamp: str | None = None
    campaign_id: str | None = None
    campaign: str | None = None
    impression: str | None = None
    click: str | None = None
    cost: str | None = None
    revenue: str | None = None
    device: str | None = None
    publisher: str | None = None
    creative_id: str | None = None
    conversion_id: str | None = None
    order_id: str | None = None

    def __post_init__(self):
        if self.campaign and self.campaign_id and self.campaign != self.campaign_id:
            raise SchemaError("campaign and campaign_id name different columns")
        given = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "campaign" and getattr(self, f.name) is not None}
        blank = [k for k, v in given.items() if not str(v).strip()]
        if blank:
            raise SchemaError(f"blank column names: {blank}")
        if len(set(given.values())) != len(given):
            raise SchemaError("two fields are mapped to one column")

    @classmethod
    def of(cls, value: ColumnMapping | dict | None) -> ColumnMapping:
        if isinstance(value, cls):
            return value
        unknown = set(value or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise SchemaError(f"unknown fields: {sorted(unknown)}")
        return cls(**(value or {}))

    def sources(self, columns: list[str]) -> dict[str, str]:
        """Canonical name -> column that is there; some optional fields are found by their own name."""
        out = {}
        for f in fields(self):
            name = "campaign_id" if f.name == "campaign" else f.name
            given = getattr(self, f.name)
            if given is not None:
                out[name] = given
            elif f.name in columns and name not in out:
                out[name] = f.name
        missing = [v for v in out.values() if v not in columns]
        if missing:
            raise SchemaError(f"missing columns: {missing}")
        return out


@dataclass(frozen=True)
class ValidationSummary:
    rows: int
    users: int
    conversions: int


def canonical(events: DataFrame, columns: ColumnMapping | dict | None = None) -> DataFrame:
    """Canonical columns (values that cannot be read are null), ``row_id``, and all other columns as they are.

    ``row_id`` decides between equal timestamps; without one, rows keep the order in which they are read.
    """
    mapping = ColumnMapping.of(columns)
    found = mapping.sources(events.columns)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    out = []
    for name, source in found.items():
        c = F.col(f"`{source}`")
        if name in ("timestamp", "conversion_timestamp"):
            c = c.try_cast("timestamp")
        elif name == "channel":
            c = F.trim(c.cast("string"))
        elif name == "conversion":
            c = truth.strict(c, kinds[source])
        elif name == "conversion_value":
            c = c.try_cast("double")
        elif name in ("campaign_id",):
            c = c.cast("string")
        out.append(c.alias(name))
    if "row_id" not in events.columns:
        out.append(F.monotonically_increasing_id().alias("row_id"))
    taken = set(found.values()) | set(found)
    return events.select(*out, *(F.col(f"`{c}`") for c in events.columns if c not in taken))


def validate_events(events: DataFrame, columns: ColumnMapping | dict | None = None) -> tuple[DataFrame, ValidationSummary]:
    """The canonical frame, or an error that says what is wrong; one aggregate over the input."""
    frame = canonical(events, columns)
    blank = {k: F.count_if(F.col(k).isNull()) for k in ("user_id", "timestamp", "conversion")}
    blank["channel"] = F.count_if(F.col("channel").isNull() | (F.col("channel") == ""))
    if "conversion_value" in frame.columns:
        blank["conversion_value"] = F.count_if(F.col("conversion") & F.col("conversion_value").isNull())
    got = frame.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.count_if("conversion").alias("conversions"), *(c.alias(f"bad_{k}") for k, c in blank.items())).first()
    bad = {k: got[f"bad_{k}"] for k in blank if got[f"bad_{k}"]}
    if bad:
        raise SchemaError("null, blank or unreadable values: " + ", ".join(f"{k} ({n} rows)" for k, n in bad.items()))
    return frame, ValidationSummary(got["rows"], got["users"], got["conversions"])
