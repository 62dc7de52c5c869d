"""Column functions on findings, verdicts and review states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["business_logic", "security", "cross_file", "maintainability"]
SEMANTIC_CATEGORIES = ["business_logic", "security", "cross_file"]
FEEDBACK_VERDICTS = ["helpful", "not_helpful", "false_positive"]
SURFACE_AT = 0.55
CORROBORATION_BONUS = 0.1
SEMANTIC_BELOW = 0.9
REJECTED_AT_MOST = 0.2


def clamp(x: Column) -> Column:
    """x within [0, 1]; NaN counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def _known(value: Column, allowed: list[str], default: str) -> Column:
    cleaned = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.when(cleaned.isin(allowed), cleaned).otherwise(F.lit(default))


def normalize_findings(df):
    """Severity and category made known ones, lines put in order from 1, confidence clamped."""
    start = F.greatest(F.lit(1), F.col("start_line"))
    return df.withColumns(
        {
            "severity": _known(F.col("severity"), SEVERITIES, "medium"),
            "category": _known(F.col("category"), CATEGORIES, "maintainability"),
            "start_line": start,
            "end_line": F.greatest(start, F.col("end_line")),
            "confidence": clamp(F.col("confidence")),
        }
    )


def severity_rank(severity: Column) -> Column:
    """critical 0 ... info 4; anything else 99."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(rank > 0, rank - 1).otherwise(F.lit(99)).cast("int")


def should_surface(verdict: Column, confidence: Column, threshold: float = SURFACE_AT) -> Column:
    return (verdict != "rejected") & (confidence >= threshold)


def up_to_date(last: Column, head: Column) -> Column:
    return F.coalesce((last != "") & (last == head), F.lit(False))
