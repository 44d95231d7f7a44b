"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_day() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("day")


def r6(column: Column | str) -> Column:
    """Rounded to six places, as all doubles in query results are."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude, 0.0001 at least; 1 if one is null, null if both are."""
    floor = F.lit(0.0001)
    return F.when(a.isNull() & b.isNull(), F.lit(None)).when(a.isNull() | b.isNull(), F.lit(1.0)).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), floor))


def returns(price: str) -> Column:
    """Simple return on the row before, null where that is 0 or missing."""
    return ratio(F.col(price), F.lag(price).over(by_day())) - 1


def codes(*pairs: tuple[Column, str]) -> Column:
    """The labels whose condition holds, in the given order, joined by commas; an empty string for none."""
    return F.concat_ws(",", *(F.when(condition, F.lit(label)) for condition, label in pairs))


def codes_sql(*pairs: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {condition} THEN '{label}' END" for condition, label in pairs) + ")"


def severity(value: Column, *steps: tuple[float, int]) -> Column:
    """The points of the highest threshold reached; 0 for none and for null."""
    out = F.lit(0)
    for threshold, points in steps:
        out = F.when(value >= threshold, points).otherwise(out)
    return out


def severity_sql(value: str, *steps: tuple[float, int]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {t} THEN {p}" for t, p in reversed(steps)) + " ELSE 0 END"


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share; null for no cases."""
    p, m = ratio(wins.cast("double"), n), F.nullif(n, F.lit(0))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return centre - half, centre + half
