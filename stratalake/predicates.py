"""The predicate compiler that all selections by value share."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .roles import col


def bound(value: float | None, missing: float) -> float:
    """A bound of 0 or None is open. (0 counts as open in the results to match; change it here alone.)"""
    return value or missing


def between(c: Column, low: float | None, high: float | None, inclusive: str = "both") -> Column:
    """Range condition; open bounds make no comparison but for excluding nulls."""
    if inclusive not in ("both", "neither", "left", "right"):
        raise ValueError(f"inclusive can't be {inclusive!r}")
    out = c.isNotNull()
    if bound(low, 0):
        out = out & ((c >= low) if inclusive in ("both", "left") else (c > low))
    if bound(high, 0):
        out = out & ((c <= high) if inclusive in ("both", "right") else (c < high))
    return out


def value_mask(df: DataFrame, column: str, values: Any, inclusive: str = "both") -> Column:
    """Condition on rows: equal to a scalar, one of several values, or in the range of a slice."""
    if column not in df.columns:
        raise IndexError(f"the table has no column {column!r}")
    c = col(column)
    if isinstance(values, slice):
        if not isinstance(df.schema[column].dataType, NumericType):
            raise TypeError(f"a range needs a numeric column; {column!r} isn't")
        return between(c, values.start, values.stop, inclusive)
    if isinstance(values, (str, int, float, bool)):
        return c == values
    if isinstance(values, Iterable) and not isinstance(values, (dict, bytes)):
        return c.isin(*[v.item() if hasattr(v, "item") else v for v in values])
    raise TypeError(f"can't select by {type(values).__name__}")


def negate(condition: Column) -> Column:
    """Rows that a condition doesn't select; null counts as not selected."""
    return ~F.coalesce(condition, F.lit(False))


def column_name_from(values: Any, prefix: str = "", suffix: str = "") -> str:
    """``L,Z``, ``0.7:13`` or the value itself, with prefix and suffix."""
    if isinstance(values, slice):
        text = ":".join("" if v is None else str(v) for v in (values.start, values.stop))
    elif isinstance(values, (set, frozenset)):
        text = ",".join(map(str, sorted(values)))
    elif isinstance(values, (list, tuple)) or hasattr(values, "tolist"):
        text = ",".join(map(str, values))
    else:
        text = str(values)
    return f"{prefix}{text}{suffix}"
