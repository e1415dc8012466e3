"""The operators of rule trees as Column expressions, typed by the catalogue.

Two dialects differ in nulls and case: "pg" (default) ignores case in strings and lets nulls pass negative operators;
"athena" compares exactly, drops nulls, numbers weekdays from Monday = 1, and counts an empty array as length 0.
Text in contains, starts_with and ends_with is literal. The as-of date is given; nothing reads the clock.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARK_TYPES = {"string": "string", "integer": "long", "float": "double", "date": "date", "boolean": "boolean"}
_NUMBERS = ("integer", "float")


def literal(value: Any, kind: str) -> Column:
    """A value as a literal of the attribute's type; raises ValueError for values that aren't of it."""
    if value is None:
        raise ValueError("a value is needed")
    try:
        if kind == "integer":
            f = float(value)
            return F.lit(int(f)) if f == int(f) else F.lit(f)
        if kind == "float":
            return F.lit(float(value))
        if kind == "boolean":
            if isinstance(value, str) and value.lower() not in ("true", "false"):
                raise ValueError(value)
            return F.lit(value.lower() == "true" if isinstance(value, str) else bool(value))
        if kind == "date":
            import datetime as dt

            return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10]))
    except (TypeError, ValueError) as e:
        raise ValueError(f"{value!r} is not of type {kind}") from e
    return F.lit(str(value))


def _count(value: Any) -> int:
    try:
        return int(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{value!r} is not a number of days, or a count") from e


def predicate(c: Column, kind: str, operator: str, value: Any = None, second: Any = None, *, as_of: Column, dialect: str = "pg") -> Column:
    """The operator over a column of a catalogue type. Operators outside the type's set are a ValueError."""
    from cohortmill.plans.catalog import allowed

    if operator not in allowed(kind):
        raise ValueError(f"{operator!r} does not apply to {kind}")
    pg = dialect == "pg"
    text = kind == "string"
    fold = F.lower if text and pg else lambda x: x
    base = kind.removeprefix("array_") if kind.startswith("array_") else kind

    def lit(v: Any) -> Column:
        return fold(literal(v, base)) if text else literal(v, base)

    def or_null(x: Column) -> Column:
        return x | c.isNull() if pg else x

    values = [lit(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])] if operator in ("in_list", "not_in_list", "contains_any", "contains_all") else []
    if kind.startswith("array_"):
        size = F.size(c) if not pg else F.nullif(F.size(c), F.lit(0))
        return {
            "contains_any": lambda: F.arrays_overlap(c, F.array(*values)),
            "contains_all": lambda: F.size(F.array_except(F.array(*values), c)) == 0,
            "contains": lambda: F.array_contains(c, lit(value)),
            "not_contains": lambda: or_null(~F.array_contains(c, lit(value))),
            "array_length_equals": lambda: size == _count(value),
            "array_length_greater": lambda: size > _count(value),
            "array_length_less": lambda: size < _count(value),
            "is_empty": lambda: c.isNull() | (F.size(c) == 0),
            "is_not_empty": lambda: c.isNotNull() & (F.size(c) > 0),
            "exists": c.isNotNull,
            "not_exists": c.isNull,
        }[operator]()
    x = fold(c)
    day = F.to_date(c) if kind == "date" else c
    weekday = F.dayofweek(day) - 1 if pg else F.weekday(day) + 1

    def same(unit: str) -> Column:
        return F.date_trunc(unit, day) == F.date_trunc(unit, as_of)

    return {
        "equals": lambda: x == lit(value),
        "not_equals": lambda: or_null(x != lit(value)),
        "contains": lambda: x.contains(lit(value)),
        "not_contains": lambda: or_null(~x.contains(lit(value))),
        "starts_with": lambda: x.startswith(lit(value)),
        "ends_with": lambda: x.endswith(lit(value)),
        "in_list": lambda: x.isin(*values) if values else F.lit(False),
        "not_in_list": lambda: or_null(~x.isin(*values)) if values else F.lit(True),
        "regex_match": lambda: c.rlike(str(value)),
        "is_empty": lambda: c.isNull() | (c == "") if text else c.isNull(),
        "is_not_empty": lambda: c.isNotNull() & (c != "") if text else c.isNotNull(),
        "greater_than": lambda: c > lit(value),
        "less_than": lambda: c < lit(value),
        "greater_than_or_equal": lambda: c >= lit(value),
        "less_than_or_equal": lambda: c <= lit(value),
        "between": lambda: c.between(lit(value), lit(second)),
        "not_between": lambda: ~c.between(lit(value), lit(second)),
        "before": lambda: day < lit(value),
        "after": lambda: day > lit(value),
        "in_last_n_days": lambda: day >= F.date_sub(as_of, _count(value)),
        "not_in_last_n_days": lambda: day < F.date_sub(as_of, _count(value)),
        "in_next_n_days": lambda: day.between(as_of, F.date_add(as_of, _count(value))),
        "is_today": lambda: day == as_of,
        "is_this_week": lambda: same("week"),
        "is_this_month": lambda: same("month"),
        "is_this_quarter": lambda: same("quarter"),
        "is_this_year": lambda: F.year(day) == F.year(as_of),
        "is_anniversary": lambda: (F.month(day) == F.month(as_of)) & (F.dayofmonth(day) == F.dayofmonth(as_of)),
        "day_of_week_is": lambda: weekday == _count(value),
        "is_true": lambda: c == F.lit(True),
        "is_false": lambda: c == F.lit(False),
        "exists": c.isNotNull,
        "not_exists": c.isNull,
    }[operator]()
