"""Data tests: each returns the rows (or groups) that fail; no rows mean that the test passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import day
from cohortmill.functions.windows import neighbour


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_records")).where(~F.col(column).isin(*values))


def not_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.select(column).distinct().where(F.col(column).isin(*values))


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    """Nulls pass."""
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad |= c < low if inclusive else c <= low
    if high is not None:
        bad |= c > high if inclusive else c >= high
    return df.where(bad)


def at_least_one(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups without any value."""
    return df.groupBy(*group_by).agg(F.count(column).alias("filler")).where("filler = 0")


def not_constant(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_by).agg(F.count_distinct(column).alias("filler")).where("filler = 1")


def not_empty_string(df: DataFrame, column: str, trim: bool = True) -> DataFrame:
    return df.where((F.trim(column) if trim else F.col(column)) == "")


def not_null_proportion(df: DataFrame, column: str, at_least: float = 0.0, at_most: float = 1.0, group_by: Sequence[str] = ()) -> DataFrame:
    share = F.avg(F.when(F.col(column).isNull(), 0.0).otherwise(1.0)).alias("not_null_proportion")
    return df.groupBy(*group_by).agg(share).where((F.col("not_null_proportion") < at_least) | (F.col("not_null_proportion") > at_most))


def expression_is_true(df: DataFrame, expression: str, column: str | None = None) -> DataFrame:
    """Unknown passes."""
    return df.where(~F.expr(f"{column} {expression}" if column else expression))


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n_records")).where("n_records > 1").select(*columns)


def cardinality_equality(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Values whose counts differ, from either side."""
    a = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("num_rows"))
    b = other.groupBy(F.col(other_column).alias("value")).agg(F.count("*").alias("num_rows"))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def _counts(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """count_a, count_b by key; the counts meet in one aggregation instead of a full join."""
    both = df.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(other.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    g = both.groupBy(*keys) if keys else both.groupBy()
    return g.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("count_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("count_b"))


def equal_rowcount(df: DataFrame, other: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    return _counts(df, other, group_by).withColumn("diff_count", F.abs(F.col("count_a") - F.col("count_b"))).where("diff_count > 0")


def fewer_rows_than(df: DataFrame, other: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    return _counts(df, other, group_by).withColumn("row_count_delta", F.greatest(F.col("count_a") - F.col("count_b") + 1, F.lit(0))).where("row_count_delta > 0")


def equality(df: DataFrame, other: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), precision: int | None = None) -> DataFrame:
    """Distinct rows of one side only, with the side (a_minus_b or b_minus_a)."""
    skip = {c.lower() for c in exclude}
    names = list(columns) if columns else [c for c in df.columns if c.lower() not in skip]
    kinds = dict(df.dtypes)
    rounded = lambda c: F.round(c, precision).alias(c) if precision is not None and kinds.get(c, "").startswith(("double", "float", "decimal")) else F.col(c)
    a, b = df.select(*map(rounded, names)), other.select(*map(rounded, names))
    return a.subtract(b).withColumn("which_diff", F.lit("a_minus_b")).unionByName(b.subtract(a).withColumn("which_diff", F.lit("b_minus_a")))


def mutually_exclusive_ranges(df: DataFrame, lower: str, upper: str, partition_by: str | None = None, gaps: str = "allowed", zero_length: bool = False) -> DataFrame:
    """gaps: not_allowed, allowed or required. Rows whose range isn't in order, or meets the next one wrongly."""
    compare = {"not_allowed": lambda a, b: a == b, "allowed": lambda a, b: a <= b, "required": lambda a, b: a < b}
    if gaps not in compare:
        raise ValueError("gaps is not_allowed, allowed or required")
    if partition_by:
        w = Window.partitionBy(partition_by).orderBy(F.asc_nulls_last(lower), F.asc_nulls_last(upper))
        back = Window.partitionBy(partition_by).orderBy(F.desc_nulls_first(lower), F.desc_nulls_first(upper))
        rows = df.withColumn("next_lower", F.lead(lower).over(w)).withColumn("_last", F.row_number().over(back) == 1)
    else:
        rows = neighbour(df, [F.asc_nulls_last(lower), F.asc_nulls_last(upper)], lower, "next_lower", last="_last")
    ordered = F.coalesce(F.col(lower) <= F.col(upper) if zero_length else F.col(lower) < F.col(upper), F.lit(False))
    meets = F.coalesce(compare[gaps](F.col(upper), F.col("next_lower")), F.col("_last"), F.lit(False))
    return rows.where(~(ordered & meets)).drop("_last")


def recency(df: DataFrame, field: str, as_of: str, part: str = "day", interval: int = 1, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups whose last value is older than the interval."""
    bound = F.col("as_of") - F.expr(f"INTERVAL {int(interval)} {part}")
    g = df.groupBy(*group_by).agg(F.max(field).alias("most_recent")).withColumn("as_of", day(as_of).cast("timestamp"))
    return g.where(F.col("most_recent").isNull() | (F.col("most_recent").cast("timestamp") < bound)).drop("as_of")


def relationships_where(df: DataFrame, column: str, to: DataFrame, field: str, from_condition: str = "true", to_condition: str = "true") -> DataFrame:
    """Values without a partner; nulls pass."""
    child = df.where(from_condition).where(F.col(column).isNotNull())
    return child.join(to.where(to_condition).select(F.col(field).alias(column)).distinct(), column, "left_anti")


def sequential_values(df: DataFrame, column: str, interval: int = 1, part: str | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Rows that don't follow the one before by the interval (of the date part, if given)."""
    if group_by:
        rows = df.withColumn("previous", F.lag(column).over(Window.partitionBy(*group_by).orderBy(column)))
    else:
        rows = neighbour(df, [F.asc(column)], column, "previous", back=True)
    step = F.col("previous") + F.expr(f"INTERVAL {int(interval)} {part}") if part else F.col("previous") + interval
    return rows.where(F.col("previous").isNotNull() & ~(F.col(column) == step))


def assert_equal(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """Unknown passes."""
    return df.where(F.col(actual) != F.col(expected))


def column_set_difference(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Columns that only one of the two has."""
    return sorted({c.lower() for c in df.columns} ^ {c.lower() for c in expected})


def passes(failing: DataFrame) -> bool:
    return failing.limit(1).count() == 0


def report(tests: dict[str, DataFrame]) -> dict[str, int]:
    """Failing rows by test."""
    return {name: rows.count() for name, rows in tests.items()}

