"""General helpers over relations and columns: series, keys, pivots, unions, safe arithmetic, URLs, distances."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null counts as in a surrogate key. Fixed value.
NULL_KEY = "_dbt_utils_surrogate_key_null_"
#: Radius of the earth in miles, and kilometres in a mile. Fixed values.
EARTH_MILES, KM_IN_MILE = 3961, 1.60934


def generate_series(spark: SparkSession, upper: int) -> DataFrame:
    """1 to upper."""
    if upper < 1:
        raise ValueError("upper must be 1 or more")
    return spark.range(1, upper + 1).select(F.col("id").alias("generated_number"))


def powers_of_two(upper: int) -> int:
    """How many bits count to upper."""
    if upper < 1:
        raise ValueError("upper must be 1 or more")
    return max(1, (upper - 1).bit_length())


def intervals_between(start: Column, end: Column, part: str) -> Column:
    """Bounds of the part (day, hour ...) that lie between two times."""
    if part.lower() == "day":
        return F.datediff(end, start)
    return F.timestamp_diff(part.upper(), F.date_trunc(part, start), F.date_trunc(part, end)).cast("int")


def date_spine(spark: SparkSession, part: str, start: str, end: str) -> DataFrame:
    """One row for each step of the part from start, before end."""
    name = f"date_{part}"
    step = F.expr(f"INTERVAL 1 {part}")
    to = F.lit(end).cast("timestamp")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), to, step)).alias(name)).where(F.col(name) < to)
    return rows.select(F.col(name).cast("date").alias(name)) if part in ("day", "week", "month", "quarter", "year") else rows


def deduplicate(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    from cohortmill.functions.windows import first_rows

    return first_rows(df, list(partition_by), list(order_by), 1, "_rn").drop("_rn")


def surrogate_key(columns: Sequence[str | Column], null_as: str = NULL_KEY) -> Column:
    """md5 of the values as text, joined by dashes."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(null_as)) for c in columns]
    return F.md5(F.concat_ws("-", *parts))


def surrogate_key_removed(*_: object) -> None:
    """The old name of surrogate_key, whose nulls and blanks were one key: it raises, so that no caller keeps it unaware."""
    raise ValueError("use surrogate_key(columns); for keys that don't tell nulls from blanks, null_as=''")


def column_values(df: DataFrame, column: str, where: str | None = None, max_records: int | None = None, default: list | None = None) -> list:
    """Distinct values, the most frequent first; ties by value. The list goes to the driver: give max_records for wide columns."""
    if column not in df.columns:
        return list(default or [])
    rows = (df.where(where) if where else df).groupBy(column).count().orderBy(F.desc("count"), F.asc_nulls_last(column))
    return [r[0] for r in (rows.limit(max_records) if max_records else rows).collect()]


def filtered_columns(df: DataFrame, except_: Iterable[str] = ()) -> list[str]:
    drop = {c.lower() for c in except_}
    return [c for c in df.columns if c.lower() not in drop]


def star(df: DataFrame, except_: Iterable[str] = (), prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"`{c}`").alias(f"{prefix}{c}{suffix}") for c in filtered_columns(df, except_)]


def results_as_dict(df: DataFrame) -> dict[str, tuple]:
    rows = df.collect()
    return {c: tuple(r[c] for r in rows) for c in df.columns}


def single_value(df: DataFrame, default=None):
    row = df.limit(1).collect()
    return row[0][0] if row else default


def relations_by_pattern(spark: SparkSession, pattern: str, exclude: str = "", database: str | None = None) -> list[str]:
    """Names of tables and views whose name is like the pattern (% and _), in any case, and not like exclude."""

    def like(p: str) -> re.Pattern:
        return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p), re.IGNORECASE)

    names = [t.name for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    return sorted(n for n in names if like(pattern).fullmatch(n) and not (exclude and like(exclude).fullmatch(n)))


def relations_by_prefix(spark: SparkSession, prefix: str, exclude: str = "", database: str | None = None) -> list[str]:
    return relations_by_pattern(spark, f"{prefix}%", exclude, database)


def group_by_first(df: DataFrame, n: int):
    """Grouped by the first n columns."""
    return df.groupBy(*df.columns[:n])


def haversine_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "mi") -> Column:
    if unit not in ("mi", "km"):
        raise ValueError("unit is 'mi' or 'km'")
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(chord)) * (1 if unit == "mi" else KM_IN_MILE)


def nullcheck(df: DataFrame) -> DataFrame:
    """Empty strings as null."""
    return df.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def pivot(column: str, values: Sequence, agg: str = "sum", cmp: str = "=", alias: bool = True, prefix: str = "", suffix: str = "", then: Column | int = 1, otherwise: Column | int | None = 0, distinct: bool = False) -> list[Column]:
    """One aggregate for each value: of `then` where the column compares with it, else of `otherwise`."""
    test = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}[cmp]
    made = []
    for v in values:
        case = F.when(test(F.col(column), F.lit(v)), then).otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)
        c = {"sum": F.sum_distinct if distinct else F.sum, "count": F.count_distinct if distinct else F.count, "max": F.max, "min": F.min, "avg": F.avg}[agg](case)
        made.append(c.alias(f"{prefix}{v}{suffix}") if alias else c)
    return made


def unpivot(df: DataFrame, keep: Sequence[str] = (), remove: Sequence[str] = (), cast_to: str = "string", field_name: str = "field_name", value_name: str = "value") -> DataFrame:
    """One row for each row and column that is neither kept nor removed; null values keep their rows."""
    skip = {c.lower() for c in (*keep, *remove)}
    columns = [c for c in df.columns if c.lower() not in skip]
    values = df.select(*keep, *(F.col(c).cast(cast_to).alias(c) for c in columns))
    return values.unpivot(list(keep), columns, field_name, value_name)


def union_relations(relations: Mapping[str, DataFrame], include: Sequence[str] = (), exclude: Sequence[str] = (), overrides: Mapping[str, str] | None = None, source_column: str | None = "_source_relation") -> DataFrame:
    """All rows, over all columns, nulls where a relation lacks one; each row names its relation."""
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    chosen = {c.lower() for c in include}
    dropped = {c.lower() for c in exclude}
    frames = []
    for name, df in relations.items():
        columns = [c for c in df.columns if c.lower() not in dropped and (not chosen or c.lower() in chosen)]
        out = df.select(*(F.col(c).cast((overrides or {})[c]).alias(c) if c in (overrides or {}) else F.col(c) for c in columns))
        frames.append(out.withColumn(source_column, F.lit(name)) if source_column else out)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def safe_add(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def safe_subtract(*columns: Column) -> Column:
    return reduce(lambda a, b: a - b, [F.coalesce(c, F.lit(0)) for c in columns])


def safe_divide(a: Column, b: Column) -> Column:
    """Null for a divisor of 0."""
    return F.try_divide(a, b)


def width_bucket(c: Column, low: float, high: float, buckets: int) -> Column:
    """The bucket of a value among equal bins, its lower edge counted to the bin above if it falls on a multiple of the
    bin's width; buckets + 1 beyond the range."""
    width = (high - low) / buckets
    edge = F.when(F.try_mod(c.cast("decimal(28,6)"), F.lit(width).cast("decimal(28,6)")) == 0, 1).otherwise(0)
    return (edge + F.least(F.ceil((c - low) / width), F.lit(buckets + 1))).cast("long")


def _without_scheme(url: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), ("android-app://", "http://", "https://"), url)


def url_host(url: Column) -> Column:
    return F.split_part(F.split_part(_without_scheme(url), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def url_path(url: Column) -> Column:
    """What follows the first slash, without parameters; empty without one."""
    rest = F.replace(F.replace(url, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    at = F.coalesce(F.nullif(F.locate("/", rest), F.lit(0)), F.locate("?", rest) - 1)
    return F.split_part(F.when(at <= 0, F.lit("")).otherwise(F.substr(rest, at + 1)), F.lit("?"), F.lit(1))


def url_parameter(url: Column, name: str) -> Column:
    """Null if the URL hasn't got it."""
    return F.nullif(F.split_part(F.split_part(url, F.lit(f"{name}="), F.lit(2)), F.lit("&"), F.lit(1)), F.lit(""))


def slugify(text: str) -> str:
    out = re.sub(r"[ -]+", "_", text.lower())
    out = re.sub(r"[^a-z0-9_]+", "", out)
    return f"_{out}" if out[:1].isdigit() else out


def slug(text: Column) -> Column:
    """slugify of a column."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[ -]+", "_"), "[^a-z0-9_]+", "")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)


def pretty_time(at: datetime | None = None, pattern: str = "%H:%M:%S") -> str:
    """A time (now, if none is given) as text."""
    return (at or datetime.now()).strftime(pattern)


def pretty_log(message: str, at: datetime | None = None) -> str:
    """A line of a log: the time and the message."""
    return f"{pretty_time(at)} + {message}"


def log_info(message: str) -> None:
    logging.getLogger("cohortmill").info(pretty_log(message))


def row_hash(df: DataFrame) -> Column:
    """md5 over all columns, by name."""
    return F.md5(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
