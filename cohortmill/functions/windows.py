"""Ranks, tiles and neighbours over whole tables without one task that sorts them all, and the first row of a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.functions.storage import written

#: Bins into which a pass divides a range of values, and rows of a range that are fetched instead of divided.
BINS, SETTLE = 1024, 200
#: Where nulls stand among values: before all of them, as Spark orders them ascending.
_NULL = -(2**62)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str = "rn") -> DataFrame:
    """The first n rows of each group, numbered from 1. The order should end in a unique key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def sorted_ranges(df: DataFrame, order: list[Column], columns: Mapping[str, Column] = MappingProxyType({})) -> DataFrame:
    """df in sorted ranges, written once, with _part (the range), _at (the place in it, from 0) and the given columns over it.
    All that read it see the same ranges, whatever is recomputed. Equal rows are told apart by where they were read, so that no
    range is bound to hold all of them."""
    order = [*order, F.col("_read")]
    rows = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*order)
    return written(rows.withColumn("_at", F.row_number().over(within) - 1).withColumns({c: x.over(within) for c, x in columns.items()}).drop("_read"))


def global_rank(df: DataFrame, order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """df with each row's number (from 1) in the order, which should be unique; total adds the number of rows.

    Rows are range-partitioned, sorted and numbered within their range; what stands before a range is added. One number for
    each range, as many as the shuffle has partitions, goes through the driver."""
    rows = sorted_ranges(df, order)
    sizes = {r["_part"]: r.n for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, seen = [], 0
    for part in sorted(sizes):
        before.append((part, seen))
        seen += sizes[part]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    out = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1)
    if total:
        out = out.withColumn(total, F.lit(seen).cast("long"))
    return out.drop("_part", "_at", "_before")


def neighbour(df: DataFrame, order: list[Column], value: str, name: str, back: bool = False, last: str | None = None) -> DataFrame:
    """df with the value of the next row in the order (back: of the row before), null where there is none; last names a flag
    of the row without a next one.

    Within a range it is a window; the row at a range's border takes it from the next range that has rows. One row for
    each range goes through the driver."""
    step = F.lag if back else F.lead
    rows = sorted_ranges(df, order, {"_near": step(value), "_inner": step(F.lit(True))})
    border = (F.max_by if back else F.min_by)(value, "_at")
    borders = {r["_part"]: r.v for r in rows.groupBy("_part").agg(border.alias("v")).collect()}
    parts = sorted(borders, reverse=back)
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_beyond", df.schema[value].dataType), T.StructField("_more", T.BooleanType())])
    beyond_part = [(p, borders[q], True) for p, q in zip(parts, parts[1:])] + [(p, None, False) for p in parts[-1:]]
    out = rows.join(F.broadcast(df.sparkSession.createDataFrame(beyond_part, schema)), "_part")
    out = out.withColumn(name, F.when(F.col("_inner"), F.col("_near")).otherwise(F.col("_beyond")))
    if last:
        out = out.withColumn(last, F.col("_inner").isNull() & ~F.col("_more"))
    return out.drop("_part", "_at", "_near", "_inner", "_beyond", "_more")


def tile(rank: Column, total: Column, k: int) -> Column:
    """The bucket (1 to k) of a row with this rank among total rows, as NTILE deals them."""
    q, r = F.floor(total / k), total % k
    wide = r * (q + 1)
    return F.when(rank <= wide, F.ceil(rank / (q + 1))).otherwise(r + F.ceil((rank - wide) / F.greatest(q, F.lit(1)))).cast("int")


# -- tiles by exact bounds -------------------------------------------------------------------------------------------


def tile_ends(total: int, k: int) -> list[int]:
    """The last ranks of tiles 1 to k - 1 of NTILE(k), without those that no row comes after."""
    q, r = divmod(total, k)
    ends = [j * q + min(j, r) for j in range(1, k)]
    return [e for e in ends if 0 < e < total]


@dataclass
class _Range:
    """Rows of one metric from value lo to hi whose key begins with prefix; before: rows in front; ranks: wanted in it; rows: its size."""

    metric: int
    lo: int
    hi: int
    before: int
    ranks: list[int]
    rows: int
    prefix: str = ""

    def holds(self) -> str:
        v = f"v{self.metric}"
        inside = f"{v} BETWEEN {self.lo} AND {self.hi}"
        return inside + (f" AND startswith(h, '{self.prefix}')" if self.prefix else "")


def whole_number(value: Column, kind: T.DataType, descending: bool) -> Column:
    """A number in 64 bits in the order of the values, nulls where Spark puts them."""
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise ValueError("decimals of more than 18 digits have no bounds in 64 bits")
        value = (value * F.lit(10**kind.scale)).cast("decimal(18,0)").cast("long")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value).cast("long")
    elif isinstance(kind, T.IntegralType):
        value = value.cast("long")
    else:
        raise ValueError(f"no bounds for {kind.simpleString()}")
    value = F.coalesce(value, F.lit(_NULL).cast("long"))
    return -value if descending else value


def ordered_hex(key: Column, kind: T.DataType) -> Column:
    """Hexadecimal text in the order of the keys; '' for null."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit(""))
    return F.coalesce(F.hex(key.cast("string").cast("binary")), F.lit(""))


def exact_bounds(narrow: DataFrame, wanted: Sequence[Callable[[int], list[int]]]) -> list[dict[int, tuple[int, str | None]]]:
    """Of each metric the (value, key) at the wanted ranks (from 1), which a function of the number of rows gives. narrow: h
    (unique keys, as ordered hex), v0, v1, ... (whole numbers). A key of None stands for all keys of the value.

    All metrics are counted in one pass: the ranges in which wanted ranks lie are divided into BINS bins by value, and
    the bins' counts locate the ranks again, until a bin is one value; ranks among rows of one value are located by the next
    bytes of the key. Ranges of at most SETTLE rows are fetched. A pass is one aggregation; the driver gets its counts:
    metrics x ranks x BINS at most."""
    metrics = range(len(wanted))
    asked = [F.count("*").alias("n")]
    for m in metrics:
        v = F.col(f"v{m}")
        inner = F.when(F.abs(v) < -_NULL, v)
        asked += [F.min(inner).alias(f"lo{m}"), F.max(inner).alias(f"hi{m}"), F.count(F.when(v == _NULL, 1)).alias(f"front{m}"), F.count(F.when(v == -_NULL, 1)).alias(f"back{m}")]
    first = narrow.agg(*asked).first()
    found: list[dict[int, tuple[int, str | None]]] = [{} for _ in metrics]
    opened: list[_Range] = []
    small: list[_Range] = []

    def settle(r: _Range, only: str | None = None) -> None:
        own = r.before + r.rows
        if only is not None:
            found[r.metric] |= {k: (r.lo, only) for k in r.ranks}
            return
        if r.lo == r.hi and not r.prefix and own in r.ranks:
            found[r.metric][own] = (r.lo, None)  # the last row of a value needs no key
        ranks = [k for k in r.ranks if k not in found[r.metric]]
        if ranks:
            (small if r.rows <= SETTLE else opened).append(_Range(r.metric, r.lo, r.hi, r.before, ranks, r.rows, r.prefix))

    for m in metrics:
        seen = 0
        front, back = first[f"front{m}"], first[f"back{m}"]
        for lo, hi, rows in ((_NULL, _NULL, front), (first[f"lo{m}"], first[f"hi{m}"], first.n - front - back), (-_NULL, -_NULL, back)):
            ranks = sorted({k for k in wanted[m](first.n) if seen < k <= seen + rows})
            if ranks:
                settle(_Range(m, lo, hi, seen, ranks, rows))
            seen += rows
    while opened:
        held, opened[:] = list(opened), []
        rows = _of_ranges(narrow, held, lambda r: f"CAST((v{r.metric} - {r.lo}) DIV {_width(r)} AS STRING)" if r.lo < r.hi else f"substr(h, {len(r.prefix) + 1}, 4)")
        counted = rows.groupBy("i", "b").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).collect()
        for i, r in enumerate(held):
            by_value = r.lo < r.hi
            seen = r.before
            for x in sorted((x for x in counted if x.i == i), key=lambda x: int(x.b) if by_value else x.b):
                ranks = [k for k in r.ranks if seen < k <= seen + x.n]
                if ranks and by_value:
                    low = r.lo + int(x.b) * _width(r)
                    settle(_Range(r.metric, low, min(r.hi, low + _width(r) - 1), seen, ranks, x.n))
                elif ranks:
                    # What all keys of the bin have in common is known at once; equal keys can't be told apart.
                    settle(_Range(r.metric, r.lo, r.hi, seen, ranks, x.n, _common(x.low, x.high)), x.low if x.low == x.high else None)
                seen += x.n
    if small:
        got: dict[int, list[tuple[int, str]]] = {}
        for x in _of_ranges(narrow, small, lambda r: f"CAST(v{r.metric} AS STRING)").collect():
            got.setdefault(x.i, []).append((int(x.b), x.h))
        for i, r in enumerate(small):
            own = sorted(got[i])
            found[r.metric] |= {k: own[k - r.before - 1] for k in r.ranks}
    return found


def _of_ranges(narrow: DataFrame, ranges: list[_Range], label: Callable[[_Range], str]) -> DataFrame:
    """h, i, b: the rows of each range with its number and a label."""
    cases: dict[int, str] = {}
    for i, r in enumerate(ranges):
        cases[r.metric] = cases.get(r.metric, "") + f" WHEN {r.holds()} THEN named_struct('i', {i}, 'b', {label(r)})"
    asked = F.filter(F.array(*(F.expr(f"CASE{c} END") for c in cases.values())), lambda x: x.isNotNull())
    return narrow.select("h", F.explode(asked).alias("x")).select("h", "x.i", "x.b")


def _width(r: _Range) -> int:
    return (r.hi - r.lo) // BINS + 1


def _common(a: str, b: str) -> str:
    """The bytes (two digits each) that both begin with."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + 2] == b[n : n + 2]:
        n += 2
    return a[:n]


def upto(value: Column, hexed: Column, bound: tuple[int, str | None]) -> Column:
    """The row stands at the bound or before it."""
    v, h = bound
    return (value < F.lit(v)) | (value == F.lit(v)) & (F.lit(True) if h is None else hexed <= F.lit(h))


def beyond(value: Column, hexed: Column, bounds: list[tuple[int, str | None]]) -> Column:
    """1 + the number of bounds that a row stands behind."""
    out = None
    for i, bound in enumerate(bounds):
        here = upto(value, hexed, bound)
        out = F.when(here, i + 1) if out is None else out.when(here, i + 1)
    return (F.lit(1) if out is None else out.otherwise(len(bounds) + 1)).cast("int")


def ntiles(df: DataFrame, key: str, tiles: Mapping[str, tuple[int, Column, bool]]) -> DataFrame:
    """df with several NTILEs, each (k, value, descending), ties by the key, which must be unique and not null.

    The key and the values alone are written once; exact bounds of all tiles come from counts over them, and each row of df
    is compared with the bounds. No row is sorted or moved, and df itself stays lazy: who asks for other columns computes only these.
    Values are whole numbers, decimals of up to 18 digits, or dates."""
    names = list(tiles)
    values = df.select(*(v.alias(n) for n, (_, v, _) in tiles.items()))
    hexed = ordered_hex(F.col(key), df.schema[key].dataType)
    whole = [whole_number(tiles[n][1], values.schema[n].dataType, tiles[n][2]) for n in names]
    narrow = written(df.select(hexed.alias("h"), *(w.alias(f"v{i}") for i, w in enumerate(whole))))
    bounds = exact_bounds(narrow, [lambda n, k=tiles[x][0]: tile_ends(n, k) for x in names])
    return df.withColumns({n: beyond(w, hexed, [b[k] for k in sorted(b)]) for n, w, b in zip(names, whole, bounds)})


def ntile(df: DataFrame, k: int, value: Column, name: str, key: str, descending: bool = False) -> DataFrame:
    return ntiles(df, key, {name: (k, value, descending)})
