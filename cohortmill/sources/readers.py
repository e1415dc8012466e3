"""Sources. All text columns are strings with given names: nothing is inferred."""

from __future__ import annotations

import io
import os
import re
import sys
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.functions.cleaning import select_or_null


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def dated_glob(root: str, pattern: str = "*") -> str:
    """All-digit subfolders of a drop folder."""
    return f"{root.rstrip('/')}/[0-9]*/{pattern}"


def _renamed(df: DataFrame, renames: Mapping[str, str], columns: Sequence[str] | None) -> DataFrame:
    plain = df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))
    plain = plain.withColumnsRenamed({k.lower(): v for k, v in renames.items()})
    return plain.select(*select_or_null(plain, list(columns))) if columns else plain


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, sep: str = ",", renames: Mapping[str, str] | None = None, encoding: str = "UTF-8", source_file: bool = False) -> DataFrame:
    """Headers trimmed and lower-cased, then renamed; missing columns are null, others go (all stay without `columns`)."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").option("inferSchema", False)
    df = reader.csv(path)
    out = df.select("*", F.col("_metadata.file_name").alias("_source_file")) if source_file else df
    return _renamed(out, renames or {}, [*columns, "_source_file"] if columns and source_file else columns)


def read_positional(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|", header: bool = True) -> DataFrame:
    """Files whose headers repeat or mean nothing: columns by place; the header row, if any, goes."""
    rows = spark.read.schema(strings(columns)).option("sep", sep).option("header", header).option("enforceSchema", True).csv(path)
    return rows


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV files in zip archives, one level of folders or none, each archive read by the task that gets it, so an archive
    must fit a task's memory. One that can't be read gives no rows and a line in the executor's log; columns as in
    read_csv, with _source_file."""
    want = [c.lower() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    print(f"skipped {name}: {e}", file=sys.stderr)
                    continue
                for member in sorted(archive.namelist()):
                    if not member.lower().endswith(".csv"):
                        continue
                    with archive.open(member) as raw:
                        rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""), delimiter=sep)
                        at = {h.strip().lower(): i for i, h in enumerate(next(rows, []))}
                        place = [at.get(c) for c in want]
                        held: list[list] = []
                        for r in rows:
                            held.append([r[i] if i is not None and i < len(r) else None for i in place] + [os.path.basename(member)])
                            if len(held) == 5000:
                                yield _batch(held)
                                held = []
                        if held:
                            yield _batch(held)

    schema = strings([*columns, "_source_file"])
    names = schema.fieldNames()

    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(run, schema)


def read_parquet_as_text(spark: SparkSession, path: str, renames: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """All columns as strings; what is dropped isn't read."""
    from cohortmill.operators.staging import sentinel_nulls

    df = spark.read.parquet(path)
    skip = {c.lower() for c in drop}
    kept = df.select(*[c for c in df.columns if c.lower() not in skip]).withColumnsRenamed(dict(renames or {}))
    return sentinel_nulls(kept)


def fuzzy_renames(columns: Sequence[str], rules: Mapping[str, str]) -> dict[str, str]:
    """New names of columns whose header holds a text (first rule that fits)."""
    out = {}
    for c in columns:
        for part, name in rules.items():
            if part.lower() in c.lower() and name not in out.values():
                out[c] = name
                break
    return out


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sheet: int | str = 0, places: Mapping[int, str] | None = None, first_row: int = 1) -> DataFrame:
    """A workbook of bounded size, through pandas at the edge (there is no native reader); all columns as strings.
    places: names by column number, for sheets without usable headers, whose data begin at first_row (from 0)."""
    import pandas as pd

    if places is not None:
        raw = pd.read_excel(path, sheet_name=sheet, dtype=str, header=None)
        pdf = raw.iloc[first_row:, [i for i in places if i < raw.shape[1]]]
        pdf.columns = [places[i] for i in pdf.columns]
    else:
        pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
        pdf.columns = [str(c).strip().lower() for c in pdf.columns]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), strings(list(pdf.columns)))
    return df.select(*select_or_null(df, list(columns))) if columns else df


def with_year(df: DataFrame, columns: Sequence[str], of: str, name: str = "year") -> DataFrame:
    """The columns as dates (null where they aren't), and the year of one of them."""
    out = df.withColumns({c: F.coalesce(F.expr(f"try_to_date(`{c}`)"), F.substring(c, 1, 10).try_cast("date")) for c in columns})
    return out.withColumn(name, F.year(of))


def expand_env(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} by the environment."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] if m[2] is not None else ""), text)


def scan_cost(df: DataFrame, usd_per_tb: float = 5.0) -> float:
    """Price of the bytes that the optimised plan expects to read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return round(size / 1e12 * usd_per_tb, 6)


def table_metadata(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields]


def fetch(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """The first rows as dicts; the cap is the feature."""
    return [r.asDict() for r in df.limit(limit).collect()]
