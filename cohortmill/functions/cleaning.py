"""Column expressions of the staging layer: blanks, guarded casts, mobile numbers, calendar flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "no mobile number". Fixed values.
NO_MOBILE = ("", "-", "X", "0")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def typed(c: Column, kind: str, strict: bool = False) -> Column:
    """Trimmed text as a value of a type, blanks as null. strict raises on anything else that doesn't convert."""
    c = blank_to_null(c)
    return c.cast(kind) if strict else c.try_cast(kind)


def unless(c: Column, *sentinels: str) -> Column:
    """c, or null where it is one of the sentinels."""
    return F.when(~c.isin(*sentinels), c)


def guarded(c: Column, pattern: str, kind: str) -> Column:
    """A cast only of text that matches the pattern; what still doesn't convert is null."""
    return F.when(c.rlike(pattern), c.try_cast(kind))


def compact_date(c: Column) -> Column:
    """Dates written as eight digits, yyyymmdd; null for everything else."""
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def mobile_pos(c: Column, strict_parity: bool = False) -> Column:
    """Mobile numbers of tills: country code and marks off, ten digits or null. The country code goes only from longer
    numbers; strict_parity takes a leading 91 from ten-digit numbers too, which loses those."""
    t = F.trim(c)
    short = digits(F.regexp_replace(t, r"^\+?91", ""))
    number = short if strict_parity else F.when(F.length(digits(t)) > 10, short).otherwise(digits(t))
    return F.when(t.isNull() | t.isin(*NO_MOBILE), None).when(F.length(number) == 10, number)


def mobile_crm(c: Column, keep_prefixed: bool = False) -> Column:
    """Mobile numbers of service records: null unless there are ten digits; keep_prefixed lets +91 and ten digits pass."""
    own = digits(c)
    stripped = digits(F.regexp_replace(c, r"^\+91", ""))
    fits = (F.length(own) == 10) | (F.lit(keep_prefixed) & (F.length(stripped) == 10))
    return F.when(fits, stripped)


def mobile_or_raw(c: Column) -> Column:
    """Ten digits if there are ten, else the text as it is."""
    return F.when(F.length(digits(c)) == 10, digits(c)).otherwise(c)


def phone(c: Column) -> Column:
    """Digits alone, without a country code of 91 before ten or more."""
    d = digits(c)
    return F.when((F.length(d) > 10) & d.startswith("91"), F.substr(d, F.lit(3))).otherwise(d)


def email_hash(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(c)), 256)


def bill_id(plant: Column, bill_no: Column, bill_date: Column) -> Column:
    """Null if any part is."""
    return F.concat(F.trim(plant), F.lit("-"), F.trim(bill_no), F.lit("-"), F.trim(bill_date))


def seconds_of_day(c: Column) -> Column:
    """HH:MM:SS as seconds; null if it isn't one."""
    part = [F.split(c, ":")[i].try_cast("int") for i in range(3)]
    return F.when(c.rlike(r"^\d{2}:\d{2}:\d{2}$"), part[0] * 3600 + part[1] * 60 + part[2])


def calendar_flags(d: Column) -> dict[str, Column]:
    """Flags of a bill's date; the name of the day without padding."""
    day = F.dayofmonth(d)
    return {
        "weekend_flag": F.dayofweek(d).isin(1, 7),
        "wednesday_flag": F.dayofweek(d) == 4,
        "first_week_flag": day <= 7,
        "last_week_flag": day >= F.dayofmonth(F.last_day(d)) - 6,
        "first_half_flag": day <= 15,
        "day_of_week": F.date_format(d, "EEEE"),
    }


def delivery_channel(till_no: Column) -> Column:
    return F.when(F.trim(till_no).isin("9998", "9999"), "Online").otherwise("Store")


def nps_category(score: Column) -> Column:
    return F.when(score >= 9, "Promoter").when(score >= 7, "Passive").otherwise("Detractor")


def select_or_null(df, columns: list[str]) -> list[Column]:
    """The named columns, null strings for those that the frame lacks."""
    have = {c.lower(): c for c in df.columns}
    return [F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns]


def day(value: dt.date | str) -> Column:
    """A date literal: the as-of date is always given, never today's."""
    return F.lit(str(value)).cast("date")
