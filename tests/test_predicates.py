"""Truth tables of the operators, null included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortmill.functions.cleaning import day
from cohortmill.operators.predicates import predicate
from cohortmill.plans import catalog, rules

AS_OF = "2024-05-15"  # a Wednesday


def run(spark, kind, values, op, value=None, second=None, dialect="pg"):
    types = {"string": "string", "integer": "int", "float": "double", "date": "date", "boolean": "boolean", "array_string": "array<string>"}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {types[kind]}")
    return [r[0] for r in df.orderBy("i").select(predicate(F.col("x"), kind, op, value, second, as_of=day(AS_OF), dialect=dialect)).collect()]


@pytest.mark.parametrize("op,value,expected", [
    ("equals", "AB", [True, True, False, None, False]), ("not_equals", "ab", [False, False, True, True, True]), ("contains", "B", [True, True, False, None, False]), ("not_contains", "b", [False, False, True, True, True]),
    ("starts_with", "A", [True, True, False, None, False]), ("ends_with", "%", [False, False, True, None, False]), ("in_list", ["ab", "zz"], [True, True, False, None, False]), ("not_in_list", ["ab"], [False, False, True, True, True]),
    ("regex_match", "^[a-z]+$", [True, False, False, None, False]), ("is_empty", None, [False, False, False, True, True]), ("is_not_empty", None, [True, True, True, False, False]), ("exists", None, [True, True, True, False, True]),
])
def test_strings(spark, op, value, expected):
    assert run(spark, "string", ["ab", "aB", "c_%", None, ""], op, value) == expected


def test_strings_exact_dialect(spark):
    assert run(spark, "string", ["ab", "aB", None], "equals", "ab", dialect="athena") == [True, False, None]
    assert run(spark, "string", ["ab", "x", None], "not_equals", "ab", dialect="athena") == [False, True, None]


@pytest.mark.parametrize("op,value,second,expected", [
    ("equals", "5", None, [True, False, None]), ("greater_than", 4.5, None, [True, True, None]), ("less_than_or_equal", 5, None, [True, False, None]), ("between", 5, 7, [True, True, None]), ("not_between", 6, 8, [True, False, None]),
    ("in_list", [5, "9"], None, [True, False, None]), ("is_empty", None, None, [False, False, True]), ("not_exists", None, None, [False, False, True]),
])
def test_numbers(spark, op, value, second, expected):
    assert run(spark, "integer", [5, 7, None], op, value, second) == expected


@pytest.mark.parametrize("op,value,expected", [
    ("before", "2024-05-15", [False, True, False, False, None]), ("in_last_n_days", 7, [True, False, True, True, None]), ("not_in_last_n_days", 7, [False, True, False, False, None]), ("in_next_n_days", 7, [True, False, True, False, None]),
    ("is_today", None, [True, False, False, False, None]), ("is_this_week", None, [True, False, True, False, None]), ("is_this_month", None, [True, False, True, True, None]), ("is_this_quarter", None, [True, False, True, True, None]),
    ("is_this_year", None, [True, False, True, True, None]), ("is_anniversary", None, [True, True, False, False, None]), ("day_of_week_is", 0, [False, False, True, False, None]),
])
def test_dates(spark, op, value, expected):
    d = [dt.date(2024, 5, 15), dt.date(2020, 5, 15), dt.date(2024, 5, 19), dt.date(2024, 5, 29), None]
    assert run(spark, "date", d, op, value) == expected


def test_weekdays_by_dialect(spark):
    assert run(spark, "date", [dt.date(2024, 5, 19)], "day_of_week_is", 7, dialect="athena") == [True]


@pytest.mark.parametrize("op,value,expected", [
    ("contains_any", ["a", "z"], [True, False, False, None]), ("contains_all", ["a", "b"], [True, False, False, None]), ("contains", "a", [True, False, False, None]), ("array_length_equals", 2, [True, False, None, None]),
    ("array_length_less", 2, [False, True, None, None]), ("is_empty", None, [False, False, True, True]),
])
def test_arrays(spark, op, value, expected):
    assert run(spark, "array_string", [["a", "b"], ["c"], [], None], op, value) == expected


def test_array_length_counts_empty_in_the_other_dialect(spark):
    assert run(spark, "array_string", [[]], "array_length_less", 2, dialect="athena") == [True]


def test_booleans(spark):
    assert run(spark, "boolean", [True, False, None], "is_false") == [False, True, None]


def test_wrong_operators_and_values_are_refused(spark):
    for kind, op, value in [("integer", "contains", "x"), ("string", "greater_than", 1), ("integer", "equals", "abc"), ("date", "before", "soon"), ("date", "in_last_n_days", "x")]:
        with pytest.raises(ValueError):
            predicate(F.col("x"), kind, op, value, as_of=day(AS_OF))


def test_parsing():
    tree = {"conditions": [{"attribute_key": "txn.total_bills", "operator": "equals", "value": 1}, {"type": "group", "logical_operator": "or", "logical_operator_prefix": "or", "conditions": []}]}
    d = rules.parse_definition(tree)
    assert isinstance(d.root.conditions[0], rules.Attribute) and d.root.conditions[1].logical_operator == "or"
    with pytest.raises(ValueError):
        rules.parse_node({"type": "thing"})
    with pytest.raises(ValueError):
        rules.parse_node({"attribute_key": "a.b", "operator": "equals", "time_window": {"type": "last_n_days", "days": 3}})


def test_catalogue():
    assert len(catalog.CATALOG) == 108 and len(catalog.TEMPLATES) == 15
    with pytest.raises(ValueError):
        catalog.attribute("no.such")
    assert "lifecycle.is_churned" in catalog.suggest("churn")
