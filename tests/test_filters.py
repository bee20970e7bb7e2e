import json

from tessel.functions.filters import Filter
from tessel.plans.catalogue import TRAPS


def test_only_strings_of_a_literal_top_level_array_match(spark):
    rows = spark.createDataFrame(list(enumerate(TRAPS)), "i int, metadata string")
    for field, value in (("tags", "1"), ("tags", "true"), ("tags", "rust"), ("a.b", "rust"), ("a", "rust"), ("nope", "x")):
        condition = Filter(field, value)
        got = [r[0] for r in rows.where(condition.column()).orderBy("i").collect()]
        assert got == [i for i, t in enumerate(TRAPS) if t and t != "not json" and condition.matches(json.loads(t))]


def test_odd_names_and_values(spark):
    rows = spark.createDataFrame([(json.dumps({'a"b': ["x'y"], "c[0]": ["é😀"]}),)], "metadata string")
    assert rows.where(Filter('a"b', "x'y").column()).count() == 1
    assert rows.where(Filter("c[0]", "é😀").column()).count() == 1
    assert rows.where(Filter("c", "é😀").column()).count() == 0


def test_round_trip():
    assert Filter.from_json(Filter("a", "b").to_json()) == Filter("a", "b")
