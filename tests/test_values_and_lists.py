import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardmap.functions import lists, values


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return row.select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, expected", [
    ('["x ","y",""]', ["x", "y"]),
    (None, []), ("null", []), ("[]", []), ('[""]', []), ("", []), (" NaN ", []),
    ('"scalar"', ["scalar"]), ("42", ["42"]), ("true", ["true"]),
    ("[1,2]", ["1", "2"]),
    ('[null,"a"]', ["a"]),
    ("notjson", ["notjson"]),
    ('["a"] | ["b"]', ['["a"] | ["b"]']),
    ("['x','y']", ["['x','y']"]),
    ('["a",]', ['["a",]']),
    ('["say \\"hi\\" ]", "b"]', ['say "hi" ]', "b"]),
    ('["a","a "]', ["a"]),
    ('[{"k": 1}]', ['{"k":1}']),
    ('[{"k": {"m": [1, {"n": "]"}]}}, "b"]', ['{"k":{"m":[1,{"n":"]"}]}}', "b"]),
    ('[[1, [2, {"a": "}"}]], "c"]', ['[1,[2,{"a":"}"}]]', "c"]),
    ('[\n "a" ,\n "b"\n]', ["a", "b"]),
])
def test_json_items(spark, raw, expected):
    assert one(spark, lists.json_items(F.col("c")), c=raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ('["a","b"]', 2), ('["a","a"]', 2), ("[]", 0), (None, 0), ("null", 0), ('{"a":1}', 0), ("text", 0), ('["a"] x', 0),
])
def test_item_count(spark, raw, expected):
    assert one(spark, lists.item_count(F.col("c")), c=raw) == expected


@pytest.mark.parametrize("raw, items", [
    ('[[[[["x"]]]], {"a": [{"b": [1, [2]]}]}]', 2), ('["a", ' + "[" * 40 + "]" * 40 + "]", 2), ('[[[[[1]]]]] x', None),
    ('[[[[[1]]]]]]', None), ('[[[[[1]]]]]}', None), ('[[[[[1]]]]], 2', None), ('[[[[[1]]]]], "b": 2', None),
    ("[[[[['a']]]]]", None), ('[[[[["a"]]]]', None), ('[{"a": {"b": {"c": {"d": {"e": 1}}}}}, "z"]', 2)])
def test_lists_of_any_depth(spark, raw, items):
    found = one(spark, lists.json_items(F.col("c")), c=raw)
    assert len(found) == (items or 1) and (items is not None or found == [raw])
    assert one(spark, lists.item_count(F.col("c")), c=raw) == (items or 0)


def test_long_list_does_not_overflow_the_pattern(spark):
    raw = json.dumps([f"item {i} \\ \" {'x' * 20}" for i in range(20_000)])
    assert len(one(spark, lists.json_items(F.col("c")), c=raw)) == 20_000


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="ascii", categories=("L", "N", "P", "Zs")), max_size=12), max_size=5))
def test_any_json_string_list_parses_like_python(spark, strings):
    expected = []
    for s in strings:
        cleaned = s.strip(" \t\r\n").strip('"').strip(" \t\r\n")
        if cleaned and cleaned not in expected:
            expected.append(cleaned)
    assert one(spark, lists.json_items(F.col("c")), c=json.dumps(strings)) == expected


@pytest.mark.parametrize("raw, expected", [
    ("null", None), ("abc", None), ("12.0", 12), ("7", 7), (None, None), ("1e2", 100), ("99999999999", None),
])
def test_to_int(spark, raw, expected):
    assert one(spark, values.to_int(F.col("c")), c=raw) == expected


@pytest.mark.parametrize("raw, expected", [(" None ", None), ("NULL", None), ("", None), (" x ", "x"), ("nano", "nano")])
def test_blank_to_null(spark, raw, expected):
    assert one(spark, values.blank_to_null(F.col("c")), c=raw) == expected


def test_flag_label_and_json(spark):
    assert one(spark, values.flag_label(F.col("c")), c="flag_many_specialties") == "Many Specialties"
    assert one(spark, lists.to_json_list(lists.json_items(F.col("c"))), c='["b", "a"]') == '["a","b"]'
    assert values.safe_name("mongo DB.x") == "mongo_DBx"


@pytest.mark.parametrize("raw, expected", [
    ('[ " a  b " , "", "c" ]\n', ["a  b", "c"]), ('["\u00a0x "]', ["\u00a0x"]), ("['a', \"b\"]", ["['a', \"b\"]"]),
    ('\x0b["a"]', ['\x0b["a"]']), ('["a]","b["," a","a"]', ["a]", "b[", "a"]), ('["a\\n"," b"]', ["a", "b"]),
])
def test_plain_arrays_need_no_parser_and_give_the_same(spark, raw, expected):
    assert one(spark, lists.json_items(F.col("c")), c=raw) == expected
    known = [i for i in one(spark, lists.trimmed_items(F.col("c")), c=raw) if i]
    assert list(dict.fromkeys(known)) == expected


@pytest.mark.parametrize("raw, expected", [
    (None, None), ("", False), (" \r\n\t", False), ("NuLL", False), (" none\t", False), ("nan", False), ("nano", True),
    ("null x", True), ("nullnone", True), ("x", True), ("null\x0b", True), (" \u00a0", True),
])
def test_known_values(spark, raw, expected):
    assert one(spark, values.is_known(F.col("c")), c=raw) is expected
    assert (one(spark, values.blank_to_null(F.col("c")), c=raw) is not None) is bool(expected)
