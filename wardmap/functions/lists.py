"""List-valued text fields: JSON array text in, array of clean items out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_known, strip

# JSON grammar, possessive throughout so that long texts cannot backtrack.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_NUMBER = r"-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
# The expression knows objects and arrays that hold each other, up to this many levels below an item;
# texts that are nested deeper go through the JSON parser (``is_json_array``).
_DEPTH = 2
_OBJECT = r'\{(?:[^{}"]++|' + _STRING + r")*+\}"
_INNER = r'\[(?:[^\[\]"]++|' + _STRING + r")*+\]"
for _ in range(_DEPTH):
    _NESTED = r'(?:[^{}\[\]"]++|' + _STRING + "|" + _OBJECT + "|" + _INNER + ")*+"
    _OBJECT, _INNER = r"\{" + _NESTED + r"\}", r"\[" + _NESTED + r"\]"
_ITEM = f"(?:{_STRING}|{_NUMBER}|true|false|null|{_OBJECT}|{_INNER})"
JSON_ARRAY = rf"^\s*+\[\s*+(?:{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+)?+\]\s*+$"
JSON_STRING = rf"^\s*+{_STRING}\s*+$"
# An array of nothing but strings without escapes, which needs no parser, and its strings without their outer blanks.
_PLAIN = r'"[^"\\\x00-\x1f]*+"'
_GAP = r"[ \t\r\n]*+"
PLAIN_ARRAY = rf"\A{_GAP}\[{_GAP}(?:{_PLAIN}{_GAP}(?:,{_GAP}{_PLAIN}{_GAP})*+)?+\]{_GAP}\z"
PLAIN_ITEM = r'" *+((?:[^" ]++| ++(?!"))*+) *+"'


def is_json_array(c: Column) -> Column:
    """Whether a text is one strict JSON array, at any depth.

    The parser takes the first value of a text and overlooks what follows. A text that is a value within an array as
    well as within an object has nothing else in it.
    """
    inside = lambda a, z: F.try_parse_json(F.concat(F.lit(a), c, F.lit(z))).isNotNull()
    return c.rlike(JSON_ARRAY) | (F.startswith(strip(c), F.lit("[")) & inside("[", "]") & inside('{"v":', "}"))


def _clean_item(item: Column) -> Column:
    return strip(F.btrim(strip(item), F.lit('"')))


def trimmed_items(c: Column) -> Column:
    """Trimmed items of a list field as they stand, empty and repeated ones too; NULL where there is no list.

    A JSON array gives its elements (objects keep their JSON text), a JSON string gives one
    item, and any other text is one item itself. ``from_json`` alone would accept trailing
    text and single quotes, hence the full-text check first.
    """
    parsed = F.from_json(
        F.when(is_json_array(c), c).when(c.rlike(JSON_STRING), F.concat(F.lit("["), c, F.lit("]"))),
        "array<string>",
    )
    return F.when(c.rlike(PLAIN_ARRAY), F.regexp_extract_all(c, F.lit(PLAIN_ITEM), 1)).when(
        is_known(c), F.transform(F.coalesce(parsed, F.array(strip(c))), _clean_item))


def json_items(c: Column) -> Column:
    """Distinct, trimmed, non-empty items of a list field; nulls go (``trimmed_items``)."""
    items = F.coalesce(trimmed_items(c), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def item_count(c: Column) -> Column:
    """Number of elements of a JSON array text; 0 for anything else."""
    return F.coalesce(F.size(F.from_json(F.when(is_json_array(c), c), "array<string>")), F.lit(0))


def to_json_list(items: Column) -> Column:
    """Sorted JSON array text."""
    return F.to_json(F.array_sort(items))


def tokens(c: Column) -> Column:
    """Lower-case words of letters, with their marks, and digits of any script."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def query_words(c: Column) -> Column:
    """Distinct lower-case words of a question, split on white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))
