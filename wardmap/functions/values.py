"""Cleaning of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value" in scraped registries.
NULL_WORDS = ("null", "none", "nan", "")

BLANKS = " \t\r\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


# A null word in any case among blanks; tells without trimming the text. Nearly all texts start otherwise.
_STARTS = sorted({"", *BLANKS, *(letter for w in NULL_WORDS if w for letter in (w[0].lower(), w[0].upper()))})
NO_VALUE = rf"\A[{BLANKS}]*+(?:(?i:{'|'.join(w for w in NULL_WORDS if w)})[{BLANKS}]*+)?\z"


def is_known(c: Column) -> Column:
    """Whether a text is none of the null words; NULL for NULL."""
    text = c.cast("string")
    return ~F.substring(text, 1, 1).isin(*_STARTS) | ~text.rlike(NO_VALUE)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or NULL where the text is one of the null words."""
    return F.when(is_known(c), strip(c.cast("string")))


def to_int(c: Column) -> Column:
    """Integer value of a text; "12.0" is 12 and anything unreadable is NULL."""
    return c.try_cast("double").try_cast("int")


def is_true(c: Column) -> Column:
    """Predicate whose unknown outcome counts as false."""
    return F.coalesce(c, F.lit(False))


def contains_ci(c: Column, term: str) -> Column:
    return F.lower(c).contains(term.lower())


def shown(c: Column) -> Column:
    """Value as display text, N/A where missing."""
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def labelled(label: str, c: Column) -> Column:
    """``label: value``, NULL where the value is missing or empty (for ``concat_ws``)."""
    text = c.cast("string")
    return F.when(text != "", F.concat(F.lit(f"{label}: "), text))


def flag_label(c: Column) -> Column:
    """``flag_x_y`` as the heading ``X Y``."""
    return F.initcap(F.replace(F.replace(c, F.lit("flag_"), F.lit("")), F.lit("_"), F.lit(" ")))


def yes_no(count: Column) -> Column:
    return F.when(count > 0, "Yes").otherwise("No")


def safe_name(column: str) -> str:
    """Column name without blanks and dots."""
    return column.replace(" ", "_").replace(".", "")


def hash_slot(key: Column, slots: Column | int) -> Column:
    """Slot of a key in ``[0, slots)`` from its MD5, the same in any engine."""
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, slots if isinstance(slots, Column) else F.lit(slots).cast("bigint"))
