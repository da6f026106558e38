import random
import re

import pytest
from pyspark.sql import DataFrame

SMALL = "/root/testdata/sf0.001"
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Names that operators use for columns of their own.
CLASHING = ("__rows __copies __quality __row __id __text __right_id __right_hash __row_id __row_hash __mix_rows __mix_copy "
            "__source __size __rank __label company number whole").split()


def documents(spark, rows) -> DataFrame:
    """(doc_id, text, source) rows as documents with further columns whose names clash with those of operators."""
    wide = [(i, t, "en", s, 0 if t is None else len(t), 1, "x", True, 2, "y", *range(len(CLASHING))) for i, t, s in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, n_chars long, size int, class string, "
              "kept boolean, row int, item string, " + ", ".join(f"{c} int" for c in CLASHING))


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, short, repeated, equal and very long texts; null ids and sources."""
    long = " ".join(words(200_000, 1, 50_000))
    base = words(300, 2)
    near = base.copy()
    near[150] = "changed"
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\r\n\x0b\x0c ", "b"), (4, "one", "b"), (5, "One", "b"), (6, "two words", None),
        (7, "three more words", "c"), (8, long, "c"), (9, " ".join(base), "a"), (9, " ".join(base), "a"),
        (10, " ".join(near), "a"), (11, " ".join(base).upper(), "d"), (None, " ".join(base), "a"), (None, None, None),
        (12, "a b a b a b\n\na b a b a b\n \nx", "e"), (13, "é ñ 日本 \x85 #|<>&$%*", "é"), (14, "\x00nul\x00 here", "Z"),
        (-3, " ".join(near[:200] + base[200:]), "a"), (15, "\n".join(["same line here"] * 40), "z"),
    ]
