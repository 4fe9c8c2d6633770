import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestat.functions import (
    blank_to_null,
    generalize_pattern,
    normalize_text,
    parse_date,
    parse_number,
    trailing_unit,
)


def apply(spark, expression, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    found = df.select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


def test_numbers(spark):
    values = ["12.0 km", "77.5%", "2,2", "n/a", "12d", "1e3", " -4 ", "", None]
    got = apply(spark, lambda c: parse_number(c, ["km", "%"]), values)
    assert got == [12.0, 77.5, 2.2, None, None, 1000.0, -4.0, None, None]


def test_dates(spark):
    formats = ["%Y-%m-%d", "%d/%m/%Y", "%d %b %Y", "%d/%m/%y"]
    values = ["04 Sep 2024", "04/09/2024", "pas une date", "31/02/2024", "01/01/70", "01/01/68"]
    got = apply(spark, lambda c: F.date_format(parse_date(c, formats), "yyyy-MM-dd"), values)
    assert got == ["2024-09-04", "2024-09-04", None, None, "1970-01-01", "2068-01-01"]


TEXTS = [
    " Général ", "Lettres  Modernes", "ŒUVRE ﬁn ½ … ™", "Straße", " x \ty", "İstanbul",
    "ETU-03041", "   ", "", None, "Ǆungla", "ｆｕｌｌ", "a\n\nb",
]


def expected_key(text):
    if text is None or not text.strip():
        return None
    folded = unicodedata.normalize("NFKD", text.strip().lower())
    kept = "".join(c for c in folded if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"\s+", " ", kept)


def test_keys(spark):
    assert apply(spark, normalize_text, TEXTS) == [expected_key(t) for t in TEXTS]


def test_blanks(spark):
    assert apply(spark, blank_to_null, [" a ", " \t ", ""]) == [" a ", None, None]


def expected_shape(text):
    def kind(c):
        return r"\d" if c.isdigit() else r"\w" if c.isalpha() else re.escape(c)

    runs = [(k, len(list(g))) for k, g in itertools.groupby(text, kind)]
    whole = "".join(k if n == 1 else f"{k}{{{n}}}" for k, n in runs)
    return whole if len(whole) <= 48 else whole[:48] + "…"


def test_patterns(spark):
    texts = ["2024-09-27", "ETU-03041", "04 Sep 2024", "a.b*c (d)", "éà12", "x" * 3000 + "1", "a1" * 200, ""]
    assert apply(spark, generalize_pattern, texts) == [expected_shape(t) for t in texts]


@pytest.mark.parametrize("value, unit", [("12.0 km", "km"), ("77%", "%"), ("2,2", None), ("n/a", "n/a")])
def test_units(spark, value, unit):
    assert apply(spark, trailing_unit, [value]) == [unit]
