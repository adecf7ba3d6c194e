import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import text as X


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("  What  is\tit? ", "what is it?"), ("a . ", "a "), ("End...", "end"), ("“Q”–‘x’", "\"q\"-'x'"), ("ﬁx", "fix"), ("…", "")],
)
def test_exact_text(spark, text, expected):
    assert one(spark, X.exact_text(F.col("t")), t=text) == expected
    assert unicodedata.normalize("NFKC", expected) == expected


def test_exact_key_has_options(spark):
    assert one(spark, X.exact_key(F.lit("mcq"), F.col("t"), F.col("o")), t="Stem.", o=["A ", "b."]) == "mcq||stem||a|b"


def test_exact_key_composes_options(spark):
    key = lambda *o: one(spark, X.exact_key(F.lit("mcq"), F.col("t"), F.col("o")), t="Stem", o=list(o))
    assert key("ﬁx", "e\u0301") == key("fix", "é") == "mcq||stem||fix|é"
    assert key() == "mcq||stem||" and key("a|b") == key("a", "b")


@pytest.mark.parametrize(("text", "page"), [("4", 4), ("[4]", 4), ("( 12 )", 12), ("[ 4 ]", 4), (" 7 ", 7), ("[ iv ]", None), ("Chapter 1 : CELLS", None), ("12345", None)])
def test_printed_page(spark, text, page):
    assert one(spark, X.printed_page(F.col("t")), t=text) == page


@pytest.mark.parametrize(
    ("name", "years", "dates"),
    [("BIOCHEM_3rd_Sessionals_2024.pdf", ["2024"], []), ("exam_04-07-2025_final.pdf", ["2025"], ["04-07-2025"]), ("plain.pdf", [], [])],
)
def test_filename_metadata(spark, name, years, dates):
    found = one(spark, X.filename_metadata(F.col("t")), t=name)
    assert (found["years"], found["dates"]) == (years, dates)


@pytest.mark.parametrize(("text", "page"), [("[12]", 12), ("(3)", 3), (" 7 ", 7), ("iv", None), ("12345", None), ("12 of 40", None)])
def test_printed_page(spark, text, page):
    assert one(spark, X.printed_page(F.col("t")), t=text) == page


@pytest.mark.parametrize(("a", "b", "conflict"), [("May 2024", "2024", False), ("2023", "2024", True), ("x", "2024", False), ("", "2024", False), (None, "2024", False)])
def test_field_conflict(spark, a, b, conflict):
    assert one(spark, X.field_conflict(F.col("a"), F.col("b")), a=a, b=b) is conflict


@pytest.mark.parametrize(("text", "spaced"), [("B i o m o l ec u l es", True), ("Lipids and their use", False), ("a b c", False), ("", False)])
def test_letter_spaced(spark, text, spaced):
    assert one(spark, X.letter_spaced(F.col("t")), t=text) is spaced


@pytest.mark.parametrize(("text", "number", "rest"), [("12a) Define it", "12a", "Define it"), ("1.No space", None, "1.No space"), ("Define", None, "Define")])
def test_leading_number(spark, text, number, rest):
    a, b = X.leading_number(F.col("t"))
    assert (one(spark, a, t=text), one(spark, b, t=text)) == (number, rest)


def test_small_rules(spark):
    assert one(spark, X.redacted(F.col("t")), t="sk-12345678") == "...5678"
    assert one(spark, X.redacted(F.col("t")), t="abc") == "***"
    assert one(spark, X.without_json_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.looks_truncated(F.col("t")), t='{"a": ') is True
    assert one(spark, X.is_quota_message(F.col("t")), t="Rate limit exceeded: free-models-per-day") is True
    assert one(spark, X.topic_slug(F.col("t")), t=" ÄÖ ") == "topic"
    assert one(spark, X.best_of(F.col("a"), F.col("b")), a="", b="f") == "f"


def test_year_order(spark):
    years = ["2022", "2017-18", "abc", "2024-25"]
    frame = spark.createDataFrame([(y,) for y in years], "paper_year string")
    assert [r[0] for r in frame.orderBy(X.year_key(F.col("paper_year"))).collect()] == ["2017-18", "2022", "2024-25", "abc"]
