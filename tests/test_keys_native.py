"""Keys of texts without Python: compatibility composition inside the JVM."""

import unicodedata

from pyspark.sql import functions as F

from tallyfold.functions import text as X
from tallyfold.operators import dedup
from tallyfold.plans import catalogue

TEXTS = ["ﬁ Å ½ ① ｆｕｌｌ é", "é", "한글", "plain", "", None, "x" * 50_000 + "ﬀ", "𝒜𝟙 ﷺ"]


def test_composition_is_that_of_unicodedata(spark):
    marks = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    rows = spark.createDataFrame([(t,) for t in TEXTS + marks], "t string").select("t", X.composed(F.col("t")).alias("n")).collect()
    assert len(rows) == len(TEXTS) + len(marks)
    assert [r for r in rows if r["n"] != (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"]))] == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_pass_no_text_to_python(spark):
    keyed = catalogue.keyed_questions(spark, "/root/testdata/sf0.001")
    options = keyed.select(X.exact_key(F.lit("x"), F.col("question_id"), F.array("question_id")).alias("k"))
    assert all("Python" not in plan(df) for df in (keyed, options, dedup.exact_groups(keyed), dedup.exact_duplicate_links(keyed)))
