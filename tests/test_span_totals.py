"""Counts over spans without their pairs, span issues with one sort, membership of all rows."""

import random

from pyspark.sql import functions as F

from tallyfold.operators import blocks as B
from tallyfold.operators import dedup
from tallyfold.operators.intervals import span_totals


def test_totals_are_those_of_the_pairs_and_hot_places_go_through_the_join_once(spark):
    rng = random.Random(4)
    rows = [("f", [3, 40], 5)] * 3_000 + [(rng.choice("fg"), [rng.randrange(90), rng.choice([None, rng.randrange(90)])], rng.randrange(9)) for _ in range(200)] + [(None, [1], 1), ("f", None, 1), ("f", [], 1)]
    spans = [(i, rng.choice("fg"), low := rng.randrange(90), low + rng.randrange(-2, 40)) for i in range(80)] + [(90, "f", 0, 50)] * 2 + [(91, None, 0, 9), (92, "f", None, 9)]
    got = span_totals(spark.createDataFrame(rows, "file string, points array<int>, v long"), F.col("points"), spark.createDataFrame(spans, "span int, of string, low int, high int").withColumnRenamed("of", "file"), "file", "low", "high", F.col("v"))
    want = []
    for i, file, low, high in spans:
        inside = [v for f, p, v in rows if file and low is not None and f == file and any(x is not None and low <= x <= high for x in p or [])]
        if inside:
            want.append((i, len(inside), sum(inside)))
    assert sorted((r["span"], r["n"], r["total"]) for r in got.collect()) == sorted(want)


def test_span_issues_sort_once(spark):
    # The third span ends before it begins once the second is clipped away; the last lies behind the file's end.
    rows = [("f", 3, 5, 24), ("f", 4, 9, 24), ("f", 5, 8, 24), ("f", 30, 31, 24), ("g", 1, 24, 24)]
    given = spark.createDataFrame(rows, "file_id string, start_page int, end_page int, total_pages int")
    issues = B.span_issues(given)
    assert issues._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted(tuple(r) for r in issues.collect()) == [("f", "gap_filled", 10), ("f", "gap_unassigned", 1), ("f", "overlap_clipped", 4), ("f", "overlap_clipped", 5)]


def test_every_row_has_its_class(spark):
    keyed = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "m"), ("d", None), ("e", None)], "question_id string, exact_key string")
    assert {tuple(r) for r in dedup.exact_membership(keyed).collect()} == {("a", "a", 2, 1), ("b", "a", 2, 1), ("c", "c", 1, 0), ("d", "d", 1, 0), ("e", "e", 1, 0)}
