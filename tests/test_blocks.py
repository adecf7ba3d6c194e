import random

import pytest

from tallyfold.operators import blocks as B

SCHEMA = "file_id string, pos long, page_numbers array<int>, block_type string, text string, marker string"


def blocks(spark, rows):
    return spark.createDataFrame([("f", i, [p], k, t, m) for i, (p, k, t, m) in enumerate(rows)], SCHEMA)


def spans(spark, pairs, total=10):
    return spark.createDataFrame([("f", a, b, total) for a, b in pairs], "file_id string, start_page int, end_page int, total_pages int")


@pytest.mark.parametrize(
    ("given", "expected", "codes"),
    [
        ([(6, 10), (1, 5)], [(1, 5), (6, 10)], []),
        ([(1, 6), (5, 10)], [(1, 6), (7, 10)], ["overlap_clipped"]),
        ([(1, 10), (3, 5)], [(1, 10)], ["overlap_clipped"]),
        ([(1, 3), (6, 10)], [(1, 5), (6, 10)], ["gap_filled"]),
        ([(3, 10)], [(3, 10)], ["gap_unassigned"]),
        ([], [], []),
    ],
)
def test_spans(spark, given, expected, codes):
    got = sorted((r["start"], r["end"]) for r in B.resolve_spans(spans(spark, given)).collect())
    assert got == expected
    assert sorted(r["code"] for r in B.span_issues(spans(spark, given)).collect()) == codes


def test_spans_agree_with_a_loop(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for f in range(200):
        own = sorted({(a, a + rng.randint(0, 6)) for a in (rng.randint(1, 20) for _ in range(rng.randint(0, 5)))})
        rows += [(str(f), a, b, 22) for a, b in own]
        kept, until = [], 0
        for a, b in own:
            start, stop = max(a, until + 1), min(b, 22)
            if start <= stop:
                kept.append(start)
                until = stop
        expected |= {(str(f), s, (kept[i + 1] - 1 if i + 1 < len(kept) else 22)) for i, s in enumerate(kept)}
    frame = spark.createDataFrame(rows, "file_id string, start_page int, end_page int, total_pages int")
    assert {tuple(r) for r in B.resolve_spans(frame).collect()} == expected


def test_numbering_resets(spark):
    rows = [(1, "text", "1. a", None), (1, "list_item", "2) b", None), (2, "text", "3. c", None), (3, "text", "1. d", None), (3, "text", "2. e", None)]
    assert [r["page"] for r in B.numbering_resets(blocks(spark, rows)).collect()] == [3]


def bundle(spark, rows):
    return [(r["pos"], r["block_type"], r["text"]) for r in B.bundle_options(blocks(spark, rows)).orderBy("pos").collect()]


def test_options_join_their_stem(spark):
    rows = [(1, "list_item", "Which acid?", "1."), (1, "text", "10X1=10", None), (1, "list_item", "x", "A."), (2, "list_item", "y", "B.")]
    got = bundle(spark, rows)
    assert got == [(0, "mcq_group", "STEM: 1. Which acid?\nOPTION: A. x\nOPTION: B. y"), (1, "text", "10X1=10")]


def test_long_stemless_and_single_runs(spark):
    long = [(1, "text", "stem", None)] + [(1, "list_item", str(i), "A.") for i in range(7)]
    assert all(t.startswith(B.SUSPICIOUS) for _, _, t in bundle(spark, long)[1:])
    stemless = [(1, "title", "t", None), (1, "list_item", "x", "A."), (1, "list_item", "y", "B.")]
    assert [t.startswith(B.UNASSOCIATED) for _, _, t in bundle(spark, stemless)] == [False, True, True]
    single = [(1, "text", "stem", None), (1, "list_item", "x", "A."), (1, "text", "z", None)]
    assert [t for _, _, t in bundle(spark, single)] == ["stem", "x", "z"]


def test_page_offset(spark):
    rows = [(14, "page_header", "4", None), (15, "page_header", "5", None), (19, "page_footer", "[9]", None), (20, "page_header", "10", None)]
    assert [r["offset"] for r in B.page_offset(blocks(spark, rows)).collect()] == [10]
    assert B.page_offset(blocks(spark, rows[:1])).isEmpty()
    assert B.page_offset(blocks(spark, [(i, "page_header", "iv", None) for i in range(5)])).isEmpty()


def test_filters(spark):
    rows = [(1, "title", "t", None), (1, "text", "x" * 200, None), (1, "text", "short", None), (2, "list_item", "l", None), (3, "table", "c", None)]
    frame = blocks(spark, rows)
    assert B.structural(frame).count() == 2
    assert B.high_signal(frame).count() == 3
    assert [r["block_type"] for r in B.best_tier(frame).collect()] == ["table"]
    assert B.on_pages(frame, 2, 3).count() == 2


def test_a_head_votes_for_each_of_its_pages(spark):
    rows = [("f", 0, [14, 15], "page_header", "[ 4 ]", None), ("f", 1, [15], "page_footer", "( 5 )", None), ("f", 2, [20], "page_header", "10", None), ("g", 0, [1, 2, 3], "page_header", "1", None)]
    got = {r["file_id"]: r["offset"] for r in B.page_offset(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Four votes for f: 10, 11, 10, 10; three different ones for g.
    assert got == {"f": 10}
