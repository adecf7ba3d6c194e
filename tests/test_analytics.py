import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.operators import dedup, frequency, reconcile, report
from tallyfold.operators.graph import connected_components

QUESTIONS = (
    "question_id string, paper_id string, topic_id string, paper_year string, question_type string, classification_status string, "
    "extraction_confidence double, ambiguous boolean, question_text string"
)


def questions(spark, n=4):
    kinds = ["mcq", "mcq", "essay", "other"]
    rows = [(f"q{i}", f"p{i % 2}", "t1" if i < 3 else "t2", ["2022", "2017-18", None, ""][i % 4], kinds[i % 4], "classified", 0.9, False, "x" * (i + 1)) for i in range(n)]
    return spark.createDataFrame(rows, QUESTIONS)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "question_id string, canonical_question_id string")


def test_counts_years_and_shares(spark):
    q = questions(spark)
    assert {r["question_type"]: r["n"] for r in frequency.type_counts(q).collect()} == {
        "mcq": 2, "short_answer": 0, "short_essay": 0, "long_answer": 0, "essay": 1, "other": 1, "unknown": 0,
    }
    assert [r["paper_year"] for r in frequency.years_represented(q).orderBy("ord").collect()] == ["2017-18", "2022"]
    assert {r["share_pct"] for r in frequency.type_shares(q).collect()} == {50.0, 25.0, 0.0}
    assert {r["share_pct"] for r in frequency.type_shares(q.where("false")).collect()} == {0.0}
    years = frequency.first_and_latest_year(q, ["paper_id"]).orderBy("paper_id").collect()
    assert [tuple(r) for r in years] == [("p0", "2022", "2022"), ("p1", "2017-18", "2017-18")]


def test_integrity(spark):
    q = questions(spark)
    good = links(spark, [(f"q{i}", "c") for i in range(4)])
    assert frequency.data_integrity(q, good, good).first()["reconciled"] is True
    bad = links(spark, [("q0", "c"), ("q0", "d"), ("q1", "c"), ("q2", "c")])
    row = frequency.data_integrity(q, bad, bad).first()
    assert (row["orphaned"], row["duplicated"], row["reconciled"]) == (1, 1, False)
    assert frequency.data_integrity(q.where("false"), good.where("false"), good.where("false")).first()["reconciled"] is True


def test_ranking_and_repetition(spark):
    q = questions(spark)
    linked = links(spark, [("q0", "c_a"), ("q1", "c_a"), ("q2", "c_b"), ("q3", "c_c"), ("gone", "c_c")])
    canonicals = spark.createDataFrame([("c_a",), ("c_b",), ("c_c",), ("c_none",)], "canonical_question_id string")
    ranking = frequency.rank_canonicals(frequency.canonical_frequency(canonicals, linked, q)).orderBy("rnk").collect()
    assert [(r["canonical_question_id"], r["occurrences"], r["papers"]) for r in ranking] == [("c_a", 2, 2), ("c_c", 2, 1), ("c_b", 1, 1), ("c_none", 0, 0)]
    stats = {r["question_type"]: (r["occurrences"], r["unique_canonical"], r["repeated"]) for r in frequency.repetition_by_type(q, linked).collect()}
    assert stats["mcq"] == (2, 1, 1) and stats["unknown"] == (0, 0, 0)


def test_pair_and_topic_verdicts(spark):
    asked = spark.createDataFrame([("a::b",), ("a::c",), ("b::c",)], "pair_id string")
    verdicts = spark.createDataFrame(
        [("a::b", 1, "different_question", 0.9), ("a::b", 2, "same_question", 0.59), ("b::c", 1, "same_question", 0.6), ("x::y", 1, "same_question", 0.9)],
        "pair_id string, seq int, verdict string, confidence double",
    )
    got = {r["pair_id"]: (r["verdict"], r["confidence"]) for r in dedup.reconcile_pairs(asked, verdicts).collect()}
    assert got == {"a::b": ("uncertain", 0.59), "a::c": ("uncertain", 0.0), "b::c": ("same_question", 0.6)}
    topics = spark.createDataFrame([("t1",)], "topic_id string")
    answers = spark.createDataFrame([("q0", 1, "classified", "t1", 0.8), ("q1", 1, "classified", "made up", 0.8), ("q2", 1, "no_match", None, 0.7)], "question_id string, seq int, status string, topic_id string, confidence double")
    rows = {r["question_id"]: tuple(r)[1:] for r in reconcile.reconcile_topics(questions(spark), topics, answers).collect()}
    assert rows == {"q0": ("classified", "t1", 0.8), "q1": ("unclassified", None, 0.0), "q2": ("no_match", None, 0.7), "q3": ("unclassified", None, 0.0)}


def test_all_pairs_of_a_large_group(spark):
    n = 1_203
    keyed = spark.range(n + 3).select(
        F.format_string("q%05d", "id").alias("question_id"), F.when(F.col("id") < n, "x").when(F.col("id") < n + 2, "y").otherwise("z").alias("exact_key")
    )
    got = dedup.exact_duplicate_pairs(keyed)
    assert got.count() == got.distinct().count() == n * (n - 1) // 2 + 1
    assert got.where("a >= b").count() == 0


def test_canonical_states(spark):
    decisions = spark.createDataFrame(
        [("q0", "q1", "exact_duplicate", "same_question", 1.0), ("q1", "q2", "llm_judge", "same_question", 0.8), ("q2", "q3", "llm_judge", "uncertain", 0.4)],
        "a string, b string, decision_source string, verdict string, confidence double",
    )
    canonicals, linked = dedup.assemble_canonicals(questions(spark, 5), decisions)
    got = {r["representative_question_id"]: (r["members"], r["dedup_status"], r["dedup_confidence"]) for r in canonicals.collect()}
    assert got == {"q2": (3, "semantic_merge", 0.8), "q3": (1, "needs_review", 0.4), "q4": (1, "singleton", None)}
    assert linked.count() == 5


def test_cosine_gates(spark):
    rows = [("a", "mcq", [1.0, 0.0]), ("b", "essay", [0.9, 0.436]), ("c", "essay", [0.999, 0.045]), ("d", "mcq", None), ("e", "mcq", [0.0, 0.0])]
    got = dedup.cosine_candidates(spark.createDataFrame(rows, "id string, kind string, vector array<double>"), slice_rows=1)
    assert {(r["a"], r["b"]) for r in got.collect()} == {("a", "c"), ("b", "c")}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_agree_with_union_find(spark, pairs):
    root = list(range(26))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_batches_and_backfill(spark):
    got = dedup.batches(spark.range(100).withColumnRenamed("id", "n"), ["n"], 40).collect()
    assert all(r["batch"] == r["n"] // 40 for r in got)


ASKED = "paper_id string, pos long, question_number string, question_text string, question_type string, options array<string>"
FOUND = "paper_id string, pos long, block_type string, text string, marker string"


def backfilled(spark, asked, blocks):
    rows = [("p", i, *q) for i, q in enumerate(asked)]
    found = [("p", i, *b) for i, b in enumerate(blocks)]
    out = reconcile.backfill_questions(spark.createDataFrame(rows, ASKED), spark.createDataFrame(found, FOUND))
    return [(r["question_number"], r["options"]) for r in out.orderBy("pos").collect()]


GROUP = ("mcq_group", "STEM: 3. What is the pH of blood?\nOPTION: 7.4\nOPTION: 6", None)
STEM = "What is the pH of blood?"


@pytest.mark.parametrize(
    ("asked", "blocks", "expected"),
    [
        ([(None, STEM, "mcq", [])], [GROUP], [("3", ["7.4", "6"])]),
        # Two blocks that agree decide nothing; a used one is gone.
        ([(None, STEM, "mcq", [])], [GROUP, GROUP], [(None, [])]),
        ([(None, STEM, "mcq", []), (None, STEM, "mcq", [])], [GROUP], [("3", ["7.4", "6"]), (None, [])]),
        # Options are for mcq only; what is there stays; a question that misses nothing takes no block.
        ([(None, STEM, "short_answer", [])], [GROUP], [("3", [])]),
        ([("9", STEM, "mcq", ["x"]), (None, STEM, "mcq", [])], [GROUP], [("9", ["x"]), ("3", ["7.4", "6"])]),
        # Titles are no stems; a bracket before a marker's number is none either.
        ([(None, "Explain the Cori cycle.", "essay", [])], [("title", "4. Explain the Cori cycle.", None)], [(None, [])]),
        ([(None, "Explain the Cori cycle.", "essay", [])], [("list_item", "Explain the Cori cycle.", "(4)")], [(None, [])]),
        ([(None, "Explain the Cori cycle.", "essay", [])], [("list_item", "Explain the Cori cycle.", "4.")], [("4", [])]),
        ([(None, "Explain the Cori cycle.", "essay", [])], [("text", "7) Explain the Cori cycle.", None)], [("7", [])]),
    ],
)
def test_backfill(spark, asked, blocks, expected):
    assert backfilled(spark, asked, blocks) == expected


def greedy(asked, blocks):
    """The rule of backfilling numbers, one question after another."""
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    free = {}
    for i, (kind, t, _) in enumerate(blocks):
        m = re.match(r"\s*(\d{1,3}[a-zA-Z]?)[.\):]\s+", t)
        if kind == "text" and m and len(norm(t[m.end() :])) >= 12:
            free[i] = (m[1], norm(t[m.end() :]))
    out = []
    for number, text, *_ in asked:
        own = norm(text)
        near = [i for i, (_, s) in free.items() if (n := min(len(s), len(own), 30)) >= 12 and s[:n] == own[:n]] if number is None else []
        out.append(free.pop(near[0])[0] if len(near) == 1 else number)
    return out


def test_backfill_against_its_rule(spark):
    rng = random.Random(8)
    texts = ["what is the name of the enzyme", "what is the name of the enzyme that cuts", "define osmosis now", "define osmosis", "short", "explain the cori cycle in full"]
    for _ in range(6):
        asked = [(rng.choice([None, None, None, "5"]), rng.choice(texts), "essay", []) for _ in range(12)]
        blocks = [("text", f"{i + 1}. {rng.choice(texts)}", None) for i in range(8)]
        assert [n for n, _ in backfilled(spark, asked, blocks)] == greedy(asked, blocks)


def test_large_groups_give_all_pairs(spark):
    rows = [(f"q{i:05d}", "same") for i in range(1_500)] + [("z", "other")]
    pairs = dedup.exact_duplicate_pairs(spark.createDataFrame(rows, "question_id string, exact_key string"))
    assert pairs.count() == pairs.distinct().count() == 1_500 * 1_499 // 2
    assert pairs.where("a >= b").count() == 0


def test_decisions_on_unknown_questions_say_nothing(spark):
    q = [(x, False, 0.9, f"text {x}") for x in "ab"]
    questions = spark.createDataFrame(q, "question_id string, ambiguous boolean, extraction_confidence double, question_text string")
    made = [("a", "b", "exact_duplicate", "same_question", 1.0), ("b", "zz", "judge", "same_question", 0.7)]
    decisions = spark.createDataFrame(made, "a string, b string, decision_source string, verdict string, confidence double")
    row = dedup.assemble_canonicals(questions, decisions)[0].first()
    assert (row["dedup_status"], row["dedup_confidence"], row["members"]) == ("exact_duplicate", 1.0, 2)


def test_ranks_over_partitions(spark):
    rows = spark.range(500).selectExpr("id", "id % 17 AS n")
    got = frequency.ranked_widely(rows, [F.desc("n"), F.asc("id")]).collect()
    expected = sorted(range(500), key=lambda i: (-(i % 17), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rnk"])] == expected and [r["rnk"] for r in sorted(got, key=lambda r: r["rnk"])] == list(range(1, 501))


def test_trials(spark):
    trials = spark.createDataFrame([("x", 1, 0, "A"), ("x", 2, 0, "B"), ("x", 1, 1, "C"), ("x", 2, 1, "C")], "label string, trial int, pos int, name string")
    assert [r["pos"] for r in report.differing_names(trials, 1, 2).collect()] == [0]
    same = spark.createDataFrame([("x", 1, "f"), ("x", 2, "f"), ("y", 1, "f"), ("y", 2, "g")], "label string, trial int, fingerprint string")
    assert {r["label"]: r["identical"] for r in report.identical_trials(same).collect()} == {"x": True, "y": False}


@pytest.mark.parametrize(("kind", "expected", "answered", "outcome"), [("error", "a", "a", "corrected"), ("error", "a", None, "became_ambiguous"), ("control", "a", "b", "regressed_to_wrong")])
def test_outcomes(spark, kind, expected, answered, outcome):
    rows = spark.createDataFrame([(kind, expected, answered)], "kind string, expected string, answered string")
    assert report.adjudication_outcomes(rows).first()["outcome"] == outcome


def jaccard_slow(left, right, top):
    def sets(rows):
        out = {}
        for i, t in rows:
            if i is not None:
                out.setdefault(i, []).extend(set(re.split("[^a-z0-9]+", (t or "").lower())) - {""})
        return out

    a, b, found = sets(left), sets(right), set()
    for i, x in a.items():
        scored = []
        for k, y in b.items():
            shared = sum(x.count(w) * y.count(w) for w in set(x))
            if shared >= 2:
                scored.append((-((2_000_000 * shared + (n := len(x) + len(y) - shared)) // (2 * n)) / 1e6, k))
        found |= {(i, n, k, -s) for n, (s, k) in enumerate(sorted(scored)[:top], 1)}
    return found


@pytest.mark.parametrize("bounds", [{}, {"COUNTED_MATCHES": 3}, {"BROADCAST_IDS": 0}, {"LISTED_WORDS": 0}])
def test_word_jaccard(spark, monkeypatch, bounds):
    """With long and short references, ids that repeat on both sides, nulls and a word of many texts."""
    for name, value in bounds.items():
        monkeypatch.setattr(report, name, value)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(n)).upper()
    left = [(i, text(rng.randint(0, 14)) + rng.choice(["", ", the", "-7"])) for i in range(60)] + [(None, "a b c"), (61, None), (62, ""), (3, "A b! kk"), (3, "b 7 the")]
    right = [(f"r{i}", text(rng.randint(0, 9)) + " The 7") for i in range(20)] + [("r5", "aa b c"), (None, "a b"), ("x", None)]
    got = report.token_jaccard(spark.createDataFrame(left, "id long, text string"), spark.createDataFrame(right, "id string, text string"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(jaccard_slow(left, right, 3))


def test_word_jaccard_shuffles_no_words(spark):
    left = spark.createDataFrame([(i, "one two three") for i in range(20)], "id long, text string")
    found = report.token_jaccard(left, spark.createDataFrame([(1, "one two"), (2, "two three four")], "id long, text string"), 3)
    assert found.count() == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_word_jaccard_of_empty_tables(spark):
    rows = lambda r: spark.createDataFrame(r, "id long, text string")
    some = rows([(1, "a b c"), (2, None)])
    for left, right in ((some, rows([])), (rows([]), some), (some, rows([(7, None), (8, "zz")]))):
        assert report.token_jaccard(left, right, 3).collect() == []
