"""Disk of long runs: what a written table leaves behind, and prompts of pairs in waves."""

import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from tallyfold.answers import AnswerStore, Recorded
from tallyfold.functions.text import collapse, exact_text
from tallyfold.operators import listings, render
from tallyfold.plans import stages
from tallyfold.plans.deduplication import still_valid
from tallyfold.providers import Provider
from tallyfold.scratch import Scratch


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = Scratch(spark, "left").keep(spark.range(5_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and kept.count() == 7


def judged(spark, pairs, questions):
    def complete(prompt, room, attempt):
        found = re.findall(r"(?m)^\[(q\d+::q\d+)\]$", prompt)
        # Both texts of every pair are there.
        assert all(f"Question A ({p.split('::')[0]}):\ntype=essay\ntext: Text of {p.split('::')[0]}" in prompt for p in found)
        return '{"verdicts": [%s]}' % ", ".join('{"pair_id": "%s", "verdict": "same_question", "confidence": 0.9}' % p for p in found)

    return {tuple(r) for r in stages.judge_pairs(pairs, questions, Provider("all", complete)).collect()}


def test_pairs_are_judged_in_waves(spark, monkeypatch):
    rows = [(f"q{i}", "essay", f"Text of q{i}", None, None) for i in range(120)]
    questions = spark.createDataFrame(rows, "question_id string, question_type string, question_text string, options array<string>, topic_name string")
    pairs = spark.createDataFrame([("q0", f"q{i}") for i in range(1, 120)] + [("q0", "gone")], "a string, b string")
    monkeypatch.setattr(stages, "JUDGE_WAVE", 1)
    got = judged(spark, pairs, questions)
    assert got == {(f"q0::q{i}", "same_question", 0.9) for i in range(1, 120)} | {("q0::gone", "uncertain", 0.0)}


def test_a_text_is_sent_once_to_a_batch(spark):
    rows = [("q0", "essay", "Zero", None, None), ("q0", "essay", "Zero", None, None), ("q1", "essay", "One", None, None), ("q2", "essay", None, None, None)]
    questions = spark.createDataFrame(rows, "question_id string, question_type string, question_text string, options array<string>, topic_name string")
    pairs = spark.createDataFrame([(0, "q0", "q1"), (0, "q0", "q2"), (1, "q1", "q2")], "batch long, a string, b string")
    shown = {r["batch"]: r["text"] for r in render.pair_lists(pairs, questions).collect()}
    assert shown == {0: "[q0::q1]\nQuestion A (q0):\ntype=essay\ntext: Zero\n\nQuestion B (q1):\ntype=essay\ntext: One"}


def test_texts_go_once_to_a_tile_and_pairs_fill_their_batches(spark, monkeypatch, tmp_path):
    rows = [(f"q{i}", "essay", f"Text of q{i}", None, None) for i in range(60)]
    questions = spark.createDataFrame(rows, "question_id string, question_type string, question_text string, options array<string>, topic_name string")
    pairs = spark.range(60).crossJoin(spark.range(60).withColumnRenamed("id", "j")).where("id < j").selectExpr("'q' || id AS a", "'q' || j AS b")
    monkeypatch.setattr(stages, "TILE_TEXTS", 15)
    tiled, tiles, count = stages._tiles(pairs)
    told = questions.selectExpr("question_id", "question_text AS told")
    sent = render.pair_rows(tiled, told, "tile").where("b IS NULL").count()
    # Up to 60 texts for each slice, where each of the 45 batches was sent its own.
    assert count == 1770 and tiles >= 10 and sent <= 60 * (tiles * 2) ** 0.5

    def complete(prompt, room, attempt):
        found = re.findall(r"(?m)^\[(q\d+::q\d+)\]$", prompt)
        (tmp_path / f"{hash(prompt)}").write_text(str(len(found)))
        return '{"verdicts": [%s]}' % ", ".join('{"pair_id": "%s", "verdict": "same_question", "confidence": 0.%d}' % (p, 5 + int(p[1:].split("::")[0]) % 2 * 4) for p in found)

    want = {(f"q{i}::q{j}", *(("same_question", 0.9) if i % 2 else ("uncertain", 0.5))) for i in range(60) for j in range(i + 1, 60)}
    plain = Provider("all", complete)
    assert {tuple(r) for r in stages.judge_pairs(pairs, questions, plain).collect()} == want
    # Batches go on from tile to tile, so no call is made for a part of one but the last.
    assert sorted(int(f.read_text()) for f in tmp_path.iterdir()) == [10, *[40] * 44]
    recorded = Recorded(plain, AnswerStore(spark, str(tmp_path / "answers")))
    assert {tuple(r) for r in stages.judge_pairs(pairs, questions, recorded).collect()} == want and recorded.metrics.calls == 45


def test_decisions_on_changed_texts_are_left_out(spark):
    made = spark.createDataFrame([("a", "b", "1", "2"), ("a", "c", "1", "3"), ("b", "c", "2", "9")], "a string, b string, hash_a string, hash_b string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, content_hash string")
    assert {(r["a"], r["b"]) for r in still_valid(made, now).collect()} == {("a", "b"), ("a", "c")}
    assert still_valid(made.limit(2), now).count() == 2


def test_blanks_of_all_kinds_collapse(spark):
    blanks = [" ", "\n", "\t", "\r\n", "\v", "\f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "  \n", " " * 9]
    texts = [(f"a{x}b", f"{x}a{y}B..") for x in blanks for y in blanks]
    got = spark.createDataFrame(texts, "one string, two string").select(collapse(F.col("one")), exact_text(F.col("two"))).distinct().collect()
    assert [tuple(r) for r in got] == [("a b", "a b")]
    odd = spark.createDataFrame([("\x1ca\x1d",), (None,)], "t string").select(collapse(F.col("t"))).collect()
    assert [r[0] for r in odd] == ["\x1ca\x1d", None]


def test_statistics_work_out_the_records_once(spark, tmp_path):
    def noted(batches):
        (tmp_path / f"{time.time_ns()}").touch()
        yield from batches

    made = spark.createDataFrame([("singleton", 1), ("semantic_merge", 3), ("semantic_merge", 2)], "dedup_status string, members long").coalesce(1)
    decisions = spark.createDataFrame([("a", "b", "x", "y", 0.5)], "a string, b string, decision_source string, verdict string, confidence double")
    got = {tuple(r) for r in listings.dedup_statistics(decisions, made.mapInArrow(noted, made.schema)).collect()}
    assert got == {("pairs", "x:y", 1), ("canonicals", "singleton", 1), ("canonicals", "semantic_merge", 2), ("groups", "repeated", 2)}
    assert len(list(tmp_path.iterdir())) == 1
    empty = listings.dedup_statistics(decisions.limit(0), made.limit(0)).collect()
    assert [tuple(r) for r in empty] == [("groups", "repeated", 0)]
