"""Whole runs: span joins, incremental components, tables replaced together, deduplication with its stores."""

import json
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tallyfold.cli import main
from tallyfold.operators import graph
from tallyfold.operators.intervals import points_in_spans
from tallyfold.plans.deduplication import united
from tallyfold.sources.snapshots import Snapshots
from tallyfold.sources.tables import VersionedTable
from tests.test_answers import COUNTED, Counted


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_points_in_spans_against_loops(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["f", "g", None]), i, [rng.randrange(60) for _ in range(rng.randrange(4))]) for i in range(150)] + [("f", 999, None)]
    spans = [(rng.choice(["f", "g"]), s, rng.randrange(60)) for s in range(40)]
    spans = [(f, s, low, low + rng.randrange(-2, 15)) for f, s, low in spans] + [("f", 99, None, 3), (None, 98, 0, 60)]
    frame = spark.createDataFrame(rows, "file string, row int, pages array<int>")
    found = points_in_spans(frame, F.col("pages"), spark.createDataFrame(spans, "file string, span int, low int, high int"), "file", "low", "high", width)
    got = [(r["row"], r["span"], tuple(r["pages"])) for r in found.collect()]
    want = {(i, s, tuple(p)) for f, i, p in rows if p for g, s, low, high in spans if f is not None and f == g and low is not None and any(low <= x <= high for x in p)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_file_is_spread_over_its_bins(spark):
    blocks = spark.range(200_000).select(F.lit("f").alias("file"), F.array((F.col("id") % 5000).cast("int")).alias("pages"))
    spans = spark.range(500).select(F.lit("f").alias("file"), F.col("id").alias("paper"), (F.col("id") * 10).cast("int").alias("low"), (F.col("id") * 10 + 9).cast("int").alias("high"))
    found = points_in_spans(blocks, F.col("pages"), spans, "file", "low", "high")
    assert {r["n"] for r in found.groupBy("paper").agg(F.count("*").alias("n")).collect()} == {400}
    keys = blocks.select(F.explode(F.transform("pages", lambda p: F.floor(p / 16)))).groupBy("col").count()
    assert keys.count() == 313 and keys.agg(F.max("count")).first()[0] < 700


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def test_batches_of_edges_give_the_components_of_all(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    labels, touched = None, []
    for begin in range(0, 90, 30):
        new = spark.createDataFrame(edges[begin : begin + 30], "a int, b int")
        if labels is None:
            labels = graph.connected_components(new)
        else:
            changes = graph.component_changes(labels, new)
            touched.append(changes.count())
            labels = spark.createDataFrame(graph.with_changes(labels, changes).collect(), "id int, component int")
        assert {r["id"]: r["component"] for r in labels.collect()} == components(edges[: begin + 30])
    assert touched[-1] < labels.count()
    # Edges inside components change nothing.
    assert graph.component_changes(labels, spark.createDataFrame(edges[:30], "a int, b int")).collect() == []


def test_tables_are_replaced_together(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "s"))
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    seen = lambda version=None: [state.read(n, version).first()["v"] for n in ("canonicals", "links")]
    with pytest.raises(KeyError):
        state.read("canonicals")
    state.write({"canonicals": table(1), "links": table(1)})

    broken = table(2).select(F.raise_error(F.lit("stopped between the two")).cast("int").alias("v"))
    with pytest.raises(Exception, match="stopped between"):
        state.write({"canonicals": table(2), "links": broken})
    # The first table of the write is there, but no reader sees it.
    assert seen() == [1, 1] and state.versions() == [1]
    assert len(list((tmp_path / "s/data").iterdir())) == 2
    state.write({"canonicals": table(3), "links": table(3)})
    assert seen() == [3, 3] and seen(1) == [1, 1]
    state.write({"links": table(4)})
    assert seen() == [3, 4]
    state.drop_unnamed(keep=1)
    assert seen() == [3, 4] and state.versions() == [3] and len(list((tmp_path / "s/data").iterdir())) == 2


def test_exact_decisions_come_before_stored_and_new_ones(spark):
    schema = "a string, b string, decision_source string, verdict string, confidence double"
    made = lambda source, pairs: spark.createDataFrame([(a, b, source, "x", 0.5) for a, b in pairs], schema)
    got = united(made("exact", [("a", "b")]), made("stored", [("a", "b"), ("b", "c")]), made("new", [("b", "c"), ("c", "d")])).collect()
    assert {(r["a"], r["b"]): r["decision_source"] for r in got} == {("a", "b"): "exact", ("b", "c"): "stored", ("c", "d"): "new"}


QUESTIONS = "question_id string, question_text string, question_type string, ambiguous boolean, extraction_confidence double"


def embedder(folder):
    """Letters' counts as vectors; every text that is embedded is noted in ``folder``."""

    def embed(texts):
        with open(f"{folder}/embedded", "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    return embed


def judge(prompt):
    found = [line[1:-1] for line in prompt.split("\n") if line.startswith("[q") and "::" in line]
    return {"verdicts": [{"pair_id": p, "verdict": "same_question", "confidence": 0.9} for p in found]}


def test_deduplication_command_embeds_and_judges_only_what_is_new(spark, tmp_path, monkeypatch):
    count = COUNTED["now"] = Counted(tmp_path, judge)
    monkeypatch.setattr("tests.test_workflows.load", partial(embedder, str(tmp_path)), raising=False)
    embedded = lambda: open(f"{tmp_path}/embedded").read().splitlines() if (tmp_path / "embedded").exists() else []
    texts = ["name the parts of a cell", "name the parts of a cell.", "parts of a cell, name them", "why is blood red", None]

    def run(rows, code=0):
        path = str(tmp_path / f"q{len(list(tmp_path.glob('q*')))}")
        spark.createDataFrame([(f"q{i}", t, "essay", False, 0.9) for i, t in enumerate(rows)], QUESTIONS).write.parquet(path)
        given = ["deduplicate", "--questions", path, "--out", str(tmp_path / "o"), "--provider", "tests.test_answers:provider", "--embedder", "tests.test_workflows:load"]
        assert main(given) == code
        state = Snapshots(spark, str(tmp_path / "o/state"))
        groups = {}
        for r in state.read("links").collect() if state.versions() else []:
            groups.setdefault(r["canonical_question_id"], set()).add(r["question_id"])
        return sorted(map(sorted, groups.values()))

    count.allow(0)
    assert run(texts, 2) == [] and count.calls() == 0 and len(embedded()) == 3
    count.allow(10)
    # q0 and q1 are the same by key, and only one of them is embedded; q2 is judged the same.
    assert run(texts) == [["q0", "q1", "q2"], ["q3"], ["q4"]] and count.calls() == 1 and len(embedded()) == 3
    statistics = {(r["kind"], r["name"]): r["n"] for r in map(lambda r: json.loads(r["value"]), spark.read.text(str(tmp_path / "o/json/statistics")).collect())}
    assert statistics["run", "exact_pairs"] == 1 and statistics["run", "pairs_judged"] == 1 and statistics["pairs", "exact_duplicate:same_question"] == 1
    assert run(texts) == [["q0", "q1", "q2"], ["q3"], ["q4"]] and count.calls() == 1 and len(embedded()) == 3
    # A text that changes loses its vector and its verdict, nothing else does.
    texts[2] = "the parts of a cell: name them"
    assert run(texts) == [["q0", "q1", "q2"], ["q3"], ["q4"]] and count.calls() == 2 and len(embedded()) == 4


def test_papers_carry_metadata_and_their_conflicts_reach_the_report(spark, tmp_path):
    from tests.test_analysis import stub  # noqa: F401  the provider of the other commands

    rows = [("a" * 16, i, [i + 1], "list_item", f"{i + 1}. Explain part {i} of it.", None) for i in range(2)]
    spark.createDataFrame(rows, "file_id string, pos long, page_numbers array<int>, block_type string, text string, marker string").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([("a" * 16, "anatomy_2021.pdf")], "file_id string, filename string").write.parquet(str(tmp_path / "f"))
    given = ["extract-questions", "--blocks", str(tmp_path / "b"), "--files", str(tmp_path / "f"), "--out", str(tmp_path / "q"), "--provider", "tests.test_workflows:dated"]
    assert main(given) == 0
    paper = json.loads(spark.read.text(str(tmp_path / "q/json/papers")).first()["value"])
    assert paper["metadata"]["year"] == {"document_value": "2022", "document_evidence": "Exam 2022", "document_source_pages": [1], "document_confidence": 0.9, "filename_value": "2021", "conflict": True}
    assert paper["sections"][0]["raw_label"] == "A" and [q["question_text"] for q in paper["questions"]] == ["Explain part 0 of it.", "Explain part 1 of it."]
    from tallyfold.plans.analysis import paper_flags

    questions, papers = spark.read.parquet(str(tmp_path / "q/questions")), spark.read.parquet(str(tmp_path / "q/detailed"))
    assert [r["year_conflict"] for r in paper_flags(questions, papers).collect()] == [True]
    assert [r["year_conflict"] for r in paper_flags(questions, None).collect()] == [False]


def dated():
    """The stub of the other commands, with a year in the paper."""
    from tallyfold.providers import Provider
    from tests.test_analysis import stub

    plain = stub()

    def complete(prompt, room, attempt):
        answer = json.loads(plain.complete(prompt, room, attempt))
        if prompt.startswith("Read this paper"):
            answer["year"] = {"value": "2022", "evidence": "Exam 2022", "source_pages": [1], "confidence": 0.9}
        return json.dumps(answer)

    return Provider("dated", complete)


def run_rule(prompt):
    """Answers of a whole run: one paper a file, its numbered lines, topics by a word, pairs judged the same."""
    from tests.test_answers import exam_rule

    if prompt.startswith("Say for each pair"):
        pairs = [line[1:-1] for line in prompt.split("\n") if line.startswith("[") and "::" in line]
        return {"verdicts": [{"pair_id": p, "verdict": "same_question", "confidence": 0.9} for p in pairs]}
    return exam_rule(prompt)


def test_a_run_from_blocks_to_the_report_stops_and_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tests.test_workflows.load", partial(embedder, str(tmp_path)), raising=False)
    count = COUNTED["now"] = Counted(tmp_path, run_rule)
    rows = [(f * 16, i, [i + 1], "list_item", f"{i + 1}. {t}", None) for f in "ab" for i, t in enumerate([f"Explain the heart, as {f} does.", "Name the parts of a cell."])]
    spark.createDataFrame(rows, "file_id string, pos long, page_numbers array<int>, block_type string, text string, marker string").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([("f", 0, "t1", "Cells", 1, None)], "forest string, ord long, id string, name string, level int, parent_id string").write.parquet(str(tmp_path / "t"))
    out = str(tmp_path / "o")
    given = ["run", "--blocks", str(tmp_path / "b"), "--topics", str(tmp_path / "t"), "--out", out, "--provider", "tests.test_answers:provider", "--embedder", "tests.test_workflows:load"]
    codes, states = [], []
    while not codes or codes[-1] == 2:
        count.allow(3)
        codes.append(main(given))
        jobs = VersionedTable(spark, f"{out}/jobs", ["job_id", "stage"]).read().collect()
        states.append({r["stage"]: r["status"] for r in jobs})
    # One call for the papers of both files, two each for details, questions and topics, one for the pairs that are alike.
    assert codes == [2, 2, 0] and count.calls() == 8
    assert states[0] == {"extract-questions": "paused"} and states[1] == {"extract-questions": "success", "classify-topics": "paused"}
    assert set(states[2].values()) == {"success"} and set(states[2]) == {"extract-questions", "classify-topics", "deduplicate", "report"}
    # By their letters all four are candidates, and every candidate is judged the same.
    links = Snapshots(spark, f"{out}/deduplicate/state").read("links").groupBy("canonical_question_id").count()
    assert [r["count"] for r in links.collect()] == [4]
    topics = spark.read.parquet(f"{out}/report/topics").collect()
    assert [(r["topic_id"], r["total_occurrences"], r["unique_canonical"]) for r in topics] == [("t1", 4, 1)]
    assert "Cells" in spark.read.text(f"{out}/report/report", wholetext=True).first()[0]
    # A finished job begins anew, and finds all its answers.
    count.allow(0)
    assert main(given) == 0 and count.calls() == 8
