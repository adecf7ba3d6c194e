import json

from tallyfold.cli import main
from tallyfold.plans.analysis import load_topics
from tallyfold.sources.snapshots import Snapshots

SCHEMA = (
    "question_id string, paper_id string, topic_id string, paper_year string, question_type string, classification_status string, "
    "extraction_confidence double, ambiguous boolean, question_text string, options array<string>"
)


def test_end_to_end(spark, tmp_path):
    (tmp_path / "list.md").write_text("# Cells\n## Membranes\n## Nuclei\n# Blood")
    main(["topics", "--source", str(tmp_path / "list.md"), "--out", str(tmp_path / "t")])
    rows = [
        ("q1", "p1", "membranes", "2022", "mcq", "classified", 0.9, False, "What is it?", ["x", "y"]),
        ("q2", "p2", "membranes", "2023", "mcq", "classified", 0.8, False, "what  is it?", ["X", "Y."]),
        ("q3", "p2", "blood", "2023", "essay", "classified", 0.8, False, "Describe it.", []),
        ("q4", "p2", None, "2023", "essay", "unclassified", 0.8, False, "Odd", []),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "q"))
    main(["analyze", "--topics", str(tmp_path / "t/topics"), "--questions", str(tmp_path / "q"), "--out", str(tmp_path / "o")])
    read = lambda name: spark.read.parquet(str(tmp_path / "o" / name))
    assert [(r["topic_id"], r["total_occurrences"], r["unique_canonical"]) for r in read("topics").orderBy("rnk").collect()] == [("blood", 1, 1), ("membranes", 2, 1)][::-1]
    assert {r["id"] for r in read("tree").where("tested").collect()} == {"cells", "membranes", "blood"}
    assert read("repeated").first()["occurrences"] == 2 and Snapshots(spark, str(tmp_path / "o/state")).read("canonicals").count() == 3
    assert read("integrity").first()["reconciled"] is True
    assert "## Data quality" not in (text := spark.read.text(str(tmp_path / "o/report"), wholetext=True).first()[0]) and "membranes" in text


def test_json_kinds(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps([{"name": "A", "level": 1}, {"name": "B", "level": 2}]))
    (tmp_path / "tree.json").write_text(json.dumps([{"name": "A", "children": [{"name": "B"}]}]))
    for name in ("flat.json", "tree.json"):
        got = [(r["id"], r["level"], r["parent_id"]) for r in load_topics(spark, str(tmp_path / name)).orderBy("ord").collect()]
        assert got == [("a", 1, None), ("b", 2, "a")]


def stub():
    """The provider of the command line's test: one paper a file, its numbered lines as questions."""
    import re

    from tallyfold.providers import Provider

    def complete(prompt, room, attempt):
        if prompt.startswith("Find the exam papers"):
            return json.dumps({"papers": [{"start_page": 1, "end_page": 9, "confidence": 1}]})
        if prompt.startswith("Read this paper"):
            return json.dumps({"sections": [{"raw_label": "A", "section_type": "essay", "start_page": 1, "end_page": 9, "confidence": 1}]})
        if prompt.startswith("Extract every question"):
            found = re.findall(r"list_item\) (?:\d\. )?(.*)", prompt)
            return json.dumps({"questions": [{"question_text": t, "question_type": "essay", "extraction_confidence": 1, "options": [], "section_index": 0} for t in found]})
        asked = re.findall(r"\[(\S+_q\d)\]", prompt)
        return json.dumps({"classifications": [{"question_id": q, "status": "classified", "topic_id": "blood", "confidence": 0.5} for q in asked]})

    return Provider("stub", complete)


def spent():
    from tallyfold.providers import Provider, classify_error

    def complete(prompt, room, attempt):
        raise classify_error(429, "free-models-per-day")

    return Provider("spent", complete)


def test_commands_with_a_provider(spark, tmp_path):
    (tmp_path / "list.md").write_text("# Cells\n# Blood")
    assert main(["topics", "--source", str(tmp_path / "list.md"), "--out", str(tmp_path / "t")]) == 0
    rows = [("f" * 16, i, [i + 1], "list_item", f"{i + 1}. Explain part {i} of it.", None) for i in range(3)]
    spark.createDataFrame(rows, "file_id string, pos long, page_numbers array<int>, block_type string, text string, marker string").write.parquet(str(tmp_path / "b"))
    given = ["extract-questions", "--blocks", str(tmp_path / "b"), "--out", str(tmp_path / "q")]
    assert main([*given, "--provider", "tests.test_analysis:spent"]) == 2
    assert main([*given, "--provider", "tests.test_analysis:stub"]) == 0
    found = spark.read.parquet(str(tmp_path / "q/questions"))
    assert [(r["question_text"], r["section_id"][-3:]) for r in found.orderBy("question_id").collect()] == [(f"Explain part {i} of it.", "_s0") for i in range(3)]
    assert spark.read.text(str(tmp_path / "q/json/papers")).count() == 1
    more = ["classify-topics", "--topics", str(tmp_path / "t/topics"), "--questions", str(tmp_path / "q/questions"), "--provider", "tests.test_analysis:stub", "--out", str(tmp_path / "c")]
    assert main(more) == 0
    assert {r["topic_name"] for r in spark.read.parquet(str(tmp_path / "c/questions")).collect()} == {"Blood"}


def test_a_file_without_topics_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "empty.md").write_text("\n\n")
    with pytest.raises(ValueError):
        main(["topics", "--source", str(tmp_path / "empty.md"), "--out", str(tmp_path / "t")])
