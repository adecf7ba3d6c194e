"""Answers that survive a stop: what a paused run was told is not asked again, by any stage or command."""

import json
import os
import re

import pytest
from pyspark.errors import PySparkException


from tallyfold.answers import AnswerStore, Recorded
from tallyfold.cli import main
from tallyfold.plans import stages
from tallyfold.providers import Completion, Provider, ProviderError, classify_error
from tallyfold.sources.files import BLOCKS


class Counted:
    """A provider that notes every answered prompt in a folder and has ``most`` calls; ``most`` is read anew at each call."""

    def __init__(self, folder, rule):
        self.folder, self.rule = str(folder), rule
        os.makedirs(f"{self.folder}/calls", exist_ok=True)
        self.allow(10**6)

    def allow(self, calls):
        with open(f"{self.folder}/most", "w") as f:
            f.write(str(calls + self.calls()))

    def calls(self):
        return len(os.listdir(f"{self.folder}/calls"))

    def __call__(self, prompt, room, attempt):
        # A name that exists already is not taken again, so that tasks side by side count right.
        for n in range(int(open(f"{self.folder}/most").read())):
            try:
                os.close(os.open(f"{self.folder}/calls/{n}", os.O_CREAT | os.O_EXCL))
                return Completion.of(json.dumps(self.rule(prompt)), "m-1", len(prompt), 7)
            except FileExistsError:
                continue
        raise classify_error(402, "credits")


def asked(spark, n):
    return spark.createDataFrame([(f"k{i}", f"prompt {i // 2}") for i in range(n)], "key string, prompt string")


@pytest.mark.parametrize("left", [0, 3, 9])
def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, left):
    count = Counted(tmp_path, lambda p: {"echo": p})
    store = AnswerStore(spark, str(tmp_path / "store"))
    count.allow(left)
    first = Recorded(Provider("m", count), store, per_task=1)
    with pytest.raises(ProviderError) as stopped:
        first.ask(asked(spark, 20), None, "s")
    assert stopped.value.out_of_quota and count.calls() == left
    # Metrics are there although the run stopped.
    assert (first.metrics.calls, first.metrics.answered, first.metrics.tokens_out) == (left, left, 7 * left)
    count.allow(100)
    second = Recorded(Provider("m", count), store)
    got = {r["key"]: r["answer"] for r in second.ask(asked(spark, 20), None, "s").collect()}
    assert got == {f"k{i}": json.dumps({"echo": f"prompt {i // 2}"}) for i in range(20)}
    # Ten different prompts, each answered once over both runs.
    assert count.calls() == 10 and second.metrics.answered == 10 - left
    third = Recorded(Provider("m", count), store)
    assert third.ask(asked(spark, 20), None, "s").count() == 20 and third.metrics.calls == 0
    # Another stage or model has its own answers.
    Recorded(Provider("m", count), store).ask(asked(spark, 2), None, "other")
    Recorded(Provider("n", count), store).ask(asked(spark, 2), None, "s")
    assert count.calls() == 12
    total = {(r["stage"], r["model"]): (r["answered"], r["tokens_out"]) for r in store.totals().collect()}
    assert total == {("s", "m"): (10, 70), ("other", "m"): (1, 7), ("s", "n"): (1, 7)}


def test_failed_answers_are_recorded_and_asked_again(spark, tmp_path):
    count = Counted(tmp_path, lambda p: {"wrong": 1} if not os.path.exists(f"{tmp_path}/mend") else {"right": 1})
    check = lambda a: None if "right" in a else "no"
    store = AnswerStore(spark, str(tmp_path / "store"))
    got = Recorded(Provider("m", count), store).ask(asked(spark, 2), check, "s").collect()
    assert {(r["key"], r["answer"], r["error"], r["attempts"]) for r in got} == {("k0", None, "no", 3), ("k1", None, "no", 3)}
    (tmp_path / "mend").touch()
    got = Recorded(Provider("m", count), store).ask(asked(spark, 2), check, "s").collect()
    assert {(r["answer"], r["error"]) for r in got} == {('{"right": 1}', None)} and count.calls() == 4


def test_no_prompts_and_other_errors(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "store"))
    assert Recorded(Provider("m", None), store).ask(asked(spark, 2).where("false"), None, "s").collect() == []

    def breaks(prompt, room, attempt):
        raise RuntimeError("a fault of the program")

    with pytest.raises(PySparkException):
        Recorded(Provider("m", breaks), store).ask(asked(spark, 2), None, "s")


def books(spark):
    rows = []
    for b in range(3):
        rows += [(f"book{b}", 0, [2], "title", f"preface of book{b}", None), (f"book{b}", 1, [30], "document_index", f"Contents of book{b}", None), (f"book{b}", 2, [31], "list_item", "One 1", None)]
    rows += [("none", 0, [1], "title", "nothing here", None), ("none", 1, [160], "title", "far", None)]
    return spark.createDataFrame(rows, BLOCKS)


def book_rule(prompt):
    if prompt.startswith("Say whether"):
        found = "Contents" in prompt
        return {"document_structure": "table_of_contents" if found else "neither", "confidence": 0.9, "evidence": [{"page": 30, "text": "x"}] if found else []}
    return {"topics": [{"id": "t1", "name": "Cells", "level": 1, "source_pages": [30]}, {"id": "t2", "name": "Walls", "level": 2, "source_pages": [31]}]}


def exam_rule(prompt):
    if prompt.startswith("Find the exam papers"):
        return {"papers": [{"start_page": 1, "end_page": 9, "confidence": 1}]}
    if prompt.startswith("Read this paper"):
        return {"sections": [{"raw_label": "A", "section_type": "essay", "start_page": 1, "end_page": 9, "confidence": 1}]}
    if prompt.startswith("Extract every question"):
        found = re.findall(r"list_item\) (?:\d\. )?(.*)", prompt)
        return {"questions": [{"question_text": t, "question_type": "essay", "extraction_confidence": 1, "options": [], "section_index": 0} for t in found]}
    asked = re.findall(r"\[(\S+_q\d)\]", prompt)
    return {"classifications": [{"question_id": q, "status": "classified", "topic_id": "t1", "confidence": 0.5} for q in asked]}


COUNTED = {}


def provider():
    """The provider that the commands load."""
    return Provider("stub", COUNTED["now"])


def stopped_at_every_call(spark, tmp_path, rule, command, expected):
    """Runs a command with few calls again and again; it asks ``expected`` prompts in all, none twice."""
    count = COUNTED["now"] = Counted(tmp_path / "counted", rule)
    codes = []
    while not codes or codes[-1] == 2:
        before = count.calls()
        count.allow(max(1, expected // 3))
        codes.append(main([*command, "--provider", "tests.test_answers:provider"]))
        assert count.calls() > before
    assert codes[-1] == 0 and len(codes) > 1 and count.calls() == expected
    count.allow(0)
    assert main([*command, "--provider", "tests.test_answers:provider"]) == 0 and count.calls() == expected


def test_extract_topics_stops_and_goes_on(spark, tmp_path):
    books(spark).write.parquet(str(tmp_path / "b"))
    out = str(tmp_path / "o")
    # Two windows of each book are looked at, of the last file the first (windows without blocks cost nothing); then three lists.
    stopped_at_every_call(spark, tmp_path, book_rule, ["extract-topics", "--blocks", str(tmp_path / "b"), "--out", out], 7 + 3)
    search = spark.read.parquet(f"{out}/search")
    assert {(r["file_id"], r["start_page"]) for r in search.where("found").collect()} == {(f"book{b}", 26) for b in range(3)}
    # The last file is followed to page 150; its windows without blocks have no verdict.
    assert search.where("file_id = 'none'").count() == 6 and search.where("file_id = 'none' AND structure IS NOT NULL").count() == 1
    topics = spark.read.parquet(f"{out}/topics")
    assert {(r["forest"], r["id"], r["parent_id"]) for r in topics.collect()} == {(f"book{b}", *t) for b in range(3) for t in (("t1", None), ("t2", "t1"))}
    assert spark.read.text(f"{out}/json/evidence").count() == 12


def test_extract_and_classify_stop_and_go_on(spark, tmp_path):
    rows = [(f"{f}" * 16, i, [i + 1], "list_item", f"{i + 1}. Explain part {i} of {f}.", None) for f in range(3) for i in range(3)]
    spark.createDataFrame(rows, BLOCKS).write.parquet(str(tmp_path / "b"))
    out = str(tmp_path / "o")
    # No file has a heading, so that all three ask the same about papers: one call.
    stopped_at_every_call(spark, tmp_path, exam_rule, ["extract-questions", "--blocks", str(tmp_path / "b"), "--out", out], 1 + 3 + 3)
    assert spark.read.parquet(f"{out}/questions").count() == 9
    topics = spark.createDataFrame([("f", 0, "t1", "Cells", 1, None)], "forest string, ord long, id string, name string, level int, parent_id string")
    topics.write.parquet(str(tmp_path / "t"))
    stopped_at_every_call(spark, tmp_path / "c", exam_rule, ["classify-topics", "--topics", str(tmp_path / "t"), "--questions", f"{out}/questions", "--out", str(tmp_path / "co")], 3)
    done = spark.read.parquet(str(tmp_path / "co/questions"))
    assert done.count() == 9 and {r["topic_name"] for r in done.collect()} == {"Cells"}


def test_checks_look_at_entries():
    ok = {"question_text": "x", "question_type": "mcq", "extraction_confidence": 0.5}
    check = lambda stage, answer: stages.CHECKS[stage](answer)
    assert check("questions", {"questions": [ok]}) is None
    for wrong in ({"question_text": 3}, {"question_type": "riddle"}, {"extraction_confidence": 1.5}, {"extraction_confidence": True}, {"correction_applied": True}):
        assert check("questions", {"questions": [ok, ok | wrong]}).startswith("questions[1]")
    assert check("questions", {"questions": ["text"]}) == "questions[0] is not an object"
    verdict = {"question_id": "q", "confidence": 1}
    assert check("classify", {"classifications": [verdict | {"status": "classified", "topic_id": "t"}, verdict | {"status": "no_match"}]}) is None
    assert "contradict" in check("classify", {"classifications": [verdict | {"status": "classified"}]})
    assert "contradict" in check("classify", {"classifications": [verdict | {"status": "no_match", "topic_id": "t"}]})
    assert "fewer" in check("boundaries", {"papers": []}) and "not allowed" in check("detect", {"document_structure": "list", "confidence": 1, "evidence": []})
    assert check("structure", {"sections": [], "year": {"value": "2020", "evidence": "2020", "confidence": 1}}) is None
    assert "year" in check("structure", {"sections": [], "year": {"value": "2020", "confidence": 1}})
    assert "0 to 1" in check("detect", {"document_structure": "index", "confidence": 7, "evidence": []})


def page_reader(ocr):
    """Reads 'books' whose bytes are a name and a number of pages, and notes every page."""

    def read(content, first, last):
        name, pages, folder = content.decode().split("|")
        if name == "broken":
            raise ValueError("no such page")
        with open(f"{folder}/read-{name}", "a") as f:
            f.writelines(f"{p}\n" for p in range(first, min(last, int(pages)) + 1))
        return [(p, "document_index" if p == 30 else "section_header", f"Contents of {name}" if p == 30 else f"{name} page {p}", None) for p in range(first, min(last, int(pages)) + 1)]

    return read


page_reader.count = lambda content: int(content.decode().split("|")[1])


def test_only_pages_that_are_asked_about_are_read(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for name, pages in (("long", 809), ("short", 40), ("broken", 60)):
        (tmp_path / f"pdf/{name}.pdf").write_text(f"{name}|{pages}|{tmp_path}")
    count = COUNTED["now"] = Counted(tmp_path, book_rule)
    given = ["extract-topics", "--folder", str(tmp_path / "pdf"), "--reader", "tests.test_answers:page_reader", "--out", str(tmp_path / "o"), "--provider", "tests.test_answers:provider"]
    count.allow(2)
    assert main(given) == 2
    pages_of = lambda name: [int(x) for x in (tmp_path / f"read-{name}").read_text().split()]
    # The first windows of both books are read and asked about, then no calls are left for the second ones.
    assert pages_of("long") == [*range(1, 51)] and pages_of("short") == [*range(1, 41)]
    count.allow(100)
    assert main(given) == 0
    # Of 809 pages 50 are read, each once over both runs; four windows and two lists of topics are asked for.
    assert pages_of("long") == [*range(1, 51)] and pages_of("short") == [*range(1, 41)] and count.calls() == 6
    search = spark.read.parquet(str(tmp_path / "o/search"))
    assert {(r["start_page"], r["end_page"]) for r in search.where("found").collect()} == {(26, 50), (26, 40)}
    assert search.where("structure IS NULL").count() == 3  # the windows of the file that can't be read
    assert spark.read.parquet(str(tmp_path / "o/topics")).count() == 4


def test_a_reader_is_made_once_a_worker(spark, tmp_path):
    from tallyfold.sources import files

    def load(ocr):
        with open(f"{tmp_path}/made", "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda content: [(1, "title", content.decode(), None)]

    rows = spark.createDataFrame([(f"h{i}", bytearray(b"x")) for i in range(40)], "file_hash string, content binary").repartition(10)
    _, state = files.read_evidence(rows, load, name="one")
    assert state.where("status = 'success'").count() == 40
    made = (tmp_path / "made").read_text().split()
    assert len(made) == len(set(made))
