"""Stages with a provider that answers by rule, listings, texts shown to it, and providers over HTTP."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tallyfold import backends
from tallyfold import providers as P
from tallyfold.operators import listings, render
from tallyfold.plans import stages
from tallyfold.sources import files, writers

BLOCKS = "file_id string, pos long, page_numbers array<int>, block_type string, text string, marker string"


def answering(rule):
    """A provider whose answer is a function of the prompt."""
    return P.Provider("stub", lambda prompt, room, attempt: json.dumps(rule(prompt)))


def blocks(spark, rows):
    return spark.createDataFrame([(f, i, [p], k, t, m) for i, (f, p, k, t, m) in enumerate(rows)], BLOCKS)


def test_contents_and_topics(spark):
    rows = [("f", 3, "document_index", "Cells 1", None), ("f", 3, "text", "prose " * 50, None), ("f", 40, "table", "Blood", None), ("f", 200, "title", "late", None)]
    def detect(prompt):
        found = "Cells" in prompt
        return {"document_structure": "table_of_contents" if found else "index", "confidence": 0.9, "evidence": [{"page": 3, "text": "Cells 1"}] if found else []}

    rows += [("g", 40, "table", "Blood", None), ("g", 60, "table", "Cells 2", None), ("g", 61, "text", "Cells prose " * 50, None)]
    search = stages.detect_contents(blocks(spark, rows), answering(detect))
    got = {(r["file_id"], r["start_page"], r["end_page"], r["structure"], r["found"]) for r in search.collect()}
    # An index without evidence is none; prose isn't shown; nothing is asked after a confident verdict.
    assert got == {("f", 1, 25, "table_of_contents", True), ("g", 1, 25, None, False), ("g", 26, 50, "neither", False), ("g", 51, 61, "table_of_contents", True)}
    assert {r["text"][:7] for r in stages.contents_blocks(blocks(spark, rows), search).collect()} == {"Cells 1", "prose p", "Cells 2", "Cells p"}
    listed = [{"id": "a", "name": "Cells", "level": 1}, {"id": "b", "name": "B l o o d c e l l", "level": 2, "source_pages": [3]}]
    topics = stages.extract_topics(blocks(spark, rows), answering(lambda p: {"topics": listed} if "Blood" not in p else {"topics": "no"}))
    assert [(r["id"], r["parent_id"], r["resolution_status"]) for r in topics.orderBy("ord").collect()] == [("a", None, "resolved"), ("b", "a", "name_unresolved")]


def test_names_are_read_near_their_page(spark):
    heads = [("f", 14 + i, "page_header", str(4 + i), None) for i in range(4)]
    rows = blocks(spark, [*heads, ("f", 17, "section_header", "7 Lipids", None), ("f", 17, "text", "prose", None)])
    schema = "forest string, ord long, id string, name string, resolution_status string, declared_page_number int"
    topics = spark.createDataFrame([("f", 0, "t7", "7", "name_unresolved", 7), ("f", 1, "t9", "9", "name_unresolved", 90), ("f", 2, "tn", "10", "name_unresolved", None), ("f", 3, "ok", "Fine", "resolved", 1)], schema)

    def names(prompt):
        assert "prose" not in prompt and "t9" not in prompt
        return {"resolutions": [{"topic_id": "t7", "status": "resolved", "name": "Lipids"}, {"topic_id": "t9", "status": "resolved", "name": "Made up"}]}

    got = {r["id"]: (r["name"], r["resolution_status"]) for r in stages.recover_names(topics, rows, answering(names)).collect()}
    assert got == {"t7": ("Lipids", "resolved"), "t9": ("9", "unidentified"), "tn": ("10", "unidentified"), "ok": ("Fine", "resolved")}


def test_papers_and_structures(spark):
    rows = blocks(spark, [("f" * 12, 1, "title", "Exam 2022", None), ("f" * 12, 2, "list_item", "9. x", None), ("f" * 12, 3, "list_item", "1. y", None)])

    def bounds(prompt):
        assert "begins anew: 3" in prompt
        return {"papers": [{"start_page": 1, "end_page": 2, "confidence": 1}, {"start_page": 2, "end_page": 9, "confidence": 1}]}

    papers = stages.detect_papers(rows, answering(bounds))
    assert [(r["paper_id"], r["start_page"], r["end_page"]) for r in papers.orderBy("start_page").collect()] == [("f" * 12 + "_p1", 1, 2), ("f" * 12 + "_p3", 3, 3)]
    owned = listings.blocks_of_papers(rows, papers)
    assert {(r["paper_id"][-1], r["pos"]) for r in owned.collect()} == {("1", 0), ("1", 1), ("3", 2)}
    said = {"year": {"value": "2022", "evidence": "Exam 2022", "source_pages": [1], "confidence": 0.9}, "sections": [{"raw_label": "A", "section_type": "mcq", "start_page": 1, "end_page": 2, "confidence": 1}]}
    read = stages.paper_structures(owned, answering(lambda p: said)).withColumn("filename", F.lit("x_2021.pdf"))
    merged = listings.merged_metadata(read)
    year = merged.first()["metadata"]["year"]
    assert (year["document_value"], year["filename_value"], year["conflict"]) == ("2022", "2021", True)
    assert merged.first()["metadata"]["exam_name"]["conflict"] is False
    value, source = listings.best_value(F.col("metadata.year"))
    assert tuple(merged.select(value, source).first()) == ("2022", "document")
    value, source = listings.best_value(F.col("metadata.date"))
    assert tuple(merged.select(value, source).first()) == (None, None)


PAPERS = f"paper_id string, start_page int, end_page int, sections array<{stages.SECTION}>"


def question(text, **more):
    return {"question_text": text, "question_type": "essay", "options": [], "source_pages": [1], "extraction_confidence": 0.9} | more


def test_cut_off_answers_are_asked_for_in_parts(spark):
    rows = [("p", 1, "list_item", "One of first", "1."), ("p", 2, "list_item", "Two of second", "1."), ("q", 1, "list_item", "First page", "1."), ("q", 2, "list_item", "Second page", "2."), ("r", 1, "list_item", "Whole", "1."), ("s", 1, "text", "Refused", None)]
    frame = blocks(spark, rows).withColumnRenamed("file_id", "paper_id")
    two = [("A", "essay", 1, 1, 1.0), ("B", "essay", 2, 2, 1.0)]
    papers = spark.createDataFrame([("p", 1, 2, two), ("q", 1, 3, []), ("r", 1, 1, []), ("s", 1, 1, [])], PAPERS)

    def complete(prompt, room, attempt):
        if "Refused" in prompt:
            raise P.classify_error(401, "no")
        for texts in (("One of first", "Two of second"), ("First page", "Second page")):
            if all(t in prompt for t in texts):
                return '{"questions": ['
        if "Second page" in prompt:
            return "nonsense}"
        return json.dumps({"questions": [question(t, section_index=0) for t in re.findall(r"1\. (\w+ \w+ \w+|First page|Whole)", prompt)]})

    got, notes = stages.extract_questions(frame, papers, P.Provider("stub", complete))
    found = {(r["paper_id"], r["chunk"], r["question_text"], r["section_index"]) for r in got.collect()}
    assert found == {("p", 0, "One of first", 0), ("p", 1, "Two of second", 1), ("q", 0, "First page", 0), ("r", 0, "Whole", 0)}
    assert {(r["paper_id"], r["note"].split(":")[0]) for r in notes.collect()} == {("q", "part 1"), ("s", "no")}
    ids = spark.createDataFrame([("p", ["s0", "s1"]), ("q", []), ("r", [])], "paper_id string, section_ids array<string>")
    numbered = {(r["question_id"], r["section_id"]) for r in stages.numbered_questions(got, ids).collect()}
    assert numbered == {("p_q1", "s0"), ("p_q2", "s1"), ("q_q1", None), ("r_q1", None)}


QUESTIONS = (
    "question_id string, paper_id string, question_number string, question_text string, question_type string, options array<string>, topic_id string, topic_name string, "
    "topic_confidence double, classification_status string"
)


def questions(spark):
    rows = [(f"q{i}", f"p{i % 2}", str(i), f"Text {i}", "mcq" if i == 0 else "essay", ["x", "y"] if i == 0 else [], None, "Old" if i == 1 else None, None, None) for i in range(4)]
    return spark.createDataFrame(rows, QUESTIONS)


TOPICS = "forest string, ord long, id string, name string, level int, parent_id string"


def topics(spark):
    return spark.createDataFrame([("f", 0, "a", "Cells", 1, None), ("f", 1, "b", "Walls", 2, "a"), ("f", 2, "c", "Blood", 1, None), ("f", 3, "d", "Pores", 3, "b")], TOPICS)


def test_texts_shown(spark):
    assert render.topic_lists(topics(spark)).first()["text"] == "- [a] Cells\n  - [b] Walls\n    - [d] Pores\n- [c] Blood"
    many = spark.createDataFrame([("f", i, f"t{i}", "n" * 300, 1, None) for i in range(100)], TOPICS)
    text = render.topic_lists(many).first()["text"]
    assert text.endswith("[topic list truncated]...") and len(text) == 20_000 + len(render.TOPICS_CUT)
    shown = {r["paper_id"]: r["text"] for r in render.question_lists(questions(spark)).collect()}
    assert shown["p0"] == "[q0] (mcq) #0\nText 0\n  A. x\n  B. y\n\n[q2] (essay) #2\nText 2\n"
    pairs = spark.createDataFrame([(0, "q0", "q1")], "batch long, a string, b string")
    assert render.pair_lists(pairs, questions(spark)).first()["text"] == "[q0::q1]\nQuestion A (q0):\ntype=mcq\ntext: Text 0\n  A. x\n  B. y\n\nQuestion B (q1):\ntype=essay\ntopic=Old\ntext: Text 1"
    papers = spark.createDataFrame([("p", 1, 2, [("A", "essay", 1, 1, 1.0), (None, "mcq", 2, 3, 1.0)]), ("q", 1, 1, [])], PAPERS)
    assert {r["t"] for r in papers.select(render.section_list(F.col("sections")).alias("t")).collect()} == {"[0] A (pages 1-1)\n[1] mcq (pages 2-3)", render.NO_SECTIONS}


def test_classification_and_judgement(spark):
    def classify(prompt):
        asked = re.findall(r"\[(q\d)\]", prompt)
        assert "- [b] Walls" in prompt
        verdicts = {"q0": ("classified", "b"), "q1": ("classified", "made_up"), "q2": ("ambiguous", None)}
        return {"classifications": [{"question_id": q, "status": verdicts[q][0], "topic_id": verdicts[q][1], "confidence": 0.8} for q in asked if q in verdicts] + [{"question_id": "q9", "status": "no_match", "confidence": 0.5}]}

    done = stages.classify_questions(questions(spark), topics(spark), answering(classify))
    got = {r["question_id"]: (r["classification_status"], r["topic_id"], r["topic_name"]) for r in done.collect()}
    assert got == {"q0": ("classified", "b", "Walls"), "q1": ("unclassified", None, None), "q2": ("ambiguous", None, None), "q3": ("unclassified", None, None)}
    pairs = spark.createDataFrame([("q0", "q1"), ("q1", "q2"), ("q2", "q3")], "a string, b string")
    said = {"verdicts": [{"pair_id": "q0::q1", "verdict": "same_question", "confidence": 0.9}, {"pair_id": "q1::q2", "verdict": "same_question", "confidence": 0.1}]}
    judged = {r["pair_id"]: r["verdict"] for r in stages.judge_pairs(pairs, questions(spark), answering(lambda p: said)).collect()}
    assert judged == {"q0::q1": "same_question", "q1::q2": "uncertain", "q2::q3": "uncertain"}
    rows = spark.createDataFrame([("q0", "Text", "a", "b"), ("q1", "Text", "a", "c")], "question_id string, question_text string, first string, second string")
    said = lambda p: {"topic_id": "b", "reason": "it is"}
    assert {r["question_id"]: r["answered"] for r in stages.adjudicate(rows, topics(spark), answering(said)).collect()} == {"q0": "b", "q1": None}


def test_answers_are_checked(spark):
    check = P.required({"topics": list}, {"topics": 2})
    assert check({"topics": [1, 2]}) is None and "more than 2" in check({"topics": [1, 2, 3]}) and "missing" in check({})
    tries = []

    def complete(prompt, room, attempt):
        tries.append(attempt)
        return "[]" if attempt == 1 else '{"topics": 3}' if attempt == 2 else '{"topics": []}'

    assert P.call(P.Provider("m", complete), "p", check) == ({"topics": []}, None, 3, False)
    answers = P.ask(spark.createDataFrame([("k", "p")], "key string, prompt string"), P.Provider("m", lambda p, r, a: '{"topics": [')  , check)
    assert answers.first()["truncated"] is True
    assert P.metrics(answers) == P.Metrics(1, 3, 1, 1)


def test_embeddings_of_new_texts_only(spark):
    wanted = spark.createDataFrame([("a", "h1", "one"), ("b", "h2", "three")], "id string, content_hash string, text string")
    cache = spark.createDataFrame([("a", "h1", "m"), ("b", "old", "m")], "id string, content_hash string, model string")
    got = P.embed_new(wanted, cache, lambda: lambda texts: [[float(len(t))] for t in texts], "m").collect()
    assert [(r["id"], r["vector"], r["model"]) for r in got] == [("b", [5.0], "m")]


def test_listings(spark):
    done = questions(spark).withColumn("classification_status", F.when(F.col("question_id") == "q0", "classified").when(F.col("question_id") == "q1", ""))
    counts = {r["paper_id"]: (r["questions"], r["classified"], r["unclassified"]) for r in listings.classification_counts(done, ["paper_id"]).collect()}
    assert counts == {"p0": (2, 1, 1), "p1": (2, 0, 2)}
    papers = spark.createDataFrame([("p0", "f", 5), ("p1", "f", 1), ("p2", "g", 1)], "paper_id string, file_id string, start_page int")
    state = spark.createDataFrame([("f", "partial"), ("g", "failed"), ("h", "success")], "file_id string, status string")
    totals = {r["file_id"]: (r["papers"], r["questions"], r["unclassified"]) for r in listings.classification_totals(done, papers, state).collect()}
    assert totals == {"f": (2, 4, 3), "h": (0, 0, 0)}
    assert {(r["paper_id"], r["question_type"], r["n"]) for r in listings.type_counts_of_papers(done).collect()} == {("p0", "mcq", 1), ("p0", "essay", 1), ("p1", "essay", 2)}
    assert [r["paper_id"] for r in listings.papers_of_file(papers, "f").collect()] == ["p1", "p0"]
    assert [r["paper_id"] for r in listings.all_papers(papers).collect()] == ["p0", "p1", "p2"]
    assert listings.paper(papers, "p2").count() == 1 and [r["question_id"] for r in listings.questions_of_paper(done, "p1").collect()] == ["q1", "q3"]
    decisions = spark.createDataFrame([("b", "c", "judge", "uncertain"), ("a", "c", "exact", "same_question"), ("a", "b", "judge", "uncertain")], "a string, b string, decision_source string, verdict string")
    assert [(r["a"], r["b"]) for r in listings.pair_decisions(decisions, "uncertain").collect()] == [("a", "b"), ("b", "c")]
    canonicals = spark.createDataFrame([("c2", "singleton", 1), ("c1", "semantic_merge", 3)], "canonical_question_id string, dedup_status string, members long")
    stats = {(r["kind"], r["name"]): r["n"] for r in listings.dedup_statistics(decisions, canonicals).collect()}
    assert stats == {("pairs", "judge:uncertain"): 2, ("pairs", "exact:same_question"): 1, ("canonicals", "singleton"): 1, ("canonicals", "semantic_merge"): 1, ("groups", "repeated"): 1}
    assert [r["canonical_question_id"] for r in listings.canonical_list(canonicals).collect()] == ["c1", "c2"]
    linked = spark.createDataFrame([("q1", "c1"), ("q0", "c1"), ("q2", "c2")], "question_id string, canonical_question_id string")
    assert [r["question_id"] for r in listings.canonical_detail(canonicals, linked, done, "c1").collect()] == ["q0", "q1"]
    ranks = spark.range(1, 10).withColumnRenamed("id", "rnk")
    assert [r["rnk"] for r in listings.leading_topics(ranks).collect()] == [1, 2, 3, 4, 5]
    stored = spark.createDataFrame([("[\"x\"]", "[1,2]", 1, None, ""), (None, None, 0, 1, "classified")], "options string, source_pages string, ambiguous int, correction_applied int, classification_status string")
    assert [tuple(r) for r in listings.decoded_questions(stored).collect()] == [(["x"], [1, 2], True, False, "unclassified"), ([], [], False, True, "classified")]


def reader(ocr):
    def read(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return [(1, "title", content.decode(), None)] + ([(2, "text", "from the image", None)] if ocr else [(2, "text", " ", None)])

    return read


def test_evidence_states(spark):
    rows = spark.createDataFrame([("h1", bytearray(b"one")), ("h2", bytearray(b"bad"))], "file_hash string, content binary")
    found, state = files.read_evidence(rows, reader)
    assert {(r["file_id"], r["block_type"]) for r in found.collect()} == {("h1", "title"), ("h1", "text")}
    assert {(r["file_id"], r["status"], r["error"]) for r in state.collect()} == {("h1", "success", None), ("h2", "failure", "unreadable")}
    _, state = files.read_evidence(rows, reader, ocr=False)
    assert {(r["file_id"], r["status"]) for r in state.collect()} == {("h1", "partial_success"), ("h2", "failure")}
    pages = {r["file_hash"]: r["pages"] for r in files.page_counts(rows, lambda c: len(c) if c != b"bad" else 1 // 0).collect()}
    assert pages == {"h1": 3, "h2": None}
    far = blocks(spark, [("f", 150, "text", "in", None), ("f", 151, "text", "out", None)])
    assert [r["text"] for r in files.index_pages(far).collect()] == ["in"]


def test_sinks(spark, tmp_path):
    papers = spark.createDataFrame([("p0", "f"), ("p9", "f")], "paper_id string, file_id string")
    own = questions(spark).select("paper_id", F.col("question_id").alias("ord"), "question_number", "question_text", "options")
    made = {r["paper_id"]: json.loads(r["json"]) for r in writers.paper_json(papers, own).collect()}
    assert [q["question_text"] for q in made["p0"]["questions"]] == ["Text 0", "Text 2"] and made["p9"]["questions"] == []
    done = questions(spark).withColumns({"classification_status": F.when(F.col("question_id") == "q3", "no_match").otherwise("classified"), "topic_id": F.when(F.col("question_id") == "q0", "d").otherwise("a")})
    lines = [r["line"] for r in writers.by_topic_lines(topics(spark), done).orderBy("path", "ord").collect()]
    assert lines[:6] == ["## Cells", "- [q1] Text 1", "- [q2] Text 2", "### Walls", "#### Pores", "- [q0] Text 0"]
    assert lines[6:] == ["## Blood", "## No matching topic", "- [q3] Text 3", "## Ambiguous", "## Unclassified"]


def test_log_records_are_scrubbed():
    import logging

    record = logging.LogRecord("x", 20, "f", 1, "key %s", ("sk-secret",), None)
    assert P.Scrub(["sk-secret", ""]).filter(record) and record.getMessage() == "key ***"


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def answer(self, status, body):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        good = self.headers.get("Authorization") == "Bearer good"
        self.answer(200 if good else 401, {} if good else {"error": {"message": "bad key"}})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body))
        if self.path == "/chat/completions":
            if body["models"][0] == "broke":
                return self.answer(402, {"error": {"message": "add credits"}})
            if body["models"][0] == "busy":
                return self.answer(429, b"x" * 900)
            return self.answer(200, {"choices": [{"message": {"content": json.dumps({"model": body["model"]})}}]})
        return self.answer(200, {"message": {"content": "{\"ok\": 1}"}})

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_hosted(service):
    assert backends.key_works(service, "good") == (True, "ok") and backends.key_works(service, "other") == (False, "bad key") and not backends.key_works(service, None)[0]
    provider = backends.hosted(service, "good", ["busy", "b", "c", "d"], title="t")
    # A busy model gives way to the next one.
    assert P.call(provider, "hello") == ({"model": "b"}, None, 2, False)
    assert [len(b["models"]) for _, b in Service.seen] == [3, 3]
    with pytest.raises(P.ProviderError) as failed:
        P.call(backends.hosted(service, "good", ["broke"]), "hello")
    assert failed.value.out_of_quota and not failed.value.retryable
    assert P.call(backends.hosted(service, None, ["b"]), "hello")[1] == "no API key"
    with pytest.raises(P.ProviderError):
        backends.hosted(service, "good", [])
    assert len(backends.error_message("y" * 900)) == 500
    assert P.call(backends.hosted("http://127.0.0.1:9", "good", ["b"], seconds=1), "x")[2] == 3


def test_local(service):
    assert P.call(backends.local(service, "m", seed=1), "hello") == ({"ok": 1}, None, 1, False)
    assert backends.unload(service, "m") is True and backends.unload("http://127.0.0.1:9", "m", 1) is False
    drops = []
    one = backends.Reloading(P.Provider("m", lambda p, r, a: "{}"), lambda: drops.append(1) or True, "reload_every_n_calls", 2)
    for _ in range(5):
        one.complete("p", 1, 1)
    assert len(drops) == 2
    two = backends.Reloading(P.Provider("m", lambda p, r, a: "{}"), lambda: drops.append(1) or True, "reload_on_failure")
    two.complete("p", 1, 1), two.complete("p", 1, 2), two.begin_paper()
    assert len(drops) == 3
    with pytest.raises(ValueError):
        backends.Reloading(one.provider, lambda: True, "sometimes")
