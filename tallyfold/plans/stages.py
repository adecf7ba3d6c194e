"""Stages that ask a provider: prompts from evidence, answers to rows.

Each stage is a table of prompts (key, prompt), asked on the executors, and a
parser of the answers. With a recorded provider
(``answers.Recorded``) a paused run asks only for what is missing. What the model says is checked
afterwards by the operators that reconcile it with what was asked.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import occurrence_ids
from ..operators import blocks as B
from ..operators import dedup, listings, reconcile, render
from ..operators import topics as T
from ..operators.intervals import points_in_spans
from ..providers import Check, Provider, ask, call, confidence, entries, every, one_of, optional_text, required, text, whole_number
from ..schemas import LIST_CAPS, QUESTION_TYPES, STATUSES
from ..scratch import Scratch
from ..sources.files import BLOCKS, EvidenceStore, PageReader, evidence_blocks

NAME_BATCH = 8
#: Batches of pairs that are told to the judge at once; a text is sent once to a tile of two slices, so a wave moves less than its prompts.
JUDGE_WAVE = 64_000
#: Texts of a slice at most, slices that pairs may be spread over beyond that need, and pairs that are worth a task.
TILE_TEXTS, MOST_SPREAD, TASK_PAIRS = 8_000, 8, 2_000
VERDICTS, ROWS_AT_ONCE = StructType().add("a", "string").add("b", "string").add("verdict", "string").add("confidence", "double"), 4_000
DETECT = "Say whether these pages hold a table of contents or an index. Answer as JSON: document_structure (table_of_contents, index or neither), confidence 0 to 1, evidence (list of page, text) taken from the pages alone."
TOPICS = "List the book's topics in order as JSON: topics, each with id, name, level from 1, source_pages, declared_page_number, resolution_status (resolved, name_unresolved or ambiguous). Keep the given wording and add nothing that is not on the pages."
BOUNDARIES = "Find the exam papers in this file. Answer as JSON: papers, each with start_page, end_page, confidence, evidence. One paper may fill the file."
STRUCTURE = "Read this paper's own details as JSON: exam_name, institution, subject, date, year, paper_identifier, each with value, evidence, source_pages, confidence (value and evidence both or neither), other_identifiers, and sections, each with raw_label, section_type, start_page, end_page, confidence."
QUESTIONS = "Extract every question as JSON: questions, each with question_number as printed or null, question_text without number and options, options (mcq only), question_type, source_pages, extraction_confidence, section_index or null, ambiguous, ambiguity_note, correction_applied, original_text. A block marked mcq_group is one question."
CLASSIFY = "Give each question below one verdict as JSON: classifications, each with question_id, status (classified, no_match or ambiguous), topic_id from the list (classified only), confidence, reason. Prefer the most specific topic that fits."
JUDGE = "Say for each pair whether one answer serves both questions, as JSON: verdicts, each with pair_id, verdict (same_question, different_question or uncertain), confidence, reason. A common topic alone makes no pair."
NAMES = "Read the heading that belongs to each expected number, as JSON: resolutions, each with topic_id, status (resolved, ambiguous or not_found), name, reason. Give only names that stand in the evidence."
ADJUDICATE = "Two topics were proposed for this question. Answer as JSON: topic_id (one of the two, or null if neither is clearly right), reason."



def _grounded(field: object) -> bool:
    """A metadata field: nothing, or value and evidence both or neither, with a confidence."""
    if field is None:
        return True
    if not isinstance(field, dict):
        return False
    held = [bool(field.get(c)) for c in ("value", "evidence")]
    return held[0] == held[1] and all(optional_text(field.get(c)) for c in ("value", "evidence")) and confidence(field.get("confidence", 0))


def _list(name: str, cap: str, rules: dict, whole=None, least: int = 0) -> Check:
    return every(required({name: list}, {name: LIST_CAPS[cap]}), entries(name, rules, whole, least))


KINDS = one_of(*[k for k, _ in QUESTION_TYPES])
PAGES = {"start_page": whole_number, "end_page": whole_number, "confidence": confidence}
CHECKS: dict[str, Check] = {
    "detect": every(
        required({"document_structure": str, "confidence": (int, float), "evidence": list}),
        lambda a: None if confidence(a["confidence"]) else "confidence is not from 0 to 1",
        lambda a: None if a["document_structure"] in ("table_of_contents", "index", "neither") else "document_structure is not allowed",
    ),
    "topics": _list("topics", "topics", {"id": text, "name": text, "level": lambda v: whole_number(v) and v >= 1, "resolution_status": one_of(None, "resolved", "name_unresolved", "ambiguous", "unidentified")}),
    "boundaries": _list("papers", "boundaries", PAGES, least=1),
    "structure": every(
        _list("sections", "sections", PAGES | {"raw_label": optional_text, "section_type": KINDS}),
        lambda a: next((f"{f}: a value needs evidence and evidence a value" for f in listings.FIELDS if not _grounded(a.get(f))), None),
    ),
    "questions": _list(
        "questions", "questions", {"question_text": text, "question_type": KINDS, "extraction_confidence": confidence},
        lambda q: not q.get("correction_applied") or bool(q.get("original_text")),
    ),
    "classify": _list(
        "classifications", "classifications", {"question_id": text, "status": one_of(*[s for s in STATUSES if s != "unclassified"]), "confidence": confidence, "topic_id": optional_text},
        lambda c: (c["status"] == "classified") == bool(c.get("topic_id")),
    ),
    "judge": _list("verdicts", "pair_verdicts", {"pair_id": text, "verdict": one_of("same_question", "different_question", "uncertain"), "confidence": confidence}),
    "names": _list("resolutions", "chapter_names", {"topic_id": text, "status": one_of("resolved", "ambiguous", "not_found"), "name": optional_text}),
    "adjudicate": required({"reason": str}),
}
FIELD = "struct<value:string,evidence:string,source_pages:array<int>,confidence:double>"
SECTION = "struct<raw_label:string,section_type:string,start_page:int,end_page:int,confidence:double>"
QUESTION = (
    "struct<question_number:string,question_text:string,options:array<string>,question_type:string,source_pages:array<int>,extraction_confidence:double,"
    "section_index:int,ambiguous:boolean,ambiguity_note:string,correction_applied:boolean,original_text:string>"
)


def _prompts(texts: DataFrame, key: str, told: str, text: Column) -> DataFrame:
    return texts.select(F.col(key).cast("string").alias("key"), F.concat(F.lit(told + "\n\n"), text).alias("prompt"))


def _listed(answers: DataFrame, key: str, field: str, entry: str) -> DataFrame:
    """Entries of the answers' lists in order: key, pos, and the entry's fields."""
    parsed = F.from_json("answer", f"struct<{field}:array<{entry}>>")[field]
    return answers.select(F.col("key").alias(key), F.posexplode(parsed).alias("pos", "e")).select(key, F.col("pos").cast("long").alias("pos"), "e.*")


def detect_contents(blocks: DataFrame, provider: Provider) -> DataFrame:
    """The windows of pages that were looked at for a table of contents or an index.

    file_id, window, start_page, end_page, has_blocks, structure, confidence, found; a
    file's search ends with its first confident verdict, and a verdict without
    evidence counts as neither. Where a call fails, structure is null and the search
    goes on.
    """
    texts = _window_texts(blocks)
    return B.search_frontier(B.search_windows(blocks), lambda windows: _judged_windows(windows, texts, provider))


def search_files(files: DataFrame, pages: DataFrame, store: EvidenceStore, load: Callable[[bool], PageReader], provider: Provider, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same search over files (file_hash, content) with their page counts (file_hash, pages), and the blocks that it read.

    In each round the pages of the windows that are asked about are read, no others;
    what the store has is not read again.
    """
    scratch = Scratch(files.sparkSession, "search")
    ends = pages.select(F.col("file_hash").alias("file_id"), F.array(F.col("pages")).alias("page_numbers"))
    windows = scratch.keep(B.search_windows(ends.where("pages > 0")).withColumn("has_blocks", F.lit(True)), "windows")
    read: list[DataFrame] = []

    def judge(asked: DataFrame) -> DataFrame:
        ranges = asked.select("file_id", "start_page", "end_page")
        blocks = scratch.keep(evidence_blocks(store.evidence(files, ranges, load, name=name)), f"blocks-{len(read)}")
        read.append(blocks)
        # A window that can't be read, or holds nothing, costs no call.
        return _judged_windows(asked.join(blocks.select("file_id").distinct(), "file_id", "left_semi"), _window_texts(blocks), provider)

    search = B.search_frontier(windows, judge)
    none = files.sparkSession.createDataFrame([], BLOCKS)
    return search, reduce(DataFrame.unionByName, read, none)


def _window_texts(blocks: DataFrame) -> DataFrame:
    """key (file and window), evidence: what is shown of each window."""
    paged = blocks.select("*", F.explode(F.array_distinct(F.transform("page_numbers", lambda p: F.floor((p - 1) / B.TOC_WINDOW).cast("int")))).alias("window"))
    shown = B.high_signal(paged).withColumn("file_id", F.concat_ws("#", "file_id", F.col("window").cast("string")))
    return B.rendered(shown).withColumnRenamed("file_id", "key")


def _judged_windows(windows: DataFrame, texts: DataFrame, provider: Provider) -> DataFrame:
    """file_id, structure, confidence of the windows whose call gave an answer."""
    said = F.from_json("answer", "struct<document_structure:string,confidence:double,evidence:array<struct<page:int,text:string>>>")
    grounded = (F.size(said["evidence"]) > 0) | (said["document_structure"] == "neither")
    keyed = windows.select("file_id", F.concat_ws("#", "file_id", F.col("window").cast("string")).alias("key"))
    asked = keyed.join(texts, "key", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    answers = ask(_prompts(asked.drop("file_id"), "key", DETECT, F.col("evidence")), provider, CHECKS["detect"], "detect")
    verdict = F.when(grounded, said["document_structure"]).otherwise("neither")
    return keyed.join(answers.where(F.col("answer").isNotNull()), "key").select("file_id", verdict.alias("structure"), said["confidence"].alias("confidence"))


def contents_blocks(blocks: DataFrame, search: DataFrame) -> DataFrame:
    """The blocks of the window in which each file's contents were found."""
    found = search.where("found").select("file_id", "start_page", "end_page")
    return points_in_spans(blocks, F.col("page_numbers"), found, "file_id", "start_page", "end_page").select(*blocks.columns)


def extract_topics(blocks: DataFrame, provider: Provider) -> DataFrame:
    """Topics of each file's contents pages, with parents, and names that can't be right marked unresolved."""
    answers = ask(_prompts(B.rendered(B.best_tier(blocks)), "file_id", TOPICS, F.col("evidence")), provider, CHECKS["topics"], "topics")
    entry = "struct<id:string,name:string,level:int,parent_id:string,source_pages:array<int>,declared_page_number:int,resolution_status:string>"
    rows = _listed(answers, "forest", "topics", entry).withColumnRenamed("pos", "ord").withColumn("resolution_status", F.coalesce("resolution_status", F.lit("resolved")))
    return T.downgrade_resolution(T.derive_parents(rows))


def recover_names(topics: DataFrame, blocks: DataFrame, provider: Provider) -> DataFrame:
    """``topics`` (forest: file) with names read where unresolved ones begin, in batches of NAME_BATCH.

    Without an offset, a declared page, or the expected number on a running head
    near it, a topic becomes unidentified; nothing is asked about it.
    """
    open_ = topics.where(F.col("resolution_status") == "name_unresolved").withColumn("file_id", F.col("forest"))
    near = listings.candidate_blocks(open_, blocks, B.page_offset(blocks))
    heads = near.join(open_.select(F.col("id").alias("topic_id"), "declared_page_number"), "topic_id").withColumn("file_id", F.col("topic_id"))
    confirmed = B.confirmed_page(heads, F.col("declared_page_number")).select(F.col("file_id").alias("id"))
    shown = B.high_signal(near.join(confirmed.withColumnRenamed("id", "topic_id"), "topic_id", "left_semi")).withColumn("file_id", F.col("topic_id"))
    named = B.rendered(shown).join(open_.select(F.col("id").alias("file_id"), "name"), "file_id")
    text = F.concat(F.lit("--- topic_id="), "file_id", F.lit(", expected: "), "name", F.lit(" ---\n"), "evidence")
    batched = dedup.batches(named.select("file_id", text.alias("told")), ["file_id"], NAME_BATCH)
    joined = batched.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "told"))), lambda x: x["told"]), "\n\n").alias("told"))
    answers = ask(_prompts(joined, "batch", NAMES, F.col("told")), provider, CHECKS["names"], "names")
    said = _listed(answers, "batch", "resolutions", "struct<topic_id:string,status:string,name:string>")
    known = said.select(F.col("topic_id").alias("id"), F.col("pos").alias("seq"), "status", F.col("name").alias("recovered")).join(confirmed, "id", "left_semi")
    found = reconcile.recovered_names(topics, known)
    lost = (F.col("resolution_status") == "name_unresolved") & F.col("seen").isNull()
    return found.join(confirmed.withColumn("seen", F.lit(True)), "id", "left").withColumn(
        "resolution_status", F.when(lost, "unidentified").otherwise(F.col("resolution_status"))
    ).drop("seen")


def detect_papers(blocks: DataFrame, provider: Provider) -> DataFrame:
    """paper_id, file_id, start_page, end_page of each file's papers: what the provider says, without overlaps and gaps."""
    resets = B.numbering_resets(blocks).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ", ").alias("resets"))
    last = blocks.groupBy("file_id").agg(F.max(F.array_max("page_numbers")).alias("total_pages"))
    texts = last.join(B.rendered(B.structural(blocks)), "file_id", "left").join(resets, "file_id", "left")
    hint = F.concat(F.lit("Pages where numbering begins anew: "), F.coalesce("resets", F.lit("none")), F.lit("\n\n"))
    answers = ask(_prompts(texts, "file_id", BOUNDARIES, F.concat(hint, F.coalesce("evidence", F.lit("")))), provider, CHECKS["boundaries"], "boundaries")
    spans = _listed(answers, "file_id", "papers", "struct<start_page:int,end_page:int,confidence:double>").join(last, "file_id")
    papers = B.resolve_spans(spans.select("file_id", "start_page", "end_page", "total_pages"))
    return papers.select(occurrence_ids(F.col("file_id"), F.col("start"), "p").alias("paper_id"), "file_id", F.col("start").alias("start_page"), F.col("end").alias("end_page"))


def paper_structures(blocks: DataFrame, provider: Provider) -> DataFrame:
    """paper_id, the metadata fields and sections of each paper (``blocks`` has paper_id)."""
    shown = blocks.withColumn("file_id", F.col("paper_id"))
    answers = ask(_prompts(B.rendered(shown), "file_id", STRUCTURE, F.col("evidence")), provider, CHECKS["structure"], "structure")
    said = F.from_json("answer", f"struct<{','.join(f'{f}:{FIELD}' for f in listings.FIELDS)},other_identifiers:array<string>,sections:array<{SECTION}>>")
    return answers.where(F.col("answer").isNotNull()).select(F.col("key").alias("paper_id"), said.alias("s")).select("paper_id", "s.*")


def chunks(papers: DataFrame) -> DataFrame:
    """paper_id, chunk, start, end, forced: by section where there are several, else by page; forced is the section's place."""
    several = F.size("sections") > 1
    section = F.transform("sections", lambda s, i: F.struct(i.alias("chunk"), s["start_page"].alias("start"), s["end_page"].alias("end"), i.alias("forced")))
    page = F.transform(F.sequence("start_page", "end_page"), lambda p, i: F.struct(i.alias("chunk"), p.alias("start"), p.alias("end"), F.lit(None).cast("int").alias("forced")))
    return papers.select("paper_id", F.explode(F.when(several, section).otherwise(page)).alias("c")).select("paper_id", "c.*")


def extract_questions(blocks: DataFrame, papers: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """Questions of each paper, and notes (paper_id, note).

    ``papers`` has paper_id, start_page, end_page, sections. A paper whose answers
    were all cut off is asked for again by section or page; what fails there is
    noted, and so is a paper of which nothing came back.
    """
    grouped = B.bundle_options(blocks.withColumn("file_id", F.col("paper_id")))
    sections = papers.select(F.col("paper_id").alias("file_id"), render.section_list(F.col("sections")).alias("told"))
    text = F.concat(F.lit("Sections:\n"), "told", F.lit("\n\n"), "evidence")
    whole = ask(_prompts(B.rendered(grouped).join(sections, "file_id"), "file_id", QUESTIONS, text), provider, CHECKS["questions"], "questions")
    scratch = Scratch(papers.sparkSession, "questions")
    # Written, so that no call is made twice.
    whole = scratch.keep(whole, "whole")
    failed = whole.where(F.col("answer").isNull())
    again = papers.join(failed.where("truncated").select(F.col("key").alias("paper_id")), "paper_id", "left_semi")
    parts = chunks(again)
    inside = F.exists("page_numbers", lambda p: (p >= F.col("start")) & (p <= F.col("end")))
    cut = grouped.withColumnRenamed("file_id", "paper_id").join(parts, "paper_id").where(inside)
    part_key = F.concat_ws("#", "paper_id", F.col("chunk").cast("string"), F.coalesce(F.col("forced").cast("string"), F.lit("")))
    # A page is shown all sections of its paper, a section itself alone.
    own = F.when(F.col("forced").isNotNull(), F.slice("sections", F.col("forced") + 1, F.lit(1))).otherwise(F.col("sections"))
    told = parts.join(papers.select("paper_id", "sections"), "paper_id").select(part_key.alias("file_id"), render.section_list(own).alias("told"))
    shown = B.rendered(cut.withColumn("file_id", part_key)).join(told, "file_id")
    smaller = scratch.keep(ask(_prompts(shown, "file_id", QUESTIONS, text), provider, CHECKS["questions"], "questions"), "smaller")
    key = F.split("paper_id", "#")
    late = _listed(smaller.where(F.col("answer").isNotNull()), "paper_id", "questions", QUESTION)
    late = late.withColumns({"chunk": key[1].cast("int"), "section_index": F.coalesce(F.nullif(key[2], F.lit("")).cast("int"), "section_index"), "paper_id": key[0]})
    first = _listed(whole.where(F.col("answer").isNotNull()), "paper_id", "questions", QUESTION).withColumn("chunk", F.lit(0))
    rows = first.unionByName(late.select(*first.columns))
    lost = failed.where("NOT truncated").select(F.col("key").alias("paper_id"), F.col("error").alias("note"))
    told = F.concat(F.lit("part "), key[1], F.lit(": "), "note")
    bad = smaller.where(F.col("answer").isNull()).select(F.col("key").alias("paper_id"), F.col("error").alias("note")).select(key[0].alias("paper_id"), told.alias("note"))
    return rows, lost.unionByName(bad)


def numbered_questions(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """``rows`` with question_id and section_id; ``papers`` has paper_id and section_ids."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk", "pos"))
    joined = rows.join(papers.select("paper_id", "section_ids"), "paper_id", "left")
    return joined.withColumns({"question_id": F.concat("paper_id", F.lit("_q"), place.cast("string")), "section_id": listings.section_id(F.col("section_ids"), F.col("section_index"))}).drop("section_ids")


def classify_questions(questions: DataFrame, topics: DataFrame, provider: Provider) -> DataFrame:
    """``questions`` with their topics: each paper's questions are asked about with the whole topic list (one forest)."""
    shown = render.topic_lists(topics).select(F.col("text").alias("topics"))
    # One row: the list is cut at TOPIC_LIST_CHARS.
    texts = render.question_lists(questions).crossJoin(F.broadcast(shown))
    answers = ask(_prompts(texts, "paper_id", CLASSIFY, F.concat(F.lit("Topics:\n"), "topics", F.lit("\n\nQuestions:\n"), "text")), provider, CHECKS["classify"], "classify")
    said = _listed(answers, "paper_id", "classifications", "struct<question_id:string,status:string,topic_id:string,confidence:double>").withColumnRenamed("pos", "seq")
    named = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"))
    return reconcile.apply_classifications(questions, reconcile.reconcile_topics(questions, named, said), named)


def _tiles(pairs: DataFrame) -> tuple[DataFrame, int, int]:
    """``pairs`` with their tile: ids are cut into slices, and a tile holds the pairs of two slices. Also the number of tiles and of pairs.

    There are as many slices as keep a tile's texts bounded, and more where pairs are
    many, so that every task has some.
    """
    ends, ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).agg(F.count("*"), F.approx_count_distinct("id")).first()
    slices = max(1, -(-ids // TILE_TEXTS), min(MOST_SPREAD, math.isqrt(ends // TASK_PAIRS)))
    a, b = (F.pmod(F.xxhash64(e), F.lit(slices)) for e in "ab")
    high, low = F.greatest(a, b), F.least(a, b)
    tile = F.floor(high * (high + 1) / 2) + low
    return pairs.select("a", "b", tile.cast("int").alias("tile")), slices * (slices + 1) // 2, ends // 2


def _verdicts(pairs: list[tuple[str, str]], answer: dict | None) -> Iterator[dict]:
    """A verdict for each pair that was asked about: the last one given, an uncertain one where there is none or a match is unsure; see ``dedup.reconcile_pairs``."""
    said = {v["pair_id"]: v for v in (answer or {}).get("verdicts", [])}
    for a, b in pairs:
        found = said.get(f"{a}::{b}", {})
        verdict, sure = found.get("verdict"), float(found.get("confidence", 0))
        unsure = verdict is None or verdict == "same_question" and sure < dedup.MERGE_FLOOR
        yield {"a": a, "b": b, "verdict": "uncertain" if unsure else verdict, "confidence": sure}


def _together(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(VERDICTS)
    while some := list(islice(rows, ROWS_AT_ONCE)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _judged(rows: DataFrame, provider: Provider) -> DataFrame:
    """VERDICTS of the pairs of sorted ``render.pair_rows``. A plain provider is asked where the prompts are made; a recorded one is given them as a table."""
    head, check = JUDGE + "\n\n", CHECKS["judge"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = render.pair_texts(batches, dedup.PAIR_BATCH, head)
        yield from _together(row for _, pairs, prompt in told for row in _verdicts(pairs, call(provider, prompt, check)[0]))

    def prompts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs, prompt in render.pair_texts(batches, dedup.PAIR_BATCH, head):
            yield pa.RecordBatch.from_pydict({"key": [json.dumps(pairs)], "prompt": [prompt]})

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((json.loads(key), json.loads(answer) if answer else None) for batch in batches for key, answer in zip(*(c.to_pylist() for c in batch.columns)))
        yield from _together(row for pairs, answer in each for row in _verdicts(pairs, answer))

    if isinstance(provider, Provider):
        return rows.mapInArrow(asked, VERDICTS)
    return ask(rows.mapInArrow(prompts, "key string, prompt string"), provider, check, "judge").select("key", "answer").mapInArrow(answered, VERDICTS)


def judged_pairs(pairs: DataFrame, questions: DataFrame, provider: Provider) -> DataFrame:
    """a, b, verdict, confidence of each of the distinct ``pairs`` (a, b), asked in batches.

    Every prompt holds the texts of its pairs, so all prompts together are as large as
    the pairs are many. They are made where they are asked: a tile of pairs goes to one
    task with each of its texts once, so what is sent grows with the texts and the
    slices, not with the pairs. Tiles go in waves of about JUDGE_WAVE batches.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "judge")
    tiled, tiles, count = _tiles(pairs)
    waves = min(tiles, max(1, -(-count // (JUDGE_WAVE * dedup.PAIR_BATCH))))
    tiled = scratch.keep(tiled, "tiled")
    ids = tiled.select(F.explode(F.array("a", "b")).alias("question_id")).distinct()
    told = scratch.keep(dedup.only_rows_of(questions, scratch.keep(ids, "ids"), "question_id").select("question_id", render.question_text().alias("told")), "told")
    tasks = max(1, min(-(-tiles // waves), count // waves // TASK_PAIRS))
    for wave in range(waves):
        here = render.pair_rows(tiled.where(F.col("tile") % waves == wave), told, "tile")
        dealt = here.repartitionById(tasks, (F.floor(F.col("tile") / waves) % tasks).cast("int")).sortWithinPartitions(*render.pair_order("tile"))
        said = scratch.keep(_judged(dealt, provider), "said", mode="append" if wave else "overwrite")
    scratch.drop("told")
    if said.count() == count:
        return said
    # Those without both texts.
    unasked = tiled.join(said, ["a", "b"], "left_anti").select("a", "b", F.lit("uncertain").alias("verdict"), F.lit(0.0).alias("confidence"))
    return said.unionByName(unasked)


def judge_pairs(pairs: DataFrame, questions: DataFrame, provider: Provider) -> DataFrame:
    """pair_id, verdict, confidence of each pair (a, b); see ``judged_pairs``."""
    distinct = Scratch(pairs.sparkSession, "pairs").keep(pairs.select("a", "b").distinct(), "distinct")
    return judged_pairs(distinct, questions, provider).select(F.concat_ws("::", "a", "b").alias("pair_id"), "verdict", "confidence")


def adjudicate(rows: DataFrame, topics: DataFrame, provider: Provider) -> DataFrame:
    """question_id, answered: one of two proposed topics (question_id, question_text, first, second), or null."""
    named = topics.select("id", "name")
    a, b = (named.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name")) for x in ("first", "second"))
    told = rows.join(a, "first").join(b, "second")
    text = F.concat(F.lit("Question: "), "question_text", F.lit("\n["), "first", F.lit("] "), "first_name", F.lit("\n["), "second", F.lit("] "), "second_name")
    answers = ask(_prompts(told, "question_id", ADJUDICATE, text), provider, CHECKS["adjudicate"], "adjudicate")
    said = answers.select(F.col("key").alias("question_id"), F.from_json("answer", "struct<topic_id:string>")["topic_id"].alias("said"))
    joined = rows.join(said, "question_id", "left")
    return joined.select("question_id", F.when(F.col("said").isin(F.col("first"), F.col("second")), F.col("said")).alias("answered"))
