"""python -m tallyfold.cli COMMAND: Parquet tables in; Parquet, JSON and Markdown out.

topics, extract-topics, extract-questions, classify-topics, deduplicate,
analyze-frequency, generate-report, analyze. Commands that ask a provider take its
module and function (``module:function`` giving a Provider) and keep every answer
in a store (``--answers``; ``answers`` in the output folder unless given). When no
calls are left a command stops with exit code 2; the next run asks exactly what has
no answer yet. run goes from the blocks of exam files and a topic list to the report,
with the state of its stages in a job table.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .answers import AnswerStore, Recorded
from .functions.text import job_id
from .operators import dedup, listings
from .operators.topics import validate
from .plans import stages
from .plans.analysis import NOTES, analyze, exact_and_judged, load_topics
from .plans.deduplication import run_deduplication
from .providers import ProviderError
from .scratch import exists
from .shipping import ship_package
from .sources import files, writers
from .sources.snapshots import Snapshots
from .sources.tables import VersionedTable

PAUSED = 2
COMMANDS = {
    "topics": ("source", "out"),
    "extract-topics": ("provider", "out"),
    "extract-questions": ("blocks", "provider", "out"),
    "classify-topics": ("topics", "questions", "provider", "out"),
    "deduplicate": ("questions", "out"),
    "analyze-frequency": ("topics", "questions", "out"),
    "generate-report": ("topics", "questions", "out"),
    "analyze": ("topics", "questions", "out"),
    "run": ("blocks", "topics", "provider", "out"),
}


def _named(name: str):
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def _provider(spark: SparkSession, given: argparse.Namespace) -> Recorded:
    return Recorded(_named(given.provider)(), AnswerStore(spark, given.answers or f"{given.out}/answers"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def topics_command(spark: SparkSession, given: argparse.Namespace) -> None:
    """Topics of a file and what is wrong with them; the lines of the file are its pages."""
    found = _kept(load_topics(spark, given.source), f"{given.out}/topics")
    if found.isEmpty():
        raise ValueError(f"no topics in {given.source}")
    columns = found.columns
    pages = F.col("source_pages") if "source_pages" in columns else F.array().cast("array<int>")
    status = F.col("resolution_status") if "resolution_status" in columns else F.lit("resolved")
    checked = found.withColumns({"source_pages": pages, "resolution_status": status})
    issues = _kept(validate(checked, given.first_page, given.last_page), f"{given.out}/issues")
    writers.topics_outputs(found, issues, spark.createDataFrame([], "file_id string, page int, structure string, confidence double"), f"{given.out}/json")


def extract_topics_command(spark: SparkSession, given: argparse.Namespace) -> None:
    """Topics of books: the search for the contents, the topics of what was found, names that were missing.

    From ``--blocks``, or from the PDFs of ``--folder`` with ``--reader module:function``
    (its ``load(ocr)`` makes a reader of page ranges, its ``count`` counts pages), of
    which only the pages that are asked about are read.
    """
    provider = _provider(spark, given)
    if given.blocks:
        blocks = spark.read.parquet(given.blocks)
        search = _kept(stages.detect_contents(blocks, provider), f"{given.out}/search")
    else:
        load, found = _named(given.reader), files.pdf_files(spark, given.folder)
        pages = _kept(files.page_counts(found, load.count), f"{given.out}/pages")
        search, blocks = stages.search_files(found, pages, files.EvidenceStore(spark, f"{given.out}/evidence"), load, provider, given.reader)
        search, blocks = _kept(search, f"{given.out}/search"), _kept(blocks, f"{given.out}/blocks")
    listed = _kept(stages.extract_topics(stages.contents_blocks(blocks, search), provider), f"{given.out}/listed")
    found = _kept(stages.recover_names(listed, blocks, provider), f"{given.out}/topics")
    issues = _kept(validate(found, given.first_page, given.last_page), f"{given.out}/issues")
    writers.topics_outputs(found, issues, search, f"{given.out}/json")


def extract_command(spark: SparkSession, given: argparse.Namespace) -> None:
    """Papers with their metadata and sections, and their questions, from blocks; ``--files`` (file_id, filename) gives the names."""
    provider, blocks = _provider(spark, given), spark.read.parquet(given.blocks)
    papers = _kept(stages.detect_papers(blocks, provider), f"{given.out}/papers")
    owned = _kept(listings.blocks_of_papers(blocks, papers), f"{given.out}/blocks")
    read = _kept(stages.paper_structures(owned, provider), f"{given.out}/structures")
    names = spark.read.parquet(given.files).select("file_id", "filename") if given.files else blocks.select("file_id", F.lit(None).cast("string").alias("filename")).distinct()
    merged = listings.merged_metadata(papers.join(read, "paper_id", "left").join(names, "file_id", "left"))
    detailed = _kept(merged.select(*papers.columns, "filename", "metadata", "other_identifiers", "sections"), f"{given.out}/detailed")
    rows, notes = stages.extract_questions(owned, detailed, provider)
    ids = F.transform(F.coalesce("sections", F.array().cast(f"array<{stages.SECTION}>")), lambda s, i: F.concat("paper_id", F.lit("_s"), i.cast("string")))
    numbered = stages.numbered_questions(rows, detailed.select("paper_id", ids.alias("section_ids")))
    years = detailed.select("paper_id", listings.best_value(F.col("metadata.year"))[0].alias("paper_year"))
    numbered = numbered.join(years, "paper_id", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    questions = _kept(numbered, f"{given.out}/questions")
    notes = _kept(notes, f"{given.out}/notes")
    counts = questions.groupBy("paper_id").agg(F.count("*").alias("questions"))
    totals = papers.join(counts, "paper_id", "left").groupBy("file_id").agg(F.count("*").alias("papers"), F.coalesce(F.sum("questions"), F.lit(0)).alias("questions"))
    order = F.struct("chunk", "pos").alias("ord")
    label = F.get("sections", F.col("section_index"))
    titled = questions.join(detailed.select("paper_id", "sections"), "paper_id", "left")
    title = F.coalesce(F.nullif(label["raw_label"], F.lit("")), label["section_type"]).alias("section")
    shown = titled.select("paper_id", order, title, "question_id", "section_id", "question_number", "question_type", "question_text", "options", "source_pages", "extraction_confidence")
    writers.papers_outputs(detailed, shown, totals, f"{given.out}/json")


def classify_command(spark: SparkSession, given: argparse.Namespace) -> None:
    """Questions with their topics."""
    topics, questions = spark.read.parquet(given.topics), spark.read.parquet(given.questions)
    for name, kind in (("classification_status", "string"), ("topic_id", "string"), ("topic_name", "string"), ("topic_confidence", "double")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    done = _kept(stages.classify_questions(questions, topics, _provider(spark, given)), f"{given.out}/questions")
    if given.papers:
        papers = spark.read.parquet(given.papers).select("paper_id", "file_id")
        totals = listings.classification_totals(done, papers, papers.select("file_id", F.lit("success").alias("status")).distinct())
    else:
        totals = listings.classification_counts(done, ["paper_id"])
    writers.classification_outputs(topics, done, totals, f"{given.out}/json")


def deduplicate_command(spark: SparkSession, given: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Canonical records and links, replaced together: from recorded verdicts, or with an embedder and a judge.

    With ``--provider`` candidates of vectors (``--embedder module:function`` makes the
    embedder) are judged; vectors and verdicts are kept in ``stores``.
    """
    questions = spark.read.parquet(given.questions)
    for name, kind in (("options", "array<string>"), ("topic_name", "string")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    if given.provider:
        questions = questions.withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
        load = _named(given.embedder) if given.embedder else None
        done = run_deduplication(questions, f"{given.out}/stores", _provider(spark, given), load, given.embedder or "")
        canonicals, links, decisions, statistics = done.canonicals, done.links, done.decisions, done.statistics
    else:
        judged = spark.read.parquet(given.decisions) if given.decisions else None
        decisions = _kept(exact_and_judged(questions, judged), f"{given.out}/decisions")
        canonicals, links = dedup.assemble_canonicals(questions, decisions)
        statistics = listings.dedup_statistics(decisions, canonicals)
    state = Snapshots(spark, f"{given.out}/state")
    state.write({"canonicals": canonicals, "links": links})
    state.drop_unnamed()
    canonicals, links = state.read("canonicals"), state.read("links")
    writers.dedup_outputs(canonicals, decisions, statistics, f"{given.out}/json")
    return canonicals, links


def analyze_command(spark: SparkSession, given: argparse.Namespace) -> None:
    """Canonical records, every table of the analysis, and the report over whole tables."""
    _report(spark, given, *deduplicate_command(spark, given))


def _report(spark: SparkSession, given: argparse.Namespace, canonicals: DataFrame, links: DataFrame) -> None:
    papers = spark.read.parquet(given.papers) if given.papers else None
    tables = analyze(spark.read.parquet(given.topics), spark.read.parquet(given.questions), canonicals, links, papers)
    written = {name: _kept(table, f"{given.out}/{name}") for name, table in tables.items()}
    if given.command != "generate-report":
        ranking = written["topics"].drop(*[c for c in written["topics"].columns if c.startswith("n_")])
        text = writers.frequency_report(ranking, written["types"], written["integrity"])
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{given.out}/frequency_report")
    if given.command != "analyze-frequency":
        writers.analysis_outputs(written, f"{given.out}/json")
        # Tables that grow with the questions are written beside the report, not into it.
        shown = {name: table for name, table in written.items() if name not in ("summary", "unclassified", "repeated")}
        text = writers.final_report(written["summary"], shown, NOTES)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{given.out}/report")


class Job:
    """The stages of a run in a table of jobs, one row a job and stage with its state; the last version of a row counts.

    A run that finds its job unfinished passes over the stages that succeeded; a
    finished job begins anew.
    """

    def __init__(self, spark: SparkSession, given: argparse.Namespace):
        self.spark, self.path = spark, f"{given.out}/jobs"
        self.table = VersionedTable(spark, self.path, ["job_id", "stage"])
        self.job_id = spark.range(1).select(job_id(F.lit("run"), F.lit(given.blocks), F.lit(given.topics))).first()[0]
        held = self.table.read().where(F.col("job_id") == self.job_id) if exists(spark, self.path) else None
        states = {r["stage"]: r["status"] for r in held.collect()} if held is not None else {}
        self.done = {s for s, state in states.items() if state == "success"} if states.get("report") != "success" else set()

    def _note(self, stage: str, status: str) -> None:
        row = self.spark.createDataFrame([(self.job_id, stage, status)], "job_id string, stage string, status string")
        self.table.upsert(row.withColumn("updated_at", F.current_timestamp()), time.time_ns())

    def stage(self, name: str, work: Callable[[], object]) -> None:
        if name in self.done:
            return
        self._note(name, "running")
        try:
            work()
        except (ProviderError, PySparkException) as failed:
            self._note(name, "paused" if _out_of_quota(failed) else "failed")
            raise
        self._note(name, "success")


def _out_of_quota(failed: Exception) -> bool:
    """An executor's error comes as text."""
    return failed.out_of_quota if isinstance(failed, ProviderError) else "out of quota" in str(failed)


def run_command(spark: SparkSession, given: argparse.Namespace) -> None:
    """From the blocks of exam files and a topic list to the report, stage by stage."""
    job, out = Job(spark, given), given.out
    part = lambda name, **more: argparse.Namespace(**(vars(given) | {"command": name, "out": f"{out}/{name}"} | more))
    asked = {"questions": f"{out}/classify-topics/questions", "papers": f"{out}/extract-questions/detailed"}
    job.stage("extract-questions", lambda: extract_command(spark, part("extract-questions")))
    job.stage("classify-topics", lambda: classify_command(spark, part("classify-topics", questions=f"{out}/extract-questions/questions", papers=asked["papers"])))
    job.stage("deduplicate", lambda: deduplicate_command(spark, part("deduplicate", **asked)))
    state = Snapshots(spark, f"{out}/deduplicate/state")
    job.stage("report", lambda: _report(spark, part("report", **asked), state.read("canonicals"), state.read("links")))


RUN = {
    "topics": topics_command,
    "extract-topics": extract_topics_command,
    "extract-questions": extract_command,
    "classify-topics": classify_command,
    "deduplicate": deduplicate_command,
    "analyze-frequency": analyze_command,
    "generate-report": analyze_command,
    "analyze": analyze_command,
    "run": run_command,
}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyfold")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        command.add_argument("--decisions", help="recorded verdicts on pairs")
        command.add_argument("--answers", help="the store of answers")
        command.add_argument("--files", help="names of files (file_id, filename)")
        command.add_argument("--papers", help="papers with their metadata")
        command.add_argument("--embedder", help="module:function that makes an embedder")
        if "blocks" not in options:
            command.add_argument("--blocks", help="blocks of files")
        command.add_argument("--folder", help="a folder of PDFs")
        command.add_argument("--reader", help="module:function that makes a reader of page ranges")
        if "provider" not in options:
            command.add_argument("--provider", help="the judge of candidate pairs")
        command.add_argument("--first-page", type=int, default=1)
        command.add_argument("--last-page", type=int, default=1_000_000)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    try:
        RUN[given.command](spark, given)
    except (ProviderError, PySparkException) as failed:
        if _out_of_quota(failed):
            return PAUSED
        raise
    return 0


if __name__ == "__main__":
    sys.exit(main())
