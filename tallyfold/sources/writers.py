"""Files out: JSON tables and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topics import tree_paths
from ..schemas import QUESTION_TYPES


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line, in folders by ``by``."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_lines(rows: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """A text in order: range-partitioned files, each sorted, whose names follow the order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def type_line(counts: dict[str, int]) -> str:
    return " | ".join(f"{label}: {counts.get(key, 0)}" for key, label in QUESTION_TYPES)


def markdown_table(rows: DataFrame, limit: int | None = None) -> str:
    """A summary as a Markdown table; meant for reports of bounded size."""
    kept = (rows.limit(limit) if limit else rows).collect()
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in kept])


def paper_markdown(questions: DataFrame) -> DataFrame:
    """paper_id and its Markdown: questions (paper_id, ord, section, question_number, question_text, options) by section."""
    number = F.coalesce(F.concat("question_number", F.lit(". ")), F.lit(""))
    options = F.transform("options", lambda o, i: F.concat(F.lit("\n  - "), F.char(F.lit(65) + i), F.lit(". "), o))
    text = F.concat(F.lit("- "), number, "question_text", F.array_join(options, ""))
    rows = questions.select("paper_id", "ord", F.coalesce("section", F.lit("")).alias("section"), text.alias("text"))
    by_section = rows.groupBy("paper_id", "section").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("q"))
    part = F.concat(F.lit("## "), "section", F.lit("\n"), F.array_join(F.transform("q", lambda x: x["text"]), "\n"))
    whole = by_section.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("s"))
    return whole.select("paper_id", F.concat(F.lit("# "), "paper_id", F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["part"]), "\n\n")).alias("markdown"))


def paper_json(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id and one JSON object: the paper's record with its questions in order (questions have paper_id, ord and their columns)."""
    fields = [c for c in questions.columns if c not in ("paper_id", "ord")]
    listed = questions.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("q"))
    record = [c for c in papers.columns]
    entry = lambda x: F.struct(*[x[c].alias(c) for c in fields])
    none = F.array().cast(f"array<struct<{','.join(f'{c}:{questions.schema[c].dataType.simpleString()}' for c in fields)}>>")
    joined = papers.join(listed, "paper_id", "left")
    return joined.select("paper_id", F.to_json(F.struct(*record, F.coalesce(F.transform("q", entry), none).alias("questions"))).alias("json"))


def topics_outputs(topics: DataFrame, issues: DataFrame, verdicts: DataFrame, path: str) -> None:
    """The topic list with its issues, and the verdicts on the pages that were searched."""
    write_json(topics, f"{path}/topics")
    write_json(issues, f"{path}/issues")
    write_json(verdicts, f"{path}/evidence")


def papers_outputs(papers: DataFrame, questions: DataFrame, files: DataFrame, path: str) -> None:
    """A JSON object and a Markdown text a paper, in folders by paper, and a summary line a file."""
    paper_json(papers, questions).write.mode("overwrite").partitionBy("paper_id").text(f"{path}/papers")
    paper_markdown(questions).write.mode("overwrite").partitionBy("paper_id").text(f"{path}/markdown")
    write_json(files, f"{path}/files")


RESIDUAL = [("no_match", "No matching topic"), ("ambiguous", "Ambiguous"), ("unclassified", "Unclassified")]


def by_topic_lines(topics: DataFrame, questions: DataFrame) -> DataFrame:
    """path, ord, line: the topic tree with each topic's questions, then those without a topic by state."""
    tree = tree_paths(topics)
    heads = tree.select("path", F.lit("").alias("ord"), F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 2, F.lit(6))), F.lit(" "), "name").alias("line"))
    line = F.concat(F.lit("- ["), "question_id", F.lit("] "), "question_text")
    sorted_ = questions.where(F.col("classification_status") == "classified").join(tree.select(F.col("id").alias("topic_id"), "path"), "topic_id").select("path", F.col("question_id").alias("ord"), line.alias("line"))
    out = heads.unionByName(sorted_)
    for i, (state, title) in enumerate(RESIDUAL):
        own = questions.where(F.col("classification_status") == state)
        rest = own.select(F.lit(f"~{i}").alias("path"), F.col("question_id").alias("ord"), line.alias("line"))
        out = out.unionByName(own.sparkSession.createDataFrame([(f"~{i}", "", f"## {title}")], "path string, ord string, line string")).unionByName(rest)
    return out


def classification_outputs(topics: DataFrame, questions: DataFrame, totals: DataFrame, path: str) -> None:
    """Totals a file, and the questions by topic as Markdown."""
    write_json(totals, f"{path}/summary")
    write_lines(by_topic_lines(topics, questions), f"{path}/by_topic", ["path", "ord"])


def dedup_outputs(canonicals: DataFrame, decisions: DataFrame, statistics: DataFrame, path: str) -> None:
    """Canonical records, the groups with several members, and the pairs that need a look."""
    write_json(canonicals, f"{path}/canonicals")
    write_json(canonicals.where(F.col("members") > 1), f"{path}/groups")
    write_json(decisions.where(F.col("verdict") == "uncertain"), f"{path}/needs_review")
    write_json(statistics, f"{path}/statistics")


def analysis_outputs(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of an analysis as JSON by its name."""
    for name, table in tables.items():
        write_json(table, f"{path}/analysis/{name}")


def frequency_report(ranking: DataFrame, types: DataFrame, integrity: DataFrame) -> str:
    parts = [("Topics", ranking), ("Question types", types), ("Data integrity", integrity)]
    return "# Frequency report\n\n" + "\n\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in parts) + "\n"


def final_report(summary: DataFrame, sections: dict[str, DataFrame], notes: list[str]) -> str:
    parts = [("Summary", markdown_table(summary))] + [(k, markdown_table(v)) for k, v in sections.items()]
    return "# Report\n\n" + "\n\n".join(f"## {k}\n\n{v}" for k, v in parts) + "\n\n## Notes\n\n" + "\n".join(f"- {n}" for n in notes) + "\n"
