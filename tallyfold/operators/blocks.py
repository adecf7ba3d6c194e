"""Ordered evidence blocks: filters, page numbers, spans, option runs.

``blocks`` has file_id, pos, page_numbers, block_type, text, marker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKS_LINE, OPTION_MARKER, OPTION_PREFIX, printed_page, strip
from ..scratch import Scratch

#: Fixed values.
STRUCTURAL = ["title", "section_header", "page_header", "page_footer"]
GROUPABLE = ["list_item", "text"]
SHORT_TEXT, LOOK_BACK, LONGEST_RUN, RENDERED_CHARS, TOC_WINDOW, TOC_PAGES, TOC_CONFIDENCE = 150, 3, 6, 20_000, 25, 150, 0.6
UNASSOCIATED = "[UNASSOCIATED OPTION -- no preceding question stem was found for this]"
SUSPICIOUS = "[SUSPICIOUSLY LONG OPTION RUN -- left ungrouped rather than risk merging multiple questions]"
USABLE_TEXT_CHARS = 40


def structural(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type").isin(STRUCTURAL) | ((F.col("block_type") == "text") & (F.length("text") <= SHORT_TEXT)))


def high_signal(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type") != "text")


def best_tier(blocks: DataFrame, window: str = "file_id") -> DataFrame:
    """Of each window its document index, else its tables, else all but running text."""
    tier = F.when(F.col("block_type") == "document_index", 1).when(F.col("block_type") == "table", 2).when(F.col("block_type") != "text", 3)
    rows = blocks.withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = rows.groupBy(window).agg(F.min("tier").alias("tier"))
    return rows.join(best, [window, "tier"])


def on_pages(blocks: DataFrame, start: int | Column, end: int | Column) -> DataFrame:
    return blocks.where(F.exists("page_numbers", lambda p: (p >= start) & (p <= end)))


def numbering_resets(blocks: DataFrame) -> DataFrame:
    """file_id and page where a leading number is lower than the one before it."""
    rows = blocks.where(F.col("block_type").isin(GROUPABLE) & (F.size("page_numbers") > 0))
    rows = rows.select("file_id", "pos", F.array_min("page_numbers").alias("page"), F.regexp_extract("text", r"(?U)^\s*(\d{1,3})[.\):]", 1).alias("n"))
    rows = rows.where(F.col("n") != "").withColumn("n", F.col("n").cast("int"))
    before = F.lag("n").over(Window.partitionBy("file_id").orderBy("page", "pos"))
    return rows.withColumn("before", before).where(F.col("n") < F.col("before")).select("file_id", "page").distinct()


def _clipped(spans: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy("start_page", "end_page")
    until = F.max(F.least("end_page", "total_pages")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("before", F.coalesce(until, F.lit(0)))
    return rows.withColumns({"start": F.greatest("start_page", F.col("before") + 1), "stop": F.least("end_page", "total_pages")})


def resolve_spans(spans: DataFrame) -> DataFrame:
    """Spans (file_id, start_page, end_page, total_pages) without overlaps; gaps go to the span before them, a leading one to none."""
    kept = _clipped(spans).where(F.col("start") <= F.col("stop"))
    after = F.lead("start").over(Window.partitionBy("file_id").orderBy("start"))
    return kept.select("file_id", "start", F.coalesce(after - 1, "total_pages").alias("end"))


def span_issues(spans: DataFrame) -> DataFrame:
    """file_id, code, page: overlap_clipped at a clipped or dropped span, gap_filled and gap_unassigned at a gap's first page."""
    order = Window.partitionBy("file_id").orderBy("start_page", "end_page")
    rows = _clipped(spans).withColumn("kept", F.when(F.col("start") <= F.col("stop"), F.col("start")))
    # Starts of kept spans rise in the order of the clipping, so one sort serves both, and a row carries all its issues.
    after = F.expr("lead(kept) IGNORE NULLS OVER (PARTITION BY file_id ORDER BY start_page, end_page)")
    rows = rows.withColumns({"after": F.coalesce(after, F.col("total_pages") + 1), "earlier": F.count("kept").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    is_kept = F.col("kept").isNotNull()
    page = (F.col("stop") + 1).alias("page")
    clipped = F.when((F.col("before") > 0) & (F.col("start_page") <= F.col("before")), F.struct(F.lit("overlap_clipped").alias("code"), F.col("start_page").alias("page")))
    filled = F.when(is_kept & (F.col("after") > F.col("stop") + 1), F.struct(F.lit("gap_filled").alias("code"), page))
    leading = F.when(is_kept & (F.col("earlier") == 0) & (F.col("start") > 1), F.struct(F.lit("gap_unassigned").alias("code"), F.lit(1).cast(spans.schema["start_page"].dataType).alias("page")))
    issues = F.filter(F.array(clipped, filled, leading), lambda x: x.isNotNull())
    return rows.select("file_id", F.explode(issues).alias("i")).select("file_id", "i.code", "i.page")


def is_option(kind: Column, text: Column, marker: Column) -> Column:
    marked = strip(marker).rlike(OPTION_MARKER)
    return kind.isin(GROUPABLE) & F.when(marker.isNotNull(), marked).otherwise(text.rlike(OPTION_PREFIX))


def is_marks_line(kind: Column, text: Column) -> Column:
    return (kind == "text") & (strip(text) != "") & strip(text).rlike(MARKS_LINE)


def option_runs(blocks: DataFrame) -> DataFrame:
    """``blocks`` with option, run (its first pos), run_size and stem (pos of its stem, null without one)."""
    order = Window.partitionBy("file_id").orderBy("pos")
    kind, text = F.col("block_type"), F.col("text")
    rows = blocks.withColumn("option", is_option(kind, text, F.col("marker")))
    rows = rows.withColumn("begins", F.col("option") & ~F.coalesce(F.lag("option").over(order), F.lit(False)))
    rows = rows.withColumn("number", F.sum(F.col("begins").cast("int")).over(order))
    run = Window.partitionBy("file_id", "number", "option")
    rows = rows.withColumns(
        {"run": F.when(F.col("option"), F.min("pos").over(run)), "run_size": F.when(F.col("option"), F.count("*").over(run)).otherwise(F.lit(0))}
    )
    rows = rows.withColumns({"taken": F.col("run_size") >= 2, "stem_like": kind.isin(GROUPABLE) & ~F.col("option") & ~is_marks_line(kind, text)})
    choice, blocked = [], F.lit(False)
    for k in range(1, LOOK_BACK + 1):
        blocked = blocked | F.coalesce(F.lag("taken", k).over(order), F.lit(False))
        choice.append(F.when(~blocked & F.coalesce(F.lag("stem_like", k).over(order), F.lit(False)), F.lag("pos", k).over(order)))
    usable = F.col("begins") & (F.col("run_size") >= 2) & (F.col("run_size") <= LONGEST_RUN)
    rows = rows.withColumn("found", F.when(usable, F.coalesce(*choice)))
    return rows.withColumn("stem", F.when(F.col("option"), F.max("found").over(run))).drop("begins", "number", "taken", "stem_like", "found")


def bundle_options(blocks: DataFrame) -> DataFrame:
    """file_id, pos, page_numbers, block_type, text, marker: stems with their options as one mcq_group, other long or stemless runs tagged.

    The text of a group or a tagged option has its marker in it.
    """
    rows = option_runs(blocks).withColumn("shown", F.concat_ws(" ", F.nullif("marker", F.lit("")), "text"))
    options = rows.where(F.col("stem").isNotNull()).select("file_id", F.col("stem").alias("at"), F.col("pos").alias("opt_pos"), "shown", "page_numbers")
    grouped = options.groupBy(F.col("file_id").alias("of"), "at").agg(F.array_sort(F.collect_list(F.struct("opt_pos", "shown", "page_numbers"))).alias("o"))
    stems = rows.join(grouped, (F.col("file_id") == F.col("of")) & (F.col("pos") == F.col("at"))).select(
        "file_id",
        "pos",
        F.array_sort(F.array_distinct(F.concat("page_numbers", F.flatten(F.transform("o", lambda x: x["page_numbers"]))))).alias("page_numbers"),
        F.lit("mcq_group").alias("block_type"),
        F.concat(F.lit("STEM: "), "shown", F.lit("\n"), F.array_join(F.transform("o", lambda x: F.concat(F.lit("OPTION: "), x["shown"])), "\n")).alias("text"),
        F.lit(None).cast("string").alias("marker"),
    )
    taken = stems.select(F.col("file_id").alias("f"), F.col("pos").alias("p"))
    rest = rows.where(F.col("stem").isNull()).join(taken, (F.col("file_id") == F.col("f")) & (F.col("pos") == F.col("p")), "left_anti")
    tag = F.when(F.col("run_size") > LONGEST_RUN, F.lit(SUSPICIOUS)).when(F.col("run_size") >= 2, F.lit(UNASSOCIATED))
    text = F.when(tag.isNotNull(), F.concat_ws(" ", tag, "shown")).otherwise(F.col("text"))
    marker = F.when(tag.isNull(), F.col("marker"))
    return rest.select("file_id", "pos", "page_numbers", "block_type", text.alias("text"), marker.alias("marker")).unionByName(stems)


def page_offset(blocks: DataFrame, least: int = 3) -> DataFrame:
    """file_id and the offset of PDF pages to printed ones that most running heads agree on, the first seen among equals.

    A head votes once for each of its pages.
    """
    heads = blocks.where(F.col("block_type").isin("page_header", "page_footer"))
    pages = heads.select("file_id", "pos", printed_page(F.col("text")).alias("printed"), F.posexplode("page_numbers").alias("i", "page"))
    seen = pages.where(F.col("printed").isNotNull()).withColumn("offset", F.col("page") - F.col("printed"))
    counts = seen.groupBy("file_id", "offset").agg(F.count("*").alias("n"), F.min(F.struct("pos", "i")).alias("first"))
    best = F.max(F.struct("n", (-F.col("first.pos")).alias("p"), (-F.col("first.i")).alias("i"), "offset"))
    totals = counts.groupBy("file_id").agg(F.sum("n").alias("all"), best.alias("best"))
    enough = (F.col("all") >= least) & (F.col("best.n") >= F.greatest(F.lit(least), F.floor(F.col("all") / 2)))
    return totals.where(enough).select("file_id", F.col("best.offset").cast("int").alias("offset"))


def confirmed_page(blocks: DataFrame, expected: Column) -> DataFrame:
    """The page of the first running head that shows the expected number."""
    heads = blocks.where(F.col("block_type").isin("page_header", "page_footer") & (printed_page(F.col("text")) == expected))
    return heads.groupBy("file_id").agg(F.min_by(F.array_min("page_numbers"), "pos").alias("page"))


def toc_window(verdicts: DataFrame) -> DataFrame:
    """The first window of pages (file_id, page, structure, confidence) judged a table of contents or an index."""
    inside = verdicts.where(F.col("page") <= TOC_PAGES).withColumn("window", F.floor((F.col("page") - 1) / TOC_WINDOW))
    good = inside.where(F.col("structure").isin("table_of_contents", "index") & (F.col("confidence") >= TOC_CONFIDENCE))
    return good.groupBy("file_id").agg(F.min("window").cast("long").alias("window"))


def search_windows(blocks: DataFrame, width: int = TOC_WINDOW, most: int = TOC_PAGES) -> DataFrame:
    """file_id, window, start_page, end_page, has_blocks: the windows of pages in which each file's contents may be, in order.

    They end with the file or after ``most`` pages; windows without blocks are there too.
    """
    ends = blocks.groupBy("file_id").agg(F.least(F.max(F.array_max("page_numbers")), F.lit(most)).alias("last"))
    windows = ends.where(F.col("last") >= 1).select("file_id", "last", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / width).cast("int"))).alias("window"))
    paged = blocks.select("file_id", F.explode("page_numbers").alias("page")).where(F.col("page") <= most)
    held = paged.groupBy("file_id", F.floor((F.col("page") - 1) / width).cast("int").alias("window")).agg(F.lit(True).alias("has_blocks"))
    joined = windows.join(held, ["file_id", "window"], "left")
    last = F.least((F.col("window") + 1) * width, F.col("last"))
    return joined.select("file_id", "window", (F.col("window") * width + 1).alias("start_page"), last.alias("end_page"), F.coalesce("has_blocks", F.lit(False)).alias("has_blocks"))


def search_frontier(windows: DataFrame, judge: Callable[[DataFrame], DataFrame], least: float = TOC_CONFIDENCE) -> DataFrame:
    """The windows that were looked at, with structure, confidence and found.

    In each round the next window of every undecided file is judged (``judge`` gives
    file_id, structure, confidence of the windows it gets, and may leave some out); a
    file leaves with its first confident verdict, so that nothing behind it is asked.
    ``windows`` has file_id, window (from 0), has_blocks; those without blocks are
    passed over without a call. There are as many rounds as windows of the longest
    file, each written before the next.
    """
    scratch = Scratch(windows.sparkSession, "frontier")
    windows = scratch.keep(windows, "windows")
    rounds = windows.agg(F.max("window")).first()[0]
    looked, decided = None, None
    for number in range(0 if rounds is None else rounds + 1):
        here = windows.where(F.col("window") == number)
        if decided is not None:
            here = here.join(decided, "file_id", "left_anti")
        verdicts = scratch.keep(judge(here.where("has_blocks")), f"verdicts-{number}")
        good = F.coalesce(F.col("structure").isin("table_of_contents", "index") & (F.col("confidence") >= least), F.lit(False))
        seen = scratch.keep(here.join(verdicts, "file_id", "left").withColumn("found", good), f"looked-{number}")
        found = seen.where("found").select("file_id")
        looked = seen if looked is None else looked.unionByName(seen)
        decided = found if decided is None else decided.union(found)
    return looked if looked is not None else windows.withColumns({"structure": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "found": F.lit(False)})


def rendered(blocks: DataFrame) -> DataFrame:
    """One text per file: a line for each block in order, cut at RENDERED_CHARS."""
    pages = F.concat(F.lit("[page "), F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ","), F.lit("] ("))
    line = F.concat(pages, "block_type", F.lit(") "), F.when(F.coalesce("marker", F.lit("")) != "", F.concat("marker", F.lit(" "))).otherwise(F.lit("")), "text")
    joined = blocks.withColumn("line", line).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return joined.select("file_id", F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, RENDERED_CHARS).alias("evidence"))


def has_text_layer(pages: DataFrame, start: int, end: int) -> DataFrame:
    """file_id and whether every page start..end is there and has enough text (file_id, page, text)."""
    inside = pages.where(F.col("page").between(start, end))
    good = inside.groupBy("file_id").agg(
        F.bool_and(F.length(strip(F.coalesce("text", F.lit("")))) >= USABLE_TEXT_CHARS).alias("good"), F.countDistinct("page").alias("n")
    )
    files = pages.select("file_id").distinct()
    return files.join(good, "file_id", "left").select("file_id", F.coalesce(F.col("good") & (F.col("n") == end - start + 1), F.lit(False)).alias("has_text"))
