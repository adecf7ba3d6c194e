"""Topic forests: outlines and JSON to rows, parents, validation, page ranges.

``topics`` has forest (one list), ord (place in it), id, name, level, parent_id,
and for validation source_pages and resolution_status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMERIC_NAME, collapse, letter_spaced, strip, topic_slug
from ..scratch import Scratch
from .nearest import depths, nearest_smaller

SMALL_LIST, LARGE_LIST = 3, 500
LAST_PAGES, BOOK_OFFSET, PAD_BEFORE, PAD_AFTER, RANGE_CAP = 30, 9, 6, 4, 60
HEADING_CHARS, HEADINGS, EVIDENCE_CHARS = 120, 80, 3_500
#: Fixed value.
OUTLINE_MARKER = r"^(?:[-*•]\s+|\d+(?:\.\d+)*[.)]\s+|[A-Za-z][.)]\s+)"


def derive_parents(topics: DataFrame) -> DataFrame:
    """parent_id: the given one, else the nearest earlier topic of a lower level; level 1 has none of its own."""
    # Written once: the topics are read from several sides below.
    topics = Scratch(topics.sparkSession, "parents").keep(topics, "topics")
    above = nearest_smaller(topics, "forest", "ord", "level").where("before IS NOT NULL")
    names = topics.select(F.col("forest").alias("_g"), F.col("ord").alias("_o"), F.col("id").alias("_above"))
    found = above.join(names, (F.col("forest") == F.col("_g")) & (F.col("before") == F.col("_o"))).select("_g", F.col("ord").alias("_ord"), "_above")
    joined = topics.join(found, (F.col("forest") == F.col("_g")) & (F.col("ord") == F.col("_ord")), "left")
    kept = F.nullif(F.col("parent_id"), F.lit(""))
    return joined.withColumn("parent_id", F.coalesce(kept, F.when(F.col("level") > 1, F.col("_above")))).drop("_g", "_ord", "_above")


def slug_ids(topics: DataFrame) -> DataFrame:
    """id from the name; the n-th repeat in a forest gets _n."""
    slugged = topics.withColumn("base", topic_slug(F.col("name")))
    place = F.row_number().over(Window.partitionBy("forest", "base").orderBy("ord"))
    return slugged.withColumn("id", F.when(place == 1, F.col("base")).otherwise(F.concat_ws("_", "base", place.cast("string")))).drop("base")


def _finished(rows: DataFrame) -> DataFrame:
    named = slug_ids(rows).withColumn("parent_id", F.lit(None).cast("string"))
    return derive_parents(named).select("forest", "ord", "id", "name", "level", "parent_id")


def markdown_topics(lines: DataFrame) -> DataFrame:
    """Topics of the '#' headings among lines (forest, ord, line); other lines are notes."""
    heading = r"(?U)^(#{1,6})\s+(.*\S)\s*\z"
    found = lines.select("forest", "ord", strip(F.col("line")).alias("line")).where(F.col("line").rlike(heading))
    marks, name = F.regexp_extract("line", heading, 1), F.regexp_extract("line", heading, 2)
    return _finished(found.select("forest", "ord", strip(name).alias("name"), F.length(marks).alias("level")))


def indented_topics(lines: DataFrame) -> DataFrame:
    """Topics of an outline whose levels are its indents, list markers taken off."""
    body = F.regexp_replace("line", r"(?U)^\s+|\s+\z", "")
    rows = lines.withColumns(
        {"indent": F.length(F.regexp_extract("line", r"^[ \t]*", 0)), "name": strip(F.regexp_replace(body, OUTLINE_MARKER, ""))}
    ).where(F.col("name") != "")
    scratch = Scratch(lines.sparkSession, "outline")
    # A line belongs to the nearest line above that is less indented; its level is the length of that chain.
    rows = scratch.keep(rows.select("forest", "ord", "name", "indent"), "rows")
    above = nearest_smaller(rows, "forest", "ord", "indent").select(F.col("forest").alias("g"), F.col("ord").alias("o"), "before")
    levels = depths(above, scratch).select(F.col("g").alias("forest"), F.col("o").alias("ord"), F.col("depth").alias("level"))
    return _finished(rows.join(levels, ["forest", "ord"]).select("forest", "ord", "name", "level"))


def outline_topics(lines: DataFrame) -> DataFrame:
    """Markdown forests where any line starts with '#', indented outlines otherwise."""
    marked = lines.groupBy("forest").agg(F.bool_or(F.col("line").rlike(r"(?U)^\s*#")).alias("markdown"))
    markdown = lines.join(marked.where("markdown"), "forest", "left_semi")
    return markdown_topics(markdown).unionByName(indented_topics(lines.join(marked.where("NOT markdown"), "forest", "left_semi")))


def flat_json_topics(texts: DataFrame) -> DataFrame:
    """Topics of JSON lists of {name, level, id?, parent_id?} in texts (forest, json)."""
    parsed = F.from_json("json", "array<struct<id:string,name:string,level:string,parent_id:string>>")
    rows = texts.select("forest", F.posexplode(parsed).alias("ord", "t")).select("forest", "ord", strip(F.col("t.name")).alias("name"), F.col("t.level").cast("int").alias("level"), F.col("t.id").alias("given"), "t.parent_id")
    named = slug_ids(rows).withColumn("id", F.coalesce(F.nullif("given", F.lit("")), "id"))
    return derive_parents(named).select("forest", "ord", "id", "name", "level", "parent_id")


def nested_json_topics(texts: DataFrame) -> DataFrame:
    """Topics of JSON trees of {name, id?, children?} in preorder; the trees are opened level by level."""
    scratch = Scratch(texts.sparkSession, "trees")
    children = lambda node, path: F.expr(f"variant_get({node}, '{path}', 'array<variant>')")
    opened = texts.select("forest", F.try_parse_json("json").alias("tree")).select("forest", F.array().cast("array<int>").alias("above"), children("tree", "$").alias("nodes"))
    levels, level = None, 0
    while True:
        level += 1
        here = opened.select("forest", "above", F.posexplode("nodes").alias("place", "node"))
        name, own = (F.expr(f"variant_get(node, '$.{c}', 'string')") for c in ("name", "id"))
        here = here.select("forest", "above", F.concat("above", F.array("place")).alias("path"), strip(name).alias("name"), F.nullif(own, F.lit("")).alias("given"), F.lit(level).alias("level"), children("node", "$.children").alias("nodes"))
        here = scratch.keep(here, f"level-{level}")
        if here.limit(1).count() == 0:
            break
        rows = here.drop("nodes")
        levels = rows if levels is None else levels.unionByName(rows)
        opened = here.select("forest", F.col("path").alias("above"), "nodes")
    if levels is None:
        levels = here.drop("nodes")
    placed = levels.withColumn("ord", F.row_number().over(Window.partitionBy("forest").orderBy("path")).cast("long") - 1)
    # Slugs are counted among the topics without an id of their own.
    named = slug_ids(placed.where("given IS NULL")).unionByName(placed.where("given IS NOT NULL").withColumn("id", F.col("given")))
    named = scratch.keep(named, "named")
    parents = named.select(F.col("forest").alias("_f"), F.col("path").alias("_p"), F.col("id").alias("parent_id"))
    joined = named.join(parents, (F.col("forest") == F.col("_f")) & (F.col("above") == F.col("_p")), "left")
    return joined.select("forest", "ord", "id", "name", "level", "parent_id")


def downgrade_resolution(topics: DataFrame) -> DataFrame:
    bad = (F.col("resolution_status") == "resolved") & letter_spaced(F.col("name"))
    return topics.withColumn("resolution_status", F.when(bad, "name_unresolved").otherwise(F.col("resolution_status")))


def cycle_members(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Ids on a cycle of parent pointers, by doubling: after k rounds a pointer spans 2^k steps.

    What lies on a cycle is what is still pointed at when every pointer spans more
    steps than there are nodes.
    """
    jump = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("to")).where(F.col("to").isNotNull())
    jump = jump.join(nodes.select(F.col(id_col).alias("to")), "to", "left_semi").select("id", "to")
    rounds = max(1, jump.count()).bit_length()
    scratch = Scratch(nodes.sparkSession, "cycles")
    for step in range(rounds):
        # Written each round: the plan would double otherwise. Pointers that meet are one.
        jump = scratch.keep(_doubled(jump), f"jump-{step}")
        scratch.drop(f"jump-{step - 1}")
    return jump.select(F.col("to").alias("id")).distinct()


def validate(topics: DataFrame, low: int, high: int) -> DataFrame:
    """severity, code, topic_id of every broken rule; pages must lie in low..high.

    An id that several topics have stands for the last of them where it is a parent.
    """
    last = topics.groupBy("id").agg(F.count("*").alias("same_id"), F.max(F.struct("ord", "level", "parent_id")).alias("t"))
    last = last.select("id", "same_id", "t.level", "t.parent_id")
    parents = last.select(F.col("id").alias("pid"), F.col("level").alias("plevel"))
    rows = topics.join(parents, F.col("parent_id") == F.col("pid"), "left")
    name, parent, level = F.col("name"), F.col("parent_id"), F.col("level")
    resolved, given = F.col("resolution_status") == "resolved", parent.isNotNull()
    issue = lambda severity, code: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    of_name = (
        F.when(strip(name) == "", issue("error", "empty_name"))
        .when(resolved & name.rlike(NUMERIC_NAME), issue("error", "inconsistent_resolution_status"))
        .when(resolved & letter_spaced(name), issue("error", "inconsistent_resolution_status"))
        .when(~resolved, issue("warning", "unresolved_topic"))
    )
    of_parent = (
        F.when(given & (parent == F.col("id")), issue("error", "self_parent"))
        .when(given & F.col("pid").isNull(), issue("error", "unknown_parent"))
        .when(given & (level == 1), issue("error", "root_has_parent"))
        .when(given & (level != F.col("plevel") + 1), issue("error", "inconsistent_child_level"))
        .when(~given & (level > 1), issue("warning", "missing_parent_for_nested_level"))
    )
    of_pages = F.when(F.exists("source_pages", lambda p: (p < low) | (p > high)), issue("warning", "source_page_out_of_range"))
    each = rows.select(F.col("id").alias("topic_id"), F.explode(F.array_compact(F.array(of_name, of_parent, of_pages))).alias("i"))
    found = [each.select("i.severity", "i.code", "topic_id")]
    named = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "topic_id")
    found.append(named(last.where(F.col("same_id") > 1).select(F.col("id").alias("topic_id")), "error", "duplicate_topic_id"))
    twice = topics.groupBy(F.lower(strip(name)).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    found.append(named(twice.withColumn("topic_id", F.lit(None).cast("string")), "warning", "duplicate_topic_name"))
    found.append(named(cycle_members(last).withColumnRenamed("id", "topic_id"), "error", "parent_cycle"))
    size = topics.agg(F.count("*").alias("n")).withColumn("topic_id", F.lit(None).cast("string"))
    found.append(named(size.where(F.col("n") < SMALL_LIST), "warning", "suspiciously_small_topic_list"))
    found.append(named(size.where(F.col("n") > LARGE_LIST), "warning", "suspiciously_large_topic_list"))
    return reduce(DataFrame.unionByName, found)


def ancestors_or_self(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """Ids of ``start`` and everything above them.

    Pointers double: after k rounds all ancestors within 2**k - 1 steps are
    reached. Without pointers left nothing is above; with cycles as many rounds
    as the number of nodes has bits are enough.
    """
    scratch = Scratch(nodes.sparkSession, "ancestors")
    jump = scratch.keep(nodes.select("id", F.col("parent_id").alias("to")).where(F.col("to").isNotNull()), "jump-0")
    reached = scratch.keep(start.select("id").distinct(), "reached-0")
    for step in range(1, max(1, jump.count()).bit_length() + 1):
        up = reached.join(jump, "id").select(F.col("to").alias("id"))
        reached = scratch.keep(reached.union(up).distinct(), f"reached-{step}")
        jump = scratch.keep(_doubled(jump), f"jump-{step}")
        scratch.drop(f"jump-{step - 1}", f"reached-{step - 1}")
        if jump.isEmpty():
            break
    return reached


def _doubled(jump: DataFrame) -> DataFrame:
    return jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")).distinct()


def tested_topics(summary: DataFrame) -> DataFrame:
    """``summary`` (id, parent_id, total_occurrences) with tested: questions at the topic or below it."""
    above = ancestors_or_self(summary, summary.where(F.col("total_occurrences") > 0)).withColumn("tested", F.lit(True))
    return summary.join(above, "id", "left").withColumn("tested", F.coalesce("tested", F.lit(False)))


def page_ranges(topics: DataFrame, pages: int) -> DataFrame:
    """Book and PDF pages of each topic (forest, ord, id, page): up to the next topic's page."""
    after = Window.partitionBy("forest").orderBy("page", "ord")
    end = F.coalesce(F.lead("page").over(after) - 1, F.col("page") + LAST_PAGES)
    book = topics.withColumns({"book_start": F.col("page"), "book_end": F.greatest(end, F.col("page"))})
    start = F.greatest(F.lit(1), F.col("book_start") + BOOK_OFFSET - PAD_BEFORE)
    stop = F.least(F.lit(pages), F.col("book_end") + BOOK_OFFSET + PAD_AFTER)
    return book.withColumns({"pdf_start": start, "pdf_end": F.least(stop, start + RANGE_CAP - 1)})


def distinct_headings(blocks: DataFrame) -> DataFrame:
    """First of each heading of a topic (topic_id, pos, text), case aside, none too long, the first HEADINGS."""
    clean = blocks.withColumn("heading", collapse(F.col("text"))).where((F.col("heading") != "") & (F.length("heading") <= HEADING_CHARS))
    first = clean.withColumn("n", F.row_number().over(Window.partitionBy("topic_id", F.lower("heading")).orderBy("pos"))).where("n = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("topic_id").orderBy("pos")).cast("long")).where(F.col("n") <= HEADINGS)


def rendered_headings(blocks: DataFrame) -> DataFrame:
    kept = distinct_headings(blocks).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("n", "heading"))).alias("h"))
    return kept.select("topic_id", F.substring(F.array_join(F.transform("h", lambda x: x["heading"]), "\n"), 1, EVIDENCE_CHARS).alias("evidence"))


def tree_paths(topics: DataFrame) -> DataFrame:
    """id, name, depth and a sort path that lists every tree in preorder, children in list order.

    Paths double: each round puts the part of the path above a node's in front of
    it, until it begins at a root (a topic whose parent isn't listed). Topics on or
    below a cycle have no root and are left out.
    """
    scratch = Scratch(topics.sparkSession, "tree")
    step = F.lpad(F.col("ord").cast("string"), 12, "0")
    known = topics.select(F.col("id").alias("parent_id"), F.lit(True).alias("listed")).distinct()
    nodes = topics.join(known, "parent_id", "left").select(
        "id", "name", "ord", F.when(F.col("listed"), F.col("parent_id")).alias("above"), F.lit(0).alias("depth"), step.alias("path")
    )
    nodes = scratch.keep(nodes, "paths-0")
    for k in range(1, max(1, nodes.count()).bit_length() + 1):
        upper = nodes.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("d"), F.col("path").alias("front"))
        joined = nodes.join(upper, "above", "left")
        moved = F.col("front").isNotNull()
        nodes = scratch.keep(
            joined.select(
                "id", "name", "ord", F.col("next").alias("above"),
                F.when(moved, F.col("depth") + F.col("d") + 1).otherwise(F.col("depth")).alias("depth"),
                F.when(moved, F.concat("front", "path")).otherwise(F.col("path")).alias("path"),
            ),
            f"paths-{k}",
        )
        scratch.drop(f"paths-{k - 1}")
        if nodes.where(F.col("above").isNotNull()).isEmpty():
            break
    return nodes.where(F.col("above").isNull()).select("id", "name", "depth", "path")
