"""Queries over ordered blocks, outlines, forests, spans, versions and streams."""

from __future__ import annotations



from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks as B
from ..operators import dedup, frequency, reconcile, report
from ..operators import topics as T
from ..schemas import confidence_ok, status_ok, violations
from ..scratch import Scratch
from ..sources.files import html_headings
from ..sources.tables import file_status, latest, latest_unfinished, pending, progress
from ..streaming.ingest import run_available, stream_table
from .adapters import BLOCKS, FOREST, OCC, Q, forest, orders_by_nation, questions, table, turn_blocks
from .catalogue import query




@query(f"""WITH RECURSIVE {FOREST}, occ AS (SELECT 's' || CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment AS id FROM customer JOIN orders ON o_custkey = c_custkey),
f AS (SELECT id, parent_id FROM forest UNION ALL SELECT 'x' || CAST(r_regionkey AS VARCHAR), 'r' || CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT 'y' || CAST(r_regionkey AS VARCHAR), 'x' || CAST(r_regionkey AS VARCHAR) FROM region),
c AS (SELECT f.id AS id, f.parent_id AS parent_id, count(occ.id) AS total_occurrences FROM f LEFT JOIN occ ON occ.id = f.id GROUP BY f.id, f.parent_id),
up AS (SELECT id, parent_id FROM c WHERE total_occurrences > 0 UNION SELECT c.id, c.parent_id FROM c JOIN up ON up.parent_id = c.id)
SELECT c.id AS id, c.parent_id AS parent_id, total_occurrences, c.id IN (SELECT id FROM up) AS tested FROM c""")
def topic_tested_untested_tree(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    asked = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    region = F.col("r_regionkey").cast("string")
    # Each region has a branch of two topics that nobody asks about.
    branch = F.explode(F.array(*[F.struct(F.concat(F.lit(a), region).alias("id"), F.concat(F.lit(b), region).alias("parent_id")) for a, b in (("x", "r"), ("y", "x"))]))
    nodes = forest(spark, sf_dir).select("id", "parent_id").union(table(spark, sf_dir, "region").select(branch.alias("t")).select("t.id", "t.parent_id"))
    counts = asked.groupBy(F.concat(F.lit("s"), "c_nationkey", F.lit("_"), "c_mktsegment").alias("id")).agg(F.count("*").alias("n"))
    summary = nodes.join(counts, "id", "left").select("id", "parent_id", F.coalesce("n", F.lit(0).cast("long")).alias("total_occurrences"))
    return T.tested_topics(summary)


@query(f"WITH {FOREST} SELECT id, ord, parent_id FROM forest")
def topic_hierarchy_parents(spark, sf_dir):
    bare = forest(spark, sf_dir).withColumns({"parent_id": F.lit(None).cast("string"), "forest": F.lit("f")})
    return T.derive_parents(bare).select("id", "ord", "parent_id")


SPACED = r"""coalesce(len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: regexp_matches(w, '\p{L}'))) >= 4
  AND len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: regexp_matches(w, '\p{L}') AND length(w) <= 2 AND lower(w) NOT IN ('a','an','of','in','to','is','on','at','by','or','if','it','as','be','we')))
    > 0.4 * len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: regexp_matches(w, '\p{L}'))), FALSE)"""
DEFECTS = f"""{FOREST}, t AS (
  SELECT CASE WHEN ord % 11 = 3 THEN 'dup' ELSE id END AS id, CASE WHEN ord % 13 = 5 THEN ' ' WHEN ord % 13 = 6 THEN '12.3' WHEN ord % 13 = 7 THEN 'B i o m o l ec u l es' ELSE name END AS name,
    CASE WHEN ord % 17 = 4 THEN level + 1 ELSE level END AS level,
    CASE WHEN ord % 19 = 2 THEN NULL WHEN ord % 19 = 3 THEN 'nowhere' WHEN ord % 19 = 4 THEN id ELSE parent_id END AS parent_id,
    ord, ord % 40 AS page, CASE WHEN ord % 7 = 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution_status FROM forest),
last AS (SELECT id, level, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS i FROM t) AS x WHERE i = 1),
par AS (SELECT id AS pid, level AS plevel FROM last),
j AS (SELECT *, SPACED AS spaced FROM t LEFT JOIN par ON pid = parent_id),
walk AS (SELECT id AS origin, parent_id AS cur, 1 AS n FROM last WHERE parent_id IS NOT NULL UNION SELECT walk.origin, last.parent_id, walk.n + 1 FROM walk JOIN last ON last.id = walk.cur WHERE last.parent_id IS NOT NULL AND walk.n < 6)""".replace("SPACED", SPACED)


@query(rf"""WITH RECURSIVE {DEFECTS}, issues AS (
  SELECT CASE WHEN trim(name) = '' THEN 'error' WHEN resolution_status = 'resolved' AND (regexp_matches(name, '^[\d\s.\-]+$') OR spaced) THEN 'error' WHEN resolution_status <> 'resolved' THEN 'warning' END AS severity,
    CASE WHEN trim(name) = '' THEN 'empty_name' WHEN resolution_status = 'resolved' AND (regexp_matches(name, '^[\d\s.\-]+$') OR spaced) THEN 'inconsistent_resolution_status' WHEN resolution_status <> 'resolved' THEN 'unresolved_topic' END AS code, id AS topic_id FROM j
  UNION ALL SELECT CASE WHEN parent_id IS NULL THEN CASE WHEN level > 1 THEN 'warning' END WHEN parent_id = id OR pid IS NULL OR level = 1 OR level <> plevel + 1 THEN 'error' END,
    CASE WHEN parent_id IS NULL THEN CASE WHEN level > 1 THEN 'missing_parent_for_nested_level' END WHEN parent_id = id THEN 'self_parent' WHEN pid IS NULL THEN 'unknown_parent' WHEN level = 1 THEN 'root_has_parent' WHEN level <> plevel + 1 THEN 'inconsistent_child_level' END, id FROM j
  UNION ALL SELECT 'warning', 'source_page_out_of_range', id FROM j WHERE page < 2 OR page > 36
  UNION ALL SELECT 'error', 'duplicate_topic_id', id FROM t GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'warning', 'duplicate_topic_name', NULL FROM t GROUP BY lower(trim(name)) HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'error', 'parent_cycle', origin FROM walk WHERE cur = origin)
SELECT severity, code, topic_id FROM issues WHERE code IS NOT NULL""")
def topic_validate_issues(spark, sf_dir):
    o = F.col("ord")
    rows = forest(spark, sf_dir)
    parent = F.when(o % 19 == 2, None).when(o % 19 == 3, "nowhere").when(o % 19 == 4, F.col("id")).otherwise(F.col("parent_id"))
    bad = rows.select(
        F.when(o % 11 == 3, "dup").otherwise(F.col("id")).alias("id"),
        F.when(o % 13 == 5, " ").when(o % 13 == 6, "12.3").when(o % 13 == 7, "B i o m o l ec u l es").otherwise(F.col("name")).alias("name"),
        F.when(o % 17 == 4, F.col("level") + 1).otherwise(F.col("level")).alias("level"),
        parent.alias("parent_id"),
        "ord",
        F.array((o % 40).cast("int")).alias("source_pages"),
        F.when(o % 7 == 1, "ambiguous").otherwise("resolved").alias("resolution_status"),
    )
    return T.validate(bad, 2, 36)


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS parent_id FROM part),
w AS (SELECT id AS origin, parent_id AS cur, 1 AS n FROM t WHERE id <= 50 AND parent_id IS NOT NULL UNION SELECT w.origin, t.parent_id, w.n + 1 FROM w JOIN t ON t.id = w.cur WHERE t.parent_id IS NOT NULL AND w.n < 52)
SELECT DISTINCT origin AS id FROM w WHERE cur = origin""")
def topic_cycles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return T.cycle_members(part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_size").cast("long")).alias("parent_id")))


LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query(rf"""WITH {LINES}, n AS (SELECT doc_id, pos, CAST(pos % 30 + 1 AS VARCHAR) || '. ' || line AS line FROM lines WHERE pos % 3 = 0 UNION ALL SELECT doc_id, pos, line FROM lines WHERE pos % 3 <> 0)
SELECT doc_id, pos, nullif(regexp_extract(line, '^\s*(\d{{1,3}}[a-zA-Z]?)[.\):]\s+', 1), '') AS number, sha256(regexp_replace(line, '^\s*(\d{{1,3}}[a-zA-Z]?)[.\):]\s+', '')) AS rest FROM n""")
def leading_number(spark, sf_dir):
    line = F.when(F.col("pos") % 3 == 0, F.concat((F.col("pos") % 30 + 1).cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line"))
    number, rest = X.leading_number(F.col("line"))
    return _lines(spark, sf_dir).withColumn("line", line).select("doc_id", "pos", number.alias("number"), F.sha2(rest, 256).alias("rest"))


NUMBERED = f"""{BLOCKS}, nb AS (SELECT file_id, pos, page, block_type, CAST((CAST(file_id AS BIGINT) + pos * 5) % 7 + 1 AS VARCHAR) || '. ' || text AS text FROM blocks)"""


def _numbered(spark, sf_dir):
    number = (F.col("file_id").cast("long") + F.col("pos") * 5) % 7 + 1
    return turn_blocks(spark, sf_dir).withColumn("text", F.concat(number.cast("string"), F.lit(". "), "text"))


@query(rf"""WITH {NUMBERED}, r AS (SELECT file_id, page, pos, CAST(regexp_extract(text, '^\s*(\d{{1,3}})[.\):]', 1) AS INTEGER) AS n FROM nb WHERE block_type IN ('list_item', 'text')),
l AS (SELECT *, lag(n) OVER (PARTITION BY file_id ORDER BY page, pos) AS b FROM r)
SELECT DISTINCT file_id, CAST(page AS INTEGER) AS page FROM l WHERE n < b""")
def numbering_resets(spark, sf_dir):
    return B.numbering_resets(_numbered(spark, sf_dir))


SPANS = """sp AS (SELECT l_orderkey AS file_id, CAST(l_suppkey % 20 + 1 AS INTEGER) AS start_page, CAST(l_suppkey % 20 + 1 + l_partkey % 7 AS INTEGER) AS end_page, 24 AS total_pages FROM lineitem),
w AS (SELECT *, coalesce(max(least(end_page, total_pages)) OVER (PARTITION BY file_id ORDER BY start_page, end_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sp),
c AS (SELECT *, greatest(start_page, before + 1) AS s, least(end_page, total_pages) AS e FROM w), k AS (SELECT * FROM c WHERE s <= e)"""


def _spans(spark, sf_dir):
    start = (F.col("l_suppkey") % 20 + 1).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), start.alias("start_page"), (start + F.col("l_partkey") % 7).cast("int").alias("end_page"), F.lit(24).alias("total_pages"))


@query(f'WITH {SPANS} SELECT file_id, s AS start, coalesce(lead(s) OVER (PARTITION BY file_id ORDER BY s) - 1, total_pages) AS "end" FROM k')
def span_resolve(spark, sf_dir):
    return B.resolve_spans(_spans(spark, sf_dir))


@query(f"""WITH {SPANS}, n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY file_id ORDER BY s), total_pages + 1) AS nxt, row_number() OVER (PARTITION BY file_id ORDER BY s) AS i FROM k)
SELECT file_id, 'overlap_clipped' AS code, start_page AS page FROM c WHERE before > 0 AND start_page <= before
UNION ALL SELECT file_id, 'gap_filled', e + 1 FROM n WHERE nxt > e + 1 UNION ALL SELECT file_id, 'gap_unassigned', 1 FROM n WHERE i = 1 AND s > 1""")
def span_issues(spark, sf_dir):
    return B.span_issues(_spans(spark, sf_dir))


RUNS = rf"""{BLOCKS}, o AS (SELECT *, block_type IN ('list_item', 'text') AND CASE WHEN marker IS NOT NULL THEN regexp_matches(marker, '^\(?([A-Da-d]|[ivx]{{1,4}})\)?[.\):]?$')
    ELSE regexp_matches(text, '^\s*\(?([A-Da-d]|[ivx]{{1,4}})\)?[.\):]\s*\S') END AS option FROM blocks),
b AS (SELECT *, option AND NOT coalesce(lag(option) OVER (PARTITION BY file_id ORDER BY pos), FALSE) AS begins FROM o),
g AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS number FROM b),
rn AS (SELECT *, CASE WHEN option THEN min(pos) OVER (PARTITION BY file_id, number, option) END AS run, CASE WHEN option THEN count(*) OVER (PARTITION BY file_id, number, option) ELSE 0 END AS run_size FROM g)"""


@query(f"WITH {RUNS} SELECT file_id, pos, option, run, run_size FROM rn")
def option_runs(spark, sf_dir):
    return B.option_runs(turn_blocks(spark, sf_dir)).select("file_id", "pos", "option", "run", F.col("run_size").cast("long").alias("run_size"))


@query(rf"""WITH {RUNS}, s AS (
  SELECT *, run_size >= 2 AS taken, coalesce(marker || ' ', '') || text AS shown,
    block_type IN ('list_item', 'text') AND NOT option AND NOT (block_type = 'text' AND regexp_matches(text, '\S') AND regexp_full_match(text, '[\s\d xX+\-=./,\[\]()]+')) AS stem_like FROM rn),
k AS (SELECT *, lag(taken, 1, FALSE) OVER o AS t1, lag(taken, 2, FALSE) OVER o AS t2, lag(taken, 3, FALSE) OVER o AS t3, lag(pos, 1) OVER o AS q1, lag(pos, 2) OVER o AS q2, lag(pos, 3) OVER o AS q3,
    lag(stem_like, 1, FALSE) OVER o AS l1, lag(stem_like, 2, FALSE) OVER o AS l2, lag(stem_like, 3, FALSE) OVER o AS l3 FROM s WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
f AS (SELECT *, CASE WHEN begins AND run_size BETWEEN 2 AND 6 THEN CASE WHEN t1 THEN NULL WHEN l1 THEN q1 WHEN t2 THEN NULL WHEN l2 THEN q2 WHEN t3 THEN NULL WHEN l3 THEN q3 END END AS found FROM k),
st AS (SELECT *, CASE WHEN option THEN max(found) OVER (PARTITION BY file_id, run) END AS stem FROM f),
gr AS (SELECT file_id, stem AS at, string_agg('OPTION: ' || shown, chr(10) ORDER BY pos) AS listed, list(page) AS pages FROM st WHERE stem IS NOT NULL GROUP BY file_id, stem)
SELECT st.file_id AS file_id, st.pos AS pos, array_to_string(list_sort(list_distinct(list_append(gr.pages, st.page))), ',') AS pages, 'mcq_group' AS block_type, sha256('STEM: ' || shown || chr(10) || listed) AS text_sha256
FROM st JOIN gr ON gr.file_id = st.file_id AND gr.at = st.pos
UNION ALL SELECT file_id, pos, CAST(page AS VARCHAR), block_type, sha256(CASE
  WHEN run_size > 6 THEN '[SUSPICIOUSLY LONG OPTION RUN -- left ungrouped rather than risk merging multiple questions] ' || shown
  WHEN run_size >= 2 THEN '[UNASSOCIATED OPTION -- no preceding question stem was found for this] ' || shown ELSE text END)
FROM st WHERE stem IS NULL AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.file_id = st.file_id AND gr.at = st.pos)""")
def mcq_bundle(spark, sf_dir):
    rows = B.bundle_options(turn_blocks(spark, sf_dir))
    return rows.select("file_id", "pos", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"), "block_type", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {BLOCKS} SELECT file_id, sha256(substr(string_agg('[page ' || CAST(page AS VARCHAR) || '] (' || block_type || ') ' || CASE WHEN marker IS NULL THEN '' ELSE marker || ' ' END || text, chr(10) ORDER BY pos), 1, 20000)) AS evidence_sha256
FROM blocks GROUP BY file_id""")
def evidence_render(spark, sf_dir):
    return B.rendered(turn_blocks(spark, sf_dir)).select("file_id", F.sha2("evidence", 256).alias("evidence_sha256"))


@query(f"WITH {BLOCKS} SELECT file_id, pos FROM blocks WHERE page BETWEEN 2 AND 3")
def slice_pages(spark, sf_dir):
    return B.on_pages(turn_blocks(spark, sf_dir), 2, 3).select("file_id", "pos")


@query(f"""WITH {BLOCKS}, t AS (SELECT file_id, pos, CASE block_type WHEN 'document_index' THEN 1 WHEN 'table' THEN 2 WHEN 'text' THEN NULL ELSE 3 END AS tier FROM blocks)
SELECT file_id, pos, tier FROM (SELECT *, min(tier) OVER (PARTITION BY file_id) AS best FROM t) AS x WHERE tier = best""")
def evidence_tier(spark, sf_dir):
    return B.best_tier(turn_blocks(spark, sf_dir)).select("file_id", "pos", "tier")


@query(f"WITH {BLOCKS} SELECT file_id, pos FROM blocks WHERE block_type IN ('title', 'section_header', 'page_header', 'page_footer') OR (block_type = 'text' AND length(text) <= 150)")
def structural_blocks(spark, sf_dir):
    return B.structural(turn_blocks(spark, sf_dir)).select("file_id", "pos")


HEADS = """h0 AS (SELECT l_orderkey AS file_id, l_linenumber AS pos, l_partkey % 5 AS form, l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS number FROM lineitem),
h AS (SELECT file_id, pos, number, CASE WHEN pos % 4 = 2 THEN [pos + 9, pos + 10] ELSE [pos + 9] END AS pages, form = 0 AS roman FROM h0)"""


def _heads(spark, sf_dir):
    number = F.col("l_linenumber") + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)
    # Roman, bare, and in brackets with and without blanks.
    form = F.col("l_partkey") % 5
    text = F.when(form == 0, "iv").when(form == 1, number.cast("string")).when(form == 2, F.format_string("[%d]", number)).when(form == 3, F.format_string("( %d )", number)).otherwise(F.format_string(" [ %d ] ", number))
    page = (F.col("l_linenumber") + 9).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 4 == 2, F.array(page, page + 1)).otherwise(F.array(page)).alias("page_numbers"), F.lit("page_header").alias("block_type"), text.alias("text")
    )


@query(rf"""WITH {HEADS}, n AS (SELECT file_id, pos, unnest(pages) - number AS "offset", unnest(range(len(pages))) AS i FROM h WHERE NOT roman),
c AS (SELECT file_id, "offset", count(*) AS k, min(pos * 10 + i) AS f FROM n GROUP BY file_id, "offset"),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY k DESC, f, "offset" DESC) AS i, sum(k) OVER (PARTITION BY file_id) AS total FROM c)
SELECT file_id, CAST("offset" AS INTEGER) AS "offset" FROM r WHERE i = 1 AND total >= 3 AND k >= greatest(3, total // 2)""")
def page_offset_mode(spark, sf_dir):
    return B.page_offset(_heads(spark, sf_dir))


@query(f"WITH {HEADS} SELECT DISTINCT file_id, CAST(pages[1] AS INTEGER) AS page FROM (SELECT *, rank() OVER (PARTITION BY file_id ORDER BY pos) AS i FROM h WHERE NOT roman AND number = 3) AS x WHERE i = 1")
def page_confirm(spark, sf_dir):
    return B.confirmed_page(_heads(spark, sf_dir), F.lit(3))


@query("""WITH n AS (SELECT p_brand AS forest, p_partkey AS ord, p_size AS page, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nxt FROM part),
b AS (SELECT *, greatest(coalesce(nxt - 1, page + 30), page) AS book_end, greatest(1, page + 9 - 6) AS pdf_start FROM n)
SELECT forest, ord, page AS book_start, book_end, pdf_start, least(least(70, book_end + 9 + 4), pdf_start + 60 - 1) AS pdf_end FROM b""")
def topic_page_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("forest"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("page"))
    return T.page_ranges(rows, 70).select("forest", "ord", "book_start", "book_end", "pdf_start", "pdf_end")


@query("""WITH h AS (SELECT p_type AS topic_id, p_partkey AS pos, p_name AS heading FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY topic_id, lower(heading) ORDER BY pos) AS k FROM h),
n AS (SELECT topic_id, heading, row_number() OVER (PARTITION BY topic_id ORDER BY pos) AS n FROM f WHERE k = 1)
SELECT topic_id, heading, n FROM n WHERE n <= 80""")
def heading_dedupe_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("topic_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"))
    return T.distinct_headings(rows).select("topic_id", "heading", "n")


@query(r"""WITH h AS (SELECT CAST(page_id AS VARCHAR) AS forest, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)) AS l, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS t,
    unnest(range(len(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)))) AS ord FROM pages),
n AS (SELECT forest, ord, CAST(l AS INTEGER) AS level, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS name FROM h),
b AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'topic') AS base FROM n WHERE name <> ''),
i AS (SELECT *, row_number() OVER (PARTITION BY forest, base ORDER BY ord) AS k FROM b),
s AS (SELECT forest, ord, level, name, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS id FROM i)
SELECT forest, ord, id, name, level, CASE level
  WHEN 2 THEN last_value(CASE WHEN level <= 1 THEN id END IGNORE NULLS) OVER w WHEN 3 THEN last_value(CASE WHEN level <= 2 THEN id END IGNORE NULLS) OVER w
  WHEN 4 THEN last_value(CASE WHEN level <= 3 THEN id END IGNORE NULLS) OVER w WHEN 5 THEN last_value(CASE WHEN level <= 4 THEN id END IGNORE NULLS) OVER w
  WHEN 6 THEN last_value(CASE WHEN level <= 5 THEN id END IGNORE NULLS) OVER w END AS parent_id
FROM s WINDOW w AS (PARTITION BY forest ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def outline_markdown(spark, sf_dir):
    return T.outline_topics(html_headings(table(spark, sf_dir, "pages")))


SLUGS = """s0 AS (SELECT p_brand AS forest, p_partkey AS ord, p_name AS name, length(p_type) % 3 * 2 AS indent,
  coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'topic') AS base FROM part),
s1 AS (SELECT *, row_number() OVER (PARTITION BY forest, base ORDER BY ord) AS k FROM s0),
sl AS (SELECT forest, ord, name, indent, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS id FROM s1)"""


@query(f"WITH {SLUGS} SELECT forest, ord, id FROM sl")
def slug_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("forest"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return T.slug_ids(rows).select("forest", "ord", "id")


@query(f"""WITH {SLUGS}, p AS (
  SELECT *, max(CASE WHEN indent = 0 THEN ord END) OVER before AS p0, max(CASE WHEN indent = 2 THEN ord END) OVER before AS p2 FROM sl
  WINDOW before AS (PARTITION BY forest ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT forest, ord, id, name, CASE WHEN indent = 0 THEN 1 WHEN indent = 2 THEN CASE WHEN p0 IS NULL THEN 1 ELSE 2 END
    WHEN p0 IS NULL AND p2 IS NULL THEN 1 WHEN p2 IS NULL OR p0 > p2 OR p0 IS NULL THEN 2 ELSE 3 END AS level FROM p)
SELECT forest, ord, id, name, CAST(level AS INTEGER) AS level, CASE level WHEN 2 THEN last_value(CASE WHEN level <= 1 THEN id END IGNORE NULLS) OVER w WHEN 3 THEN last_value(CASE WHEN level <= 2 THEN id END IGNORE NULLS) OVER w END AS parent_id
FROM l WINDOW w AS (PARTITION BY forest ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def outline_indent(spark, sf_dir):
    indent = F.repeat(F.lit(" "), (F.length("p_type") % 3 * 2).cast("int"))
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("forest"), F.col("p_partkey").alias("ord"), F.concat(indent, F.lit("- "), "p_name").alias("line"))
    return T.outline_topics(lines)


@query("""WITH l AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name FROM nation)
SELECT CAST(r AS VARCHAR) AS forest, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS ord, lower(name) AS id, name, CASE WHEN k = (SELECT min(k) FROM l m WHERE m.r = l.r) THEN 1 ELSE 2 END AS level,
 CASE WHEN k = (SELECT min(k) FROM l m WHERE m.r = l.r) THEN NULL ELSE (SELECT lower(m.name) FROM l m WHERE m.r = l.r ORDER BY m.k LIMIT 1) END AS parent_id FROM l""")
def json_flat_topics(spark, sf_dir):
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    entry = F.struct("i", F.struct(F.col("n_name").alias("name"), F.when(F.col("i") == 1, 1).otherwise(2).alias("level")).alias("t"))
    texts = nation.groupBy(F.col("n_regionkey").cast("string").alias("forest")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"])).alias("json"))
    return T.flat_json_topics(texts).withColumn("ord", F.col("ord").cast("long"))


@query("""WITH r AS (SELECT r_regionkey AS k, r_name AS name, lower(replace(r_name, ' ', '_')) AS id FROM region),
t AS (SELECT name AS region, 0 AS child, name, id, 1 AS level, CAST(NULL AS VARCHAR) AS parent_id FROM r WHERE k IN (SELECT n_regionkey FROM nation)
  UNION ALL SELECT r.name, 1, n_name, lower(replace(n_name, ' ', '_')), 2, r.id FROM nation JOIN r ON k = n_regionkey)
SELECT 'world' AS forest, row_number() OVER (ORDER BY region, child, name) - 1 AS ord, id, name, level, parent_id FROM t""")
def json_nested_topics(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    children = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name")))).alias("children"))
    tree = region.join(children, F.col("r_regionkey") == F.col("n_regionkey")).select(F.struct(F.col("r_name").alias("name"), "children").alias("t"))
    texts = tree.agg(F.to_json(F.array_sort(F.collect_list("t"))).alias("json")).select(F.lit("world").alias("forest"), "json")
    return T.nested_json_topics(texts)


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda t: regexp_matches(t, '\p{L}')) AS a FROM documents)
SELECT doc_id, len(a) >= 4 AND len(list_filter(a, lambda t: length(t) <= 2 AND lower(t) NOT IN ('a','an','of','in','to','is','on','at','by','or','if','it','as','be','we'))) > 0.4 * len(a) AS letter_spaced FROM w""")
def letter_spaced(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.letter_spaced(F.col("text")).alias("letter_spaced"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS batch FROM documents")
def chunk_batches(spark, sf_dir):
    return dedup.batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("""WITH w AS (SELECT doc_id AS id, sha256(text) AS content_hash FROM documents), c AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 3 = 0)
SELECT w.id AS id, w.content_hash AS content_hash FROM w LEFT JOIN c ON c.id = w.id AND c.content_hash = w.content_hash WHERE c.id IS NULL""")
def embedding_cache_delta(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    cache = wanted.where(F.col("id") % 3 == 0).withColumn("content_hash", F.when(F.col("id") % 5 == 0, "stale").otherwise(F.col("content_hash")))
    return dedup.to_be_embedded(wanted, cache)


@query("SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE NOT (doc_id % 4 = 0)")
def verdict_cache_antijoin(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    model = F.when(F.col("a") % 4 == 0, "judge-1").otherwise("judge-0").alias("model_used")
    return dedup.not_yet_judged(pairs, pairs.where(F.col("a") % 2 == 0).select("a", "b", model), "judge-1")


@query("""SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) AS x WHERE n = 1""")
def upsert_latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id AS job_id, event_type AS status, ts AS updated_at FROM events WHERE event_type <> 'click' ORDER BY ts DESC, event_id DESC LIMIT 1")
def job_latest_unfinished(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "completed").otherwise(F.col("event_type"))
    return latest_unfinished(table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("updated_at")))


MANIFEST = "m AS (SELECT user_id AS file_id, CASE WHEN max(event_id) % 3 = 0 THEN 'success' WHEN max(event_id) % 3 = 1 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY user_id)"


def _manifest(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id")).agg(F.max("event_id").alias("e"))
    return last.select("file_id", F.when(F.col("e") % 3 == 0, "success").when(F.col("e") % 3 == 1, "partial").otherwise("failed").alias("status"))


@query(f"WITH {MANIFEST} SELECT count(*) FILTER (WHERE status = 'success') AS done, count(*) AS total FROM customer LEFT JOIN m ON file_id = c_custkey")
def job_progress(spark, sf_dir):
    return progress(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id")), _manifest(spark, sf_dir), "file_id")


@query(f"WITH {MANIFEST} SELECT c_custkey AS file_id FROM customer WHERE c_custkey NOT IN (SELECT file_id FROM m WHERE status = 'success')")
def resume_pending(spark, sf_dir):
    return pending(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id")), _manifest(spark, sf_dir), "file_id")


@query("""SELECT c_custkey AS file_id, count(o_orderkey) AS papers, CASE WHEN count(o_orderkey) = 0 THEN 'failed' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'success' END AS file_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def file_status_rollup(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    papers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("success").alias("status"))
    return file_status(files, papers)


@query("""WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'error' ELSE 'control' END AS kind, doc_id % 3 AS expected, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE doc_id % 4 END AS answered FROM labels)
SELECT kind, CASE WHEN kind = 'error' THEN CASE WHEN answered = expected THEN 'corrected' WHEN answered IS NULL THEN 'became_ambiguous' ELSE 'still_wrong' END
 ELSE CASE WHEN answered = expected THEN 'unchanged_correct' WHEN answered IS NULL THEN 'regressed_to_ambiguous' ELSE 'regressed_to_wrong' END END AS outcome, count(*) AS n FROM r GROUP BY 1, 2""")
def adjudication_outcomes(spark, sf_dir):
    d = F.col("doc_id")
    answered = F.when(d % 5 == 0, None).when(d % 2 == 0, d % 3).otherwise(d % 4)
    return report.adjudication_outcomes(table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "error").otherwise("control").alias("kind"), (d % 3).alias("expected"), answered.alias("answered")))


JACCARD_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 0))"


@query(f"""WITH a AS (SELECT doc_id AS left_id, unnest({JACCARD_WORDS}) AS word FROM documents), b AS (SELECT item_id AS right_id, unnest({JACCARD_WORDS}) AS word FROM benchmark),
na AS (SELECT left_id, count(*) AS n FROM a GROUP BY left_id), nb AS (SELECT right_id, count(*) AS n FROM b GROUP BY right_id),
s AS (SELECT left_id, right_id, count(*) AS k FROM a JOIN b ON a.word = b.word GROUP BY left_id, right_id HAVING count(*) >= 2),
j AS (SELECT s.left_id AS left_id, s.right_id AS right_id, round(CAST(k AS DOUBLE) / (na.n + nb.n - k), 6) AS jaccard FROM s JOIN na ON na.left_id = s.left_id JOIN nb ON nb.right_id = s.right_id)
SELECT left_id, rnk, right_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY jaccard DESC, right_id) AS rnk FROM j) AS x WHERE rnk <= 3""")
def token_jaccard_topk(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return report.token_jaccard(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text"), 3)


@query()
def greedy_snippet_backfill(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where(F.coalesce("text", F.lit("")) != "")
    paper = F.col("conv_id").cast("string").alias("paper_id")
    asked = turns.select(paper, F.col("turn").alias("pos"), F.lit(None).cast("string").alias("question_number"), F.col("text").alias("question_text"), F.lit("short_answer").alias("question_type"), F.array().cast("array<string>").alias("options"))
    found = turns.select(paper, F.col("turn").alias("pos"), F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "text").alias("text"), F.lit("text").alias("block_type"), F.lit(None).cast("string").alias("marker"))
    return reconcile.backfill_questions(asked, found).select("paper_id", "pos", "question_number", F.size("options").alias("n_options"))


@query(f"""WITH {Q}, v AS (SELECT question_id, CASE WHEN doc_id % 9 = 0 THEN 1.5 ELSE extraction_confidence END AS c, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE topic_id END AS t, classification_status AS s FROM q)
SELECT question_id, 'confidence' AS rule FROM v WHERE NOT (c BETWEEN 0 AND 1) UNION ALL SELECT question_id, 'status' FROM v WHERE NOT ((s = 'classified') = (t IS NOT NULL))""")
def schema_constraint_violations(spark, sf_dir):
    rows = questions(spark, sf_dir).select(
        "question_id", F.when(F.col("doc_id") % 9 == 0, 1.5).otherwise(F.col("extraction_confidence")).alias("c"), F.when(F.col("doc_id") % 4 != 0, F.col("topic_id")).alias("t"), "classification_status"
    )
    return violations(rows, "question_id", {"confidence": confidence_ok(F.col("c")), "status": status_ok(F.col("classification_status"), F.col("t"))})


@query(f"""WITH {Q}, v AS (SELECT question_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'classified' WHEN doc_id % 3 = 1 THEN 'ambiguous' ELSE 'no_match' END AS s, CASE WHEN doc_id % 12 = 0 THEN 'nowhere' ELSE topic_id END AS t FROM q WHERE doc_id % 7 <> 0)
SELECT q.question_id AS question_id, CASE WHEN s IS NULL OR (s = 'classified' AND t = 'nowhere') THEN 'unclassified' ELSE s END AS status, CASE WHEN s = 'classified' AND t <> 'nowhere' THEN t END AS topic_id,
 CASE WHEN s IS NULL OR (s = 'classified' AND t = 'nowhere') THEN 0.0 ELSE CAST(v.doc_id % 10 AS DOUBLE) / 10.0 END AS confidence FROM q LEFT JOIN v ON v.question_id = q.question_id""")
def classification_reconcile(spark, sf_dir):
    rows, d = questions(spark, sf_dir), F.col("doc_id")
    status = F.when(d % 3 == 0, "classified").when(d % 3 == 1, "ambiguous").otherwise("no_match")
    verdicts = rows.where(d % 7 != 0).select("question_id", F.lit(1).alias("seq"), status.alias("status"), F.when(d % 12 == 0, "nowhere").otherwise(F.col("topic_id")).alias("topic_id"), ((d % 10) / 10.0).alias("confidence"))
    return reconcile.reconcile_topics(rows, rows.select("topic_id"), verdicts)


@query("""WITH p AS (SELECT l_orderkey AS file_id, (l_partkey % 160) + 1 AS page, CASE WHEN l_suppkey % 3 = 0 THEN 'table_of_contents' WHEN l_suppkey % 3 = 1 THEN 'index' ELSE 'neither' END AS structure, l_discount * 10 AS confidence FROM lineitem)
SELECT file_id, min((page - 1) // 25) AS "window" FROM p WHERE page <= 150 AND structure <> 'neither' AND confidence >= 0.6 GROUP BY file_id""")
def toc_window_search(spark, sf_dir):
    s = F.col("l_suppkey") % 3
    structure = F.when(s == 0, "table_of_contents").when(s == 1, "index").otherwise("neither")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") % 160 + 1).alias("page"), structure.alias("structure"), (F.col("l_discount") * 10).alias("confidence"))
    return B.toc_window(rows)


@query("""SELECT CAST(l_orderkey AS BIGINT) AS file_id, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber BETWEEN 1 AND 3) = 3 AND bool_and(CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN l_partkey % 11 <> 0 ELSE TRUE END) AS has_text
FROM lineitem GROUP BY l_orderkey""")
def text_layer_probe(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_partkey") % 11 != 0, F.repeat(F.lit("x"), 50)).otherwise(F.lit("  ")).alias("text"))
    return B.has_text_layer(pages, 1, 3)


@query(f"""WITH {FOREST}, p AS (SELECT f.id AS id, f.name AS name, f.level - 1 AS depth FROM forest f)
SELECT p.id AS id, p.name AS name, depth, row_number() OVER (ORDER BY ord) AS place FROM p JOIN forest ON forest.id = p.id""")
def topic_tree_walk(spark, sf_dir):
    return frequency.ranked(T.tree_paths(forest(spark, sf_dir)), [F.asc("path")], "place").select("id", "name", "depth", "place")


@query("SELECT event_id, event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) AS x WHERE n = 1")
def stream_ingest_dedupe(spark, sf_dir):
    scratch = Scratch(spark, "stream")
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = scratch.path("arrived")
    # The same files arrive twice; a stream keeps the first of each event.
    for _ in range(2):
        spark.read.parquet(source).write.mode("append").parquet(folder)
    rows = stream_table(spark, folder, schema).dropDuplicates(["event_id"])
    out = scratch.path("kept")
    run_available(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), scratch.path("progress"))
    return spark.read.parquet(out).select("event_id", "event_type", "user_id", "value")
