"""Queries over the record model's smaller operators: listings, counts by paper and file, metadata, texts that are shown, text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks as B
from ..operators import listings, render
from ..operators import topics as T
from ..schemas import STATUSES
from .adapters import BLOCKS, FOREST, LINKS, Q, forest, links, questions, table, turn_blocks
from .catalogue import query

_STATES = ", ".join(f"count(*) FILTER (WHERE classification_status = '{s}') AS {s}" for s in STATUSES)


@query(f"WITH {Q} SELECT paper_id, count(*) AS questions, {_STATES} FROM q GROUP BY paper_id")
def classification_counts_of_papers(spark, sf_dir):
    return listings.classification_counts(questions(spark, sf_dir), ["paper_id"])


@query(f"WITH {Q} SELECT paper_id, question_type, count(*) AS n FROM q GROUP BY paper_id, question_type")
def type_counts_of_papers(spark, sf_dir):
    return listings.type_counts_of_papers(questions(spark, sf_dir))


#: Orders as papers of their customers' files; a file is failed, partial or read by its number.
FILES = """papers AS (SELECT o_orderkey AS paper_id, o_custkey AS file_id FROM orders),
files AS (SELECT c_custkey AS file_id, CASE c_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END AS status FROM customer),
asked AS (SELECT l_orderkey AS paper_id, CASE l_partkey % 5 WHEN 0 THEN 'classified' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'no_match' WHEN 3 THEN 'unclassified' ELSE '' END AS s FROM lineitem)"""


@query(f"""WITH {FILES}, c AS (SELECT file_id, count(*) AS questions, count(*) FILTER (WHERE s = 'classified') AS classified, count(*) FILTER (WHERE s = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE s = 'no_match') AS no_match, count(*) FILTER (WHERE s IN ('unclassified', '')) AS unclassified FROM asked JOIN papers ON papers.paper_id = asked.paper_id GROUP BY file_id),
p AS (SELECT file_id, count(*) AS papers FROM papers GROUP BY file_id)
SELECT files.file_id AS file_id, coalesce(papers, 0) AS papers, coalesce(questions, 0) AS questions, coalesce(classified, 0) AS classified, coalesce(ambiguous, 0) AS ambiguous,
  coalesce(no_match, 0) AS no_match, coalesce(unclassified, 0) AS unclassified
FROM files LEFT JOIN p ON p.file_id = files.file_id LEFT JOIN c ON c.file_id = files.file_id WHERE status <> 'failed'""")
def classification_totals_of_files(spark, sf_dir):
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("file_id"))
    state = F.when(F.col("c_custkey") % 3 == 0, "failed").when(F.col("c_custkey") % 3 == 1, "partial").otherwise("success")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), state.alias("status"))
    place = F.col("l_partkey") % 5
    status = F.when(place == 0, "classified").when(place == 1, "ambiguous").when(place == 2, "no_match").when(place == 3, "unclassified").otherwise("")
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), status.alias("classification_status"))
    return listings.classification_totals(asked, papers, files)


YEAR = r"(?:19|20)[0-9]{2}"


@query(rf"""WITH p AS (SELECT page_id, url || '_' || CAST(1990 + page_id % 40 AS VARCHAR) || '.pdf' AS filename, CASE WHEN page_id % 4 > 0 THEN 'Year ' || CAST(1990 + page_id % 30 AS VARCHAR) WHEN page_id % 8 = 0 THEN '' END AS v FROM pages),
y AS (SELECT *, list_sort(list_distinct(regexp_extract_all(regexp_replace(filename, '\.[^.]*$', ''), '{YEAR}')))[1] AS f FROM p)
SELECT page_id, nullif(v, '') AS document_value, f AS filename_value,
  coalesce(v, '') <> '' AND coalesce(f, '') <> '' AND lower(trim(v)) <> lower(f) AND NOT list_has_any(regexp_extract_all(v, '[0-9]+'), regexp_extract_all(f, '[0-9]+')) AS conflict,
  coalesce(nullif(v, ''), f) AS best, CASE WHEN coalesce(v, '') <> '' THEN 'document' WHEN f IS NOT NULL THEN 'filename' END AS provenance FROM y""")
def metadata_merged(spark, sf_dir):
    """A year said in the document beside the one in the file's name, whether they contradict, and the better one with its source."""
    value = F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("Year "), (1990 + F.col("page_id") % 30).cast("string"))).when(F.col("page_id") % 8 == 0, "")
    name = F.concat("url", F.lit("_"), (1990 + F.col("page_id") % 40).cast("string"), F.lit(".pdf"))
    kind = "struct<value:string,evidence:string,source_pages:array<int>,confidence:double>"
    said = F.struct(value.alias("value"), value.alias("evidence"), F.array(F.lit(1)).alias("source_pages"), F.lit(0.9).alias("confidence")).cast(kind)
    fields = {f: F.lit(None).cast(kind) for f in listings.FIELDS if f != "year"}
    read = table(spark, sf_dir, "pages").select("page_id", name.alias("filename"), said.alias("year")).withColumns(fields)
    year = F.col("metadata.year")
    best, source = listings.best_value(year)
    return listings.merged_metadata(read).select("page_id", year["document_value"].alias("document_value"), year["filename_value"].alias("filename_value"), year["conflict"].alias("conflict"), best.alias("best"), source.alias("provenance"))


@query(f"""WITH {Q}, {LINKS}, top AS (SELECT canonical_question_id AS c FROM lk GROUP BY canonical_question_id ORDER BY count(*) DESC, canonical_question_id LIMIT 1)
SELECT lk.question_id AS question_id, canonical_question_id, paper_id FROM lk JOIN top ON c = canonical_question_id JOIN q ON q.question_id = lk.question_id""")
def canonical_detail(spark, sf_dir):
    """The questions of the record that has most of them."""
    linked = links(spark, sf_dir)
    records = linked.groupBy("canonical_question_id").agg(F.count("*").alias("members"))
    top = records.orderBy(F.desc("members"), "canonical_question_id").first()["canonical_question_id"]
    return listings.canonical_detail(records, linked, questions(spark, sf_dir), top).select("question_id", "canonical_question_id", "paper_id")


@query("""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE turn % 7 WHEN 0 THEN 'mcq' ELSE 'essay' END AS kind, CASE WHEN turn % 2 = 0 THEN CAST(turn + 1 AS VARCHAR) END AS number FROM conversations),
l AS (SELECT CAST(conv_id AS VARCHAR) AS paper_id, turn, '[' || CAST(conv_id AS VARCHAR) || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') || '] (' || kind || ')' || coalesce(' #' || number, '') || chr(10) || text ||
  CASE WHEN kind = 'mcq' THEN chr(10) || '  A. ' || role || chr(10) || '  B. none' ELSE '' END || chr(10) AS line FROM t)
SELECT paper_id, sha256(string_agg(line, chr(10) ORDER BY turn)) AS shown_sha256 FROM l GROUP BY paper_id""")
def question_lists_shown(spark, sf_dir):
    """The turns of a conversation as the numbered questions of a paper, as a model is shown them."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("paper_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("question_id"),
        F.when(F.col("turn") % 7 == 0, "mcq").otherwise("essay").alias("question_type"),
        F.when(F.col("turn") % 2 == 0, (F.col("turn") + 1).cast("string")).alias("question_number"),
        F.coalesce("text", F.lit("")).alias("question_text"),
        F.when(F.col("turn") % 7 == 0, F.array(F.coalesce("role", F.lit("")), F.lit("none"))).alias("options"),
    )
    return render.question_lists(rows).select("paper_id", F.sha2("text", 256).alias("shown_sha256"))


@query(f"""WITH {FOREST}, l AS (SELECT ord, repeat('  ', level - 1) || '- [' || id || '] ' || name AS line FROM forest),
whole AS (SELECT string_agg(line, chr(10) ORDER BY ord) AS t FROM l)
SELECT CASE WHEN length(t) > 20000 THEN substr(t, 1, 20000) || chr(10) || '...[topic list truncated]...' ELSE t END AS shown FROM whole""")
def topic_list_shown(spark, sf_dir):
    return render.topic_lists(forest(spark, sf_dir).withColumn("forest", F.lit("f"))).select(F.col("text").alias("shown"))


@query("""WITH d AS (SELECT doc_id, '[' || lang || '] ' || text || chr(10) || 'one' || chr(10) || 'two' AS t FROM documents)
SELECT doc_id, sha256(t) AS content_hash FROM d WHERE t IS NOT NULL""")
def embedding_text_hashes(spark, sf_dir):
    """What of a question is embedded: type, text and options; its hash decides whether a stored vector still counts."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    text = X.embedding_text(F.col("lang"), F.col("text"), F.array(F.lit("one"), F.lit("two")))
    return docs.select("doc_id", F.sha2(text, 256).alias("content_hash"))


@query(f"WITH {BLOCKS} SELECT file_id, count(*) FILTER (WHERE block_type <> 'text') AS high_signal, count(*) AS blocks FROM blocks GROUP BY file_id HAVING count(*) FILTER (WHERE block_type <> 'text') > 0")
def high_signal_blocks(spark, sf_dir):
    rows = turn_blocks(spark, sf_dir)
    kept = B.high_signal(rows).groupBy("file_id").agg(F.count("*").alias("high_signal"))
    return kept.join(rows.groupBy("file_id").agg(F.count("*").alias("blocks")), "file_id")


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 200)), '[^a-z0-9]+', ' ', 'g')) AS a, lower(trim(regexp_replace(source || ' ' || lang || '/' || CAST(doc_id AS VARCHAR), '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS slug FROM documents),
p AS (SELECT x.doc_id AS doc_id, x.slug AS slug, x.a AS a, y.a AS b FROM d x JOIN d y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, slug, a = b OR (least(length(a), length(b), 30) >= 12 AND substr(a, 1, least(length(a), length(b), 30)) = substr(b, 1, least(length(a), length(b), 30))) AS same_start FROM p""")
def snippet_starts(spark, sf_dir):
    """Whether a document begins like the next one, letters and digits alone, and a name for it that a path can hold."""
    name = F.concat("source", F.lit(" "), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.slug(name).alias("slug"), X.alnum_text(F.substring("text", 1, 200)).alias("a"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    joined = docs.join(after, "doc_id")
    return joined.select("doc_id", "slug", ((F.col("a") == F.col("b")) | X.snippets_match(F.col("a"), F.col("b"))).alias("same_start"))


@query(f"""WITH {FOREST}, t AS (SELECT id, CASE WHEN ord % 13 = 7 THEN 'B i o m o l ec u l es' ELSE name END AS name, CASE WHEN ord % 7 = 1 THEN 'ambiguous' ELSE 'resolved' END AS s, ord FROM forest)
SELECT id, CASE WHEN s = 'resolved' AND ord % 13 = 7 THEN 'name_unresolved' ELSE s END AS resolution_status FROM t""")
def resolution_downgrade(spark, sf_dir):
    rows = forest(spark, sf_dir)
    named = rows.withColumns({"name": F.when(F.col("ord") % 13 == 7, "B i o m o l ec u l es").otherwise(F.col("name")), "resolution_status": F.when(F.col("ord") % 7 == 1, "ambiguous").otherwise("resolved")})
    return T.downgrade_resolution(named).select("id", "resolution_status")
