"""Every query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, frequency, report
from .adapters import KINDS, LINKS, OCC, Q, links, orders_by_nation, question_id, questions, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SUMMARY = """s AS (
  SELECT t.topic_id, t.topic_name, count(occ.question_id) AS total_occurrences, count(DISTINCT occ.canonical_question_id) AS unique_canonical,
         count(DISTINCT occ.paper_id) AS papers
  FROM topics t LEFT JOIN occ ON occ.topic_id = t.topic_id GROUP BY t.topic_id, t.topic_name)"""


@query(f"""WITH {OCC}, {SUMMARY}
SELECT topic_id, topic_name, total_occurrences, unique_canonical, row_number() OVER (ORDER BY total_occurrences DESC, unique_canonical DESC, topic_id) AS rnk
FROM s WHERE total_occurrences > 0""")
def topic_frequency_ranked(spark, sf_dir):
    summary = frequency.topic_summary(*orders_by_nation(spark, sf_dir))
    return frequency.rank_topics(summary).select("topic_id", "topic_name", "total_occurrences", "unique_canonical", "rnk")


@query(f"""WITH {OCC}, {SUMMARY}
SELECT topic_id, total_occurrences, unique_canonical, row_number() OVER (ORDER BY unique_canonical DESC, total_occurrences DESC, topic_id) AS rnk
FROM s WHERE total_occurrences > 0""")
def topic_unique_ranked(spark, sf_dir):
    summary = frequency.topic_summary(*orders_by_nation(spark, sf_dir))
    return frequency.rank_topics_by_unique(summary).select("topic_id", "total_occurrences", "unique_canonical", "rnk")


@query(
    f"""WITH {OCC}, {SUMMARY}, k AS (SELECT topic_id, """
    + ", ".join(f"count(*) FILTER (WHERE question_type = '{t}') AS n_{t}" for t in ("mcq", "short_answer", "short_essay", "long_answer", "essay", "other", "unknown"))
    + """ FROM occ GROUP BY topic_id)
SELECT s.topic_id AS topic_id, topic_name, total_occurrences, unique_canonical, papers, """
    + ", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in ("mcq", "short_answer", "short_essay", "long_answer", "essay", "other", "unknown"))
    + " FROM s LEFT JOIN k ON k.topic_id = s.topic_id"
)
def topic_summary_dense(spark, sf_dir):
    return frequency.topic_summary(*orders_by_nation(spark, sf_dir))


@query(f"""WITH {OCC}, c AS (SELECT topic_id, canonical_question_id, count(*) AS occurrences FROM occ GROUP BY topic_id, canonical_question_id)
SELECT topic_id, canonical_question_id, occurrences, row_number() OVER (PARTITION BY topic_id ORDER BY occurrences DESC, canonical_question_id) AS ord
FROM c WHERE occurrences > 1""")
def topic_repeated(spark, sf_dir):
    _, asked, linked = orders_by_nation(spark, sf_dir)
    return frequency.topic_repeated(asked, linked)


@query(f"WITH {Q}, {KINDS} SELECT k.question_type AS question_type, ord, count(q.doc_id) AS n FROM kinds k LEFT JOIN q ON q.question_type = k.question_type GROUP BY k.question_type, ord")
def type_counts_dense(spark, sf_dir):
    return frequency.type_counts(questions(spark, sf_dir))


@query(f"""WITH {Q}, {KINDS}, c AS (SELECT k.question_type AS question_type, count(q.doc_id) AS n FROM kinds k LEFT JOIN q ON q.question_type = k.question_type GROUP BY k.question_type),
t AS (SELECT sum(n) AS total FROM c)
SELECT question_type, n, round(n * 100 / CAST(total AS DOUBLE), 1) AS share_pct FROM c, t""")
def type_share_pct(spark, sf_dir):
    return frequency.type_shares(questions(spark, sf_dir))


@query(f"""WITH {Q}, st AS (SELECT * FROM (VALUES ('classified', 0), ('ambiguous', 1), ('no_match', 2), ('unclassified', 3)) AS t(classification_status, ord))
SELECT st.classification_status AS classification_status, ord, count(q.doc_id) AS n FROM st LEFT JOIN q ON q.classification_status = st.classification_status
GROUP BY st.classification_status, ord""")
def status_counts_dense(spark, sf_dir):
    return frequency.status_counts(questions(spark, sf_dir))


@query(f"""WITH {Q}, {LINKS}, {KINDS}, e AS (
  SELECT question_type, canonical_question_id, count(*) AS n FROM q LEFT JOIN ll ON ll.question_id = q.question_id GROUP BY question_type, canonical_question_id),
c AS (SELECT question_type, sum(n) AS occurrences, count(canonical_question_id) AS unique_canonical,
      count(*) FILTER (WHERE canonical_question_id IS NOT NULL AND n > 1) AS repeated FROM e GROUP BY question_type)
SELECT k.question_type AS question_type, CAST(coalesce(occurrences, 0) AS BIGINT) AS occurrences, coalesce(unique_canonical, 0) AS unique_canonical, coalesce(repeated, 0) AS repeated
FROM kinds k LEFT JOIN c ON c.question_type = k.question_type""")
def repetition_by_type(spark, sf_dir):
    return frequency.repetition_by_type(questions(spark, sf_dir), links(spark, sf_dir))


@query(f"WITH {Q}, y AS (SELECT DISTINCT paper_year FROM q WHERE paper_year IS NOT NULL) SELECT paper_year, row_number() OVER (ORDER BY paper_year) AS ord FROM y")
def years_represented(spark, sf_dir):
    return frequency.years_represented(questions(spark, sf_dir))


@query(f"WITH {Q} SELECT topic_id, min(paper_year) AS first_year, max(paper_year) AS latest_year FROM q GROUP BY topic_id")
def first_latest_year(spark, sf_dir):
    return frequency.first_and_latest_year(questions(spark, sf_dir), ["topic_id"])


@query("""WITH y AS (SELECT source, list_sort(list_distinct(regexp_extract_all(text, '(?:19|20)[0-9]{2}'))) AS years, doc_id FROM documents)
SELECT DISTINCT source AS paper_id FROM y WHERE len(years) > 1""")
def year_conflicts(spark, sf_dir):
    years = F.array_distinct(F.regexp_extract_all("text", F.lit(X.YEARS), F.lit(0)))
    papers = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), (F.size(years) > 1).alias("year_conflict"))
    return frequency.year_conflict_papers(papers)


@query(r"""WITH f AS (SELECT page_id, url AS document, regexp_replace(url, '[0-9]+', CAST(page_id % 50 AS VARCHAR)) AS file FROM pages)
SELECT page_id, lower(document) <> lower(file) AND len(regexp_extract_all(document, '[0-9]+')) > 0 AND len(regexp_extract_all(file, '[0-9]+')) > 0
  AND NOT list_has_any(regexp_extract_all(document, '[0-9]+'), regexp_extract_all(file, '[0-9]+')) AS conflict FROM f""")
def metadata_conflict(spark, sf_dir):
    url = F.col("url")
    # The first number alone is replaced, as in the SQL.
    at = F.regexp_extract(url, r"^([^0-9]*)[0-9]+", 1)
    rest = F.regexp_extract(url, r"(?s)^[^0-9]*[0-9]+(.*)$", 1)
    file = F.when(url.rlike("[0-9]"), F.concat(at, (F.col("page_id") % 50).cast("string"), rest)).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", X.field_conflict(url, file).alias("conflict"))


@query(r"""WITH y AS (SELECT doc_id, list_distinct(regexp_extract_all(substr(text, 1, 1000), '(?:19|20)[0-9]{2}')) AS a,
  list_distinct(regexp_extract_all(substr(text, 1001), '(?:19|20)[0-9]{2}')) AS b FROM documents)
SELECT doc_id, len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) AS disagrees FROM y""")
def cross_field_check(spark, sf_dir):
    head, tail = F.substring("text", 1, 1000), F.expr("substring(text, 1001)")
    return table(spark, sf_dir, "documents").select("doc_id", X.year_disagrees(head, tail).alias("disagrees"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(url, '\.[^.]*$', ''), '(?:19|20)[0-9]{2}'))), ',') AS years,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(url, '\.[^.]*$', ''), '[_\-\s]+'), lambda t: t <> ''), ',') AS tokens FROM pages""")
def filename_metadata(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", X.filename_metadata(F.col("url")).alias("m"))
    return found.select("page_id", F.array_join("m.years", ",").alias("years"), F.array_join("m.tokens", ",").alias("tokens"))


KEYED = r"""keyed AS (
  SELECT question_id, doc_id, lower(regexp_replace(trim(regexp_replace(replace(translate(question_text, '‘’“”–—', '''''""--'), '…', '...'), '\s+', ' ', 'g')), '\.+$', '')) AS norm, question_type FROM q)"""


def keyed_questions(spark, sf_dir):
    """Keys of the questions, from the documents alone: the labels have no part in them, and a join would shuffle the texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(question_id(), "doc_id", X.exact_key(F.lit("x"), F.col("text")).alias("exact_key"))


@query(f"WITH {Q}, {KEYED} SELECT question_id, sha256('x||' || norm || '||') AS key_hash FROM keyed")
def exact_match_key(spark, sf_dir):
    return keyed_questions(spark, sf_dir).select("question_id", F.sha2("exact_key", 256).alias("key_hash"))


@query(f"WITH {Q}, {KEYED} SELECT sha256('x||' || norm || '||') AS key_hash, count(*) AS members, min(question_id) AS first_id FROM keyed WHERE norm IS NOT NULL GROUP BY norm HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return dedup.exact_groups(keyed_questions(spark, sf_dir))


@query(f"""WITH {Q}, {KEYED}, m AS (SELECT question_id, CASE WHEN norm IS NULL THEN question_id ELSE min(question_id) OVER (PARTITION BY norm) END AS first_id,
  CASE WHEN norm IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY norm) END AS members FROM keyed)
SELECT question_id, first_id, members, members - 1 AS links FROM m""")
def exact_dup_pairs(spark, sf_dir):
    """Every question with its class and its number of links: two questions are a pair where their first_id is the same."""
    return dedup.exact_membership(keyed_questions(spark, sf_dir))


@query(f"""WITH {Q}, r AS (SELECT topic_id, question_id, row_number() OVER (PARTITION BY topic_id, paper_id ORDER BY ambiguous, extraction_confidence DESC, length(question_text) DESC, question_id) AS n, paper_id FROM q)
SELECT topic_id || '/' || paper_id AS grp, question_id AS representative_question_id FROM r WHERE n = 1""")
def representative_pick(spark, sf_dir):
    rows = questions(spark, sf_dir).withColumn("grp", F.concat_ws("/", "topic_id", "paper_id"))
    return dedup.representatives(rows, "grp")


@query(f"""WITH {Q}, {KEYED}, g AS (SELECT string_agg(question_id, '|' ORDER BY question_id) AS ids, count(*) AS members FROM keyed GROUP BY norm)
SELECT 'canonical_' || substr(sha256(ids), 1, 16) AS canonical_question_id, members FROM g""")
def canonical_ids(spark, sf_dir):
    groups = keyed_questions(spark, sf_dir).groupBy(F.sha2("exact_key", 256)).agg(F.collect_list("question_id").alias("ids"), F.count("*").alias("members"))
    return groups.select(X.canonical_id(F.col("ids")).alias("canonical_question_id"), "members")


def _cosine_sql(same: bool) -> str:
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.e, y.e) / (x.norm * y.norm) AS sim, x.label = y.label AS same FROM n x JOIN n y ON x.vec_id < y.vec_id)
SELECT a, b, round(sim, 6) AS sim FROM p WHERE {'same AND sim >= 0.3' if same else 'NOT same AND sim >= 0.4'}"""


def _candidates(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("vector"))
    return dedup.cosine_candidates(vectors, same_type=0.3, cross_type=0.4)


@query(_cosine_sql(True))
def cosine_candidates_same_type(spark, sf_dir):
    return _candidates(spark, sf_dir).where("same").select("a", "b", F.round("sim", 6).alias("sim"))


@query(_cosine_sql(False))
def cosine_candidates_cross_type(spark, sf_dir):
    return _candidates(spark, sf_dir).where(~F.col("same")).select("a", "b", F.round("sim", 6).alias("sim"))


@query("""WITH asked AS (SELECT doc_id AS pair_id FROM documents), v AS (
  SELECT doc_id AS pair_id, 1 AS seq, CASE doc_id % 3 WHEN 0 THEN 'same_question' WHEN 1 THEN 'different_question' ELSE 'uncertain' END AS verdict, CAST(doc_id % 10 AS DOUBLE) / 10.0 AS confidence
  FROM documents WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 2, 'same_question', 0.9 FROM documents WHERE doc_id % 10 = 1
  UNION ALL SELECT -1 - doc_id, 1, 'same_question', 0.9 FROM documents WHERE doc_id < 5),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY seq DESC) AS n FROM v) AS t WHERE n = 1)
SELECT asked.pair_id AS pair_id, CASE WHEN verdict IS NULL OR (verdict = 'same_question' AND confidence < 0.6) THEN 'uncertain' ELSE verdict END AS verdict, coalesce(confidence, 0.0) AS confidence
FROM asked LEFT JOIN last ON last.pair_id = asked.pair_id""")
def pair_reconcile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"))
    kind = F.when(F.col("pair_id") % 3 == 0, "same_question").when(F.col("pair_id") % 3 == 1, "different_question").otherwise("uncertain")
    verdicts = docs.where(F.col("pair_id") % 4 != 0).select("pair_id", F.lit(1).alias("seq"), kind.alias("verdict"), ((F.col("pair_id") % 10) / 10.0).alias("confidence"))
    again = docs.where(F.col("pair_id") % 10 == 1).select("pair_id", F.lit(2), F.lit("same_question"), F.lit(0.9))
    strange = docs.where(F.col("pair_id") < 5).select(-1 - F.col("pair_id"), F.lit(1), F.lit("same_question"), F.lit(0.9))
    return dedup.reconcile_pairs(docs, verdicts.union(again).union(strange))


EDGES = """e AS (
  SELECT a, b FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) /
    (sqrt(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))) AS sim
    FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) AS p WHERE sim >= 0.4)"""


@query(f"""WITH RECURSIVE {EDGES}, two AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, two.y FROM r JOIN two ON two.x = r.y)
SELECT x AS question_id, min(y) AS component FROM r GROUP BY x""")
def components_minlabel(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("kind"), F.col("embedding").alias("vector"))
    edges = dedup.cosine_candidates(vectors, same_type=0.4).select("a", "b")
    return dedup.groups(vectors.select(F.col("id").alias("question_id")), edges)


#: SQL of canonical records from exact links and judged pairs (f: the first of each exact class).
CANONICALS = """dec AS (SELECT f AS a, question_id AS b, 'exact_duplicate' AS src, 'same_question' AS verdict, 1.0 AS confidence FROM keyed JOIN first ON first.norm = keyed.norm WHERE f < question_id
  UNION ALL SELECT a, b, 'llm_judge', verdict, confidence FROM judged),
two AS (SELECT a AS x, b AS y FROM dec WHERE verdict = 'same_question' UNION ALL SELECT b, a FROM dec WHERE verdict = 'same_question'),
r AS (SELECT question_id AS x, question_id AS y FROM q UNION SELECT r.x, two.y FROM r JOIN two ON two.x = r.y),
lab AS (SELECT x AS question_id, min(y) AS component FROM r GROUP BY x),
sizes AS (SELECT component, count(*) AS members, string_agg(question_id, '|' ORDER BY question_id) AS ids FROM lab GROUP BY component),
inn AS (SELECT component, bool_and(src = 'exact_duplicate') AS all_exact, min(confidence) AS least FROM dec JOIN lab ON lab.question_id = dec.a WHERE verdict = 'same_question' GROUP BY component),
uns AS (SELECT component, max(confidence) AS most FROM (SELECT a AS question_id, confidence FROM dec WHERE verdict = 'uncertain' UNION ALL SELECT b, confidence FROM dec WHERE verdict = 'uncertain') AS u
  JOIN lab ON lab.question_id = u.question_id GROUP BY component),
best AS (SELECT component, question_id AS representative_question_id FROM (
  SELECT component, q.question_id AS question_id, row_number() OVER (PARTITION BY component ORDER BY ambiguous, extraction_confidence DESC, length(question_text) DESC, q.question_id) AS n
  FROM q JOIN lab ON lab.question_id = q.question_id) AS t WHERE n = 1)"""
ASSEMBLY = f"""{Q}, {KEYED},
first AS (SELECT norm, min(question_id) AS f FROM keyed GROUP BY norm),
judged AS (SELECT x.question_id AS a, y.question_id AS b, CASE WHEN x.doc_id % 200 = 0 THEN 'same_question' ELSE 'uncertain' END AS verdict, 0.7 AS confidence
  FROM q x JOIN q y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 100 = 0),
{CANONICALS}"""


def _assembly(spark, sf_dir):
    rows = questions(spark, sf_dir)
    exact = dedup.exact_duplicate_links(keyed_questions(spark, sf_dir)).select("a", "b", F.lit(dedup.EXACT).alias("decision_source"), F.lit("same_question").alias("verdict"), F.lit(1.0).alias("confidence"))
    ids = rows.select("doc_id", "question_id")
    after = ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("question_id").alias("b"))
    verdict = F.when(F.col("doc_id") % 200 == 0, "same_question").otherwise("uncertain")
    judged = ids.where(F.col("doc_id") % 100 == 0).join(after, "doc_id").select(F.col("question_id").alias("a"), "b", F.lit("llm_judge"), verdict, F.lit(0.7))
    return dedup.assemble_canonicals(rows, exact.union(judged))


CANONICAL_ROWS = """SELECT 'canonical_' || substr(sha256(ids), 1, 16) AS canonical_question_id, representative_question_id, members,
  CASE WHEN members = 1 AND most IS NOT NULL THEN 'needs_review' WHEN members = 1 THEN 'singleton' WHEN all_exact THEN 'exact_duplicate' ELSE 'semantic_merge' END AS dedup_status,
  CAST(CASE WHEN members = 1 THEN most WHEN all_exact THEN 1.0 ELSE least END AS DOUBLE) AS dedup_confidence
FROM sizes LEFT JOIN inn ON inn.component = sizes.component LEFT JOIN uns ON uns.component = sizes.component JOIN best ON best.component = sizes.component"""


@query(f"WITH RECURSIVE {ASSEMBLY} {CANONICAL_ROWS}")
def canonical_assembly(spark, sf_dir):
    return _assembly(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {ASSEMBLY}
SELECT question_id, 'canonical_' || substr(sha256(ids), 1, 16) AS canonical_question_id FROM lab JOIN sizes ON sizes.component = lab.component""")
def canonical_links(spark, sf_dir):
    return _assembly(spark, sf_dir)[1]


CANON = f"""{Q}, {LINKS}, canon AS (SELECT DISTINCT canonical_question_id FROM lk UNION ALL SELECT 'c_empty'),
f AS (SELECT canon.canonical_question_id AS canonical_question_id, count(lk.question_id) AS occurrences, count(DISTINCT q.paper_id) AS papers,
  coalesce(string_agg(DISTINCT q.question_type, ',' ORDER BY q.question_type), '') AS types, coalesce(string_agg(DISTINCT q.paper_year, ',' ORDER BY q.paper_year), '') AS years
  FROM canon LEFT JOIN lk ON lk.canonical_question_id = canon.canonical_question_id LEFT JOIN q ON q.question_id = lk.question_id GROUP BY canon.canonical_question_id),
rk AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, papers DESC, canonical_question_id) AS rnk FROM f)"""


def _frequencies(spark, sf_dir):
    linked = links(spark, sf_dir)
    canonicals = linked.select("canonical_question_id").distinct().union(spark.createDataFrame([("c_empty",)], "canonical_question_id string"))
    return frequency.canonical_frequency(canonicals, linked, questions(spark, sf_dir))


@query(f"WITH {CANON} SELECT * FROM f")
def canonical_hydrate(spark, sf_dir):
    return _frequencies(spark, sf_dir)


@query(f"WITH {CANON} SELECT canonical_question_id, occurrences, papers, rnk FROM rk")
def canonical_rank(spark, sf_dir):
    return frequency.rank_canonicals(_frequencies(spark, sf_dir)).select("canonical_question_id", "occurrences", "papers", "rnk")


@query(f"""WITH {CANON} SELECT canonical_question_id, occurrences, rnk,
  CASE WHEN canonical_question_id = 'c_extra' THEN 'unknown' ELSE 'exact_duplicate' END AS dedup_status FROM rk WHERE occurrences > 1""")
def repeated_report(spark, sf_dir):
    frequencies = _frequencies(spark, sf_dir)
    records = frequencies.where(F.col("canonical_question_id") != "c_extra").select("canonical_question_id", F.lit("exact_duplicate").alias("dedup_status"), F.lit(None).cast("string").alias("topic_id"))
    return report.repeated_report(frequency.rank_canonicals(frequencies), records).select("canonical_question_id", "occurrences", "rnk", "dedup_status")


@query(f"WITH {Q} SELECT question_id, paper_id, question_type FROM q WHERE classification_status = 'unclassified'")
def unclassified_hydrate(spark, sf_dir):
    return report.unclassified_report(questions(spark, sf_dir)).select("question_id", "paper_id", "question_type")


def _papers(spark, sf_dir):
    return questions(spark, sf_dir).groupBy("paper_id").agg((F.count_if(F.col("paper_year").isNotNull()) > 3).alias("year_conflict"))


@query(f"""WITH {Q}, {LINKS}, {OCC}, {SUMMARY}
SELECT (SELECT count(DISTINCT paper_id) FROM q) AS papers, (SELECT count(*) FROM q) AS occurrences,
 (SELECT count(*) FROM q WHERE classification_status = 'no_match') AS no_match, (SELECT count(*) FROM q WHERE classification_status = 'ambiguous') AS ambiguous,
 (SELECT count(*) FROM q WHERE classification_status = 'unclassified') AS unclassified, (SELECT count(DISTINCT canonical_question_id) FROM lk) AS canonicals,
 (SELECT count(*) FROM s) AS topics, (SELECT count(*) FROM s WHERE total_occurrences > 0) AS tested, (SELECT count(*) FROM s WHERE total_occurrences = 0) AS untested""")
def exec_summary(spark, sf_dir):
    summary = frequency.topic_summary(*orders_by_nation(spark, sf_dir))
    return report.executive_summary(_papers(spark, sf_dir), questions(spark, sf_dir), links(spark, sf_dir), summary)


@query(f"""WITH {Q}, p AS (SELECT paper_id, count(paper_year) > 3 AS year_conflict FROM q GROUP BY paper_id)
SELECT (SELECT count(*) FROM q WHERE classification_status = 'unclassified') AS n_unclassified, (SELECT count(*) FROM q WHERE classification_status = 'no_match') AS n_no_match,
 (SELECT count(*) FROM q WHERE classification_status = 'ambiguous') AS n_ambiguous, (SELECT count(*) FROM p WHERE year_conflict) AS year_conflict_papers""")
def data_quality(spark, sf_dir):
    return report.data_quality(questions(spark, sf_dir), _papers(spark, sf_dir))


@query(f"""WITH {Q}, {LINKS}, o AS (SELECT question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM lk)),
d AS (SELECT question_id FROM lk GROUP BY question_id HAVING count(DISTINCT canonical_question_id) > 1),
c AS (SELECT (SELECT count(*) FROM q) AS raw_occurrences, (SELECT count(*) FROM lk) AS linked_occurrences, (SELECT count(DISTINCT canonical_question_id) FROM lk) AS canonicals,
  (SELECT count(*) FROM o) AS orphaned, (SELECT count(*) FROM d) AS duplicated)
SELECT *, raw_occurrences = linked_occurrences AND orphaned = 0 AND duplicated = 0 AS reconciled FROM c""")
def data_integrity(spark, sf_dir):
    linked = links(spark, sf_dir)
    return frequency.data_integrity(questions(spark, sf_dir), linked, linked)


@query(f"WITH {Q}, {LINKS} SELECT question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM lk)")
def orphans_anti(spark, sf_dir):
    return frequency.orphans(questions(spark, sf_dir), links(spark, sf_dir))


@query(f"WITH {LINKS} SELECT question_id, count(DISTINCT canonical_question_id) AS groups FROM lk GROUP BY question_id HAVING count(DISTINCT canonical_question_id) > 1")
def duplicate_links(spark, sf_dir):
    return frequency.duplicate_links(links(spark, sf_dir))
