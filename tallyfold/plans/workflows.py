"""Queries over whole runs: contents search, span joins, incremental components, deduplication with its stores, streams."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import dedup, graph
from ..operators.intervals import span_totals
from ..providers import Provider
from ..scratch import Scratch
from ..streaming.ingest import deduplicated, run_available, stream_table, windowed_counts
from . import deduplication
from .adapters import Q, questions, table
from .catalogue import CANONICAL_ROWS, CANONICALS, EDGES, KEYED, query

VERDICTS = """v AS (
  SELECT l_orderkey AS file_id, (l_partkey % 160) + 1 AS page, CASE WHEN l_suppkey % 3 = 0 THEN 'table_of_contents' WHEN l_suppkey % 3 = 1 THEN 'index' ELSE 'neither' END AS structure,
         CAST(l_discount AS DOUBLE) * 10 AS confidence FROM lineitem)"""


@query(f"""WITH {VERDICTS},
ends AS (SELECT file_id, least(max(page), 150) AS last FROM v GROUP BY file_id),
held AS (SELECT file_id, (page - 1) // 25 AS w, max(confidence) AS confidence, max_by(structure, (confidence, structure)) AS structure FROM v WHERE page <= 150 GROUP BY file_id, (page - 1) // 25),
good AS (SELECT file_id, min(w) AS w FROM held WHERE structure <> 'neither' AND confidence >= 0.6 GROUP BY file_id)
SELECT ends.file_id AS file_id, count(held.w) FILTER (WHERE held.w <= coalesce(good.w, 99)) AS calls, max(good.w) AS found_window,
       CAST(coalesce(max(good.w), (max(last) - 1) // 25) + 1 AS BIGINT) AS windows_looked_at
FROM ends LEFT JOIN held ON held.file_id = ends.file_id LEFT JOIN good ON good.file_id = ends.file_id GROUP BY ends.file_id""")
def contents_frontier(spark, sf_dir):
    """The calls of a contents search: verdicts are recorded for every window, those behind a confident one are not asked for."""
    kind = F.col("l_suppkey") % 3
    structure = F.when(kind == 0, "table_of_contents").when(kind == 1, "index").otherwise("neither")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") % 160 + 1).cast("int").alias("page"), structure.alias("structure"), (F.col("l_discount").cast("double") * 10).alias("confidence")
    )
    window = F.floor((F.col("page") - 1) / B.TOC_WINDOW).cast("int").alias("window")
    best = rows.groupBy("file_id", window).agg(F.max(F.struct("confidence", "structure")).alias("best"))
    recorded = Scratch(spark, "recorded").keep(best.select("file_id", "window", "best.structure", "best.confidence"), "verdicts")

    def judge(windows):
        return windows.select("file_id", "window").join(recorded, ["file_id", "window"]).select("file_id", "structure", "confidence")

    windows = B.search_windows(rows.select("file_id", F.array("page").alias("page_numbers")))
    looked = B.search_frontier(windows, judge)
    found = F.max(F.when(F.col("found"), F.col("window"))).cast("long").alias("found_window")
    return looked.groupBy("file_id").agg(F.count_if("has_blocks").alias("calls"), found, F.count("*").alias("windows_looked_at"))


@query("""WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey % 5 AS k, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s FROM lineitem),
p AS (SELECT p_partkey AS paper_id, p_partkey % 5 AS k, (p_partkey * 37) % 2500 AS low, (p_partkey * 37) % 2500 + p_size - 1 AS high FROM part)
SELECT paper_id, count(*) AS blocks, CAST(sum(s) AS BIGINT) AS first_pages FROM b JOIN p ON p.k = b.k AND ((s BETWEEN low AND high) OR (s + n BETWEEN low AND high)) GROUP BY paper_id""")
def blocks_in_spans(spark, sf_dir):
    """Line items as blocks of two pages in five files, parts as papers that span pages."""
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    blocks = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("file_id"), day.alias("page"), "l_linenumber")
    low = F.col("p_partkey") * 37 % 2500
    papers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_id"), (F.col("p_partkey") % 5).alias("file_id"), low.alias("low"), (low + F.col("p_size") - 1).alias("high"))
    pages = F.array("page", F.col("page") + F.col("l_linenumber"))
    found = span_totals(blocks, pages, papers, "file_id", "low", "high", F.col("page"))
    return found.groupBy("paper_id").agg(F.sum("n").alias("blocks"), F.sum("total").cast("long").alias("first_pages"))


@query(f"""WITH RECURSIVE {EDGES}, two AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings WHERE vec_id IN (SELECT x FROM two) UNION SELECT r.x, two.y FROM r JOIN two ON two.x = r.y)
SELECT x AS id, min(y) AS component FROM r GROUP BY x""")
def components_incremental(spark, sf_dir):
    """Components of pairs that come in three batches; each batch meets the labels of those before it."""
    scratch = Scratch(spark, "incremental")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("kind"), F.col("embedding").alias("vector"))
    edges = scratch.keep(dedup.cosine_candidates(vectors, same_type=0.4).select("a", "b"), "edges")
    labels = None
    for batch in range(3):
        new = edges.where(F.pmod(F.col("a") + F.col("b"), F.lit(3)) == batch)
        if labels is None:
            labels = scratch.keep(graph.connected_components(new), "labels-0")
        else:
            changes = scratch.keep(graph.component_changes(labels, new), f"changes-{batch}")
            labels = scratch.keep(graph.with_changes(labels, changes), f"labels-{batch}")
    return labels


SAME, CROSS = 0.3, 0.4
#: Labels (three numbers) that are sent to all tasks at most.
LABELS_SENT = 1_000_000


def _pairs_shown(prompt: str) -> Iterator[str]:
    """The ids that stand alone in a line, as [a::b]. Lines are looked for by their start: a pattern takes longer over long texts than making them."""
    at = prompt.find("\n[q")
    while at >= 0:
        found = re.compile(r"(?m)\[(q\d+::q\d+)\]$").match(prompt, at + 1)
        if found:
            yield found[1]
        at = prompt.find("\n[q", at + 1)


def _rule(prompt: str, room: int, attempt: int) -> str:
    """Verdicts from the numbers of the documents in a pair's id."""
    verdicts = []
    for pair in _pairs_shown(prompt):
        n = sum(int(x[1:]) for x in pair.split("::"))
        verdicts.append({"pair_id": pair, "verdict": ("same_question", "different_question", "uncertain")[n % 3], "confidence": (5 + n % 5) / 10})
    return json.dumps({"verdicts": verdicts})


DEDUP = f"""{Q}, {KEYED.replace(" AS norm, question_type", " || '|' || question_type AS norm, question_type")},
first AS (SELECT norm, min(question_id) AS f FROM keyed GROUP BY norm),
reps AS (SELECT question_id, doc_id, question_type FROM (
  SELECT q.question_id AS question_id, q.doc_id AS doc_id, q.question_type AS question_type,
         row_number() OVER (PARTITION BY norm ORDER BY ambiguous, extraction_confidence DESC, length(question_text) DESC, q.question_id) AS n
  FROM q JOIN keyed ON keyed.question_id = q.question_id) AS t WHERE n = 1),
vecs AS (SELECT question_id, doc_id, question_type, CAST(embedding AS DOUBLE[]) AS e FROM reps JOIN embeddings ON vec_id = doc_id),
near AS (
  SELECT x.question_id AS a, y.question_id AS b, x.doc_id + y.doc_id AS n, x.question_type = y.question_type AS same,
         list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) AS sim
  FROM vecs x JOIN vecs y ON x.question_id < y.question_id),
judged AS (
  SELECT a, b, CASE n % 3 WHEN 0 THEN CASE WHEN n % 5 = 0 THEN 'uncertain' ELSE 'same_question' END WHEN 1 THEN 'different_question' ELSE 'uncertain' END AS verdict,
         CAST(5 + n % 5 AS DOUBLE) / 10 AS confidence
  FROM near WHERE sim >= CASE WHEN same THEN {SAME} ELSE {CROSS} END),
{CANONICALS}"""


def _two_runs(spark, sf_dir) -> deduplication.Deduplicated:
    """Deduplication of the documents with the stored vectors; the second of two runs, which asks about nothing."""
    scratch = Scratch(spark, "dedup-query")
    # Up to LABELS_SENT labels go to the texts; with more, the texts are shuffled once.
    asked = questions(spark, sf_dir, partial(dedup.small_side, most=LABELS_SENT)).select("question_id", "doc_id", "question_type", "question_text", "ambiguous", "extraction_confidence")
    asked = scratch.keep(asked.withColumns({"options": F.array().cast("array<string>"), "topic_name": F.lit(None).cast("string")}), "questions")
    text = deduplication.embedding_text(F.col("question_type"), F.col("question_text"), F.col("options"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    stored = dedup.only_rows_of(asked, vectors, "doc_id").select(F.col("question_id").alias("id"), "doc_id", F.sha2(text, 256).alias("content_hash"), F.lit("given").alias("model")).join(vectors, "doc_id")
    folder = scratch.path("stores")
    deduplication.GrowingTable(spark, f"{folder}/vectors", deduplication.VECTORS).append(stored)
    judge = Provider("rule", _rule)
    deduplication.run_deduplication(asked, folder, judge, None, "given", SAME, CROSS)

    def refuses(prompt: str, room: int, attempt: int) -> str:
        raise RuntimeError("a pair was asked about again")

    return deduplication.run_deduplication(asked, folder, Provider("rule", refuses), None, "given", SAME, CROSS)


@query(f"WITH RECURSIVE {DEDUP} {CANONICAL_ROWS}")
def deduplication_resumed(spark, sf_dir):
    return _two_runs(spark, sf_dir).canonicals


@query(f"""WITH RECURSIVE {DEDUP},
states AS (SELECT dedup_status, members FROM ({CANONICAL_ROWS}) AS c)
SELECT 'pairs' AS kind, src || ':' || verdict AS name, count(*) AS n FROM dec GROUP BY src, verdict
UNION ALL SELECT 'canonicals', dedup_status, count(*) FROM states GROUP BY dedup_status
UNION ALL SELECT 'groups', 'repeated', count(*) FILTER (WHERE members > 1) FROM states
UNION ALL SELECT 'run', 'exact_groups', count(*) FROM (SELECT norm FROM keyed GROUP BY norm HAVING count(*) > 1) AS g
UNION ALL SELECT 'run', 'exact_pairs', CAST(coalesce(sum(m * (m - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS m FROM keyed GROUP BY norm) AS g
UNION ALL SELECT 'run', 'pairs_from_store', count(*) FROM judged
UNION ALL SELECT 'run', 'pairs_judged', 0""")
def deduplication_statistics(spark, sf_dir):
    return _two_runs(spark, sf_dir).statistics


#: Arrivals of the events: six batches by number, a seventh of the rows one batch and an eleventh two batches late, a fifth again two days on.
BATCHES, LATE_DAYS = 6, 3
ARRIVED = f"""n AS (SELECT max(event_id) + 1 AS n FROM events),
own AS (SELECT event_id, event_type, ts, least({BATCHES - 1}, event_id * {BATCHES} // n + CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 THEN 2 ELSE 0 END) AS b FROM events, n),
arrived AS (
  SELECT event_id, event_type, ts, b, FALSE AS again FROM own
  UNION ALL SELECT event_id, event_type, ts + INTERVAL 2 DAY, least({BATCHES - 1}, b + 1 + event_id % 3), TRUE FROM own WHERE event_id % 5 = 0 AND b < {BATCHES - 1}),
seen AS (SELECT i AS b, (SELECT max(ts) FROM arrived WHERE arrived.b < i) - INTERVAL {LATE_DAYS} DAY AS mark FROM range(0, {BATCHES + 1}) AS t(i)),
live AS (
  SELECT arrived.*, late.mark AS late_mark FROM arrived LEFT JOIN seen AS late ON late.b = arrived.b - 1)"""


def _arrivals(spark, sf_dir, scratch: Scratch):
    """The events as a stream of BATCHES files, one a micro-batch."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    total = events.agg(F.max("event_id")).first()[0] + 1
    late = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 11 == 0, 2).otherwise(0)
    own = events.withColumn("b", F.least(F.lit(BATCHES - 1), F.floor(F.col("event_id") * BATCHES / total) + late))
    again = own.where((F.col("event_id") % 5 == 0) & (F.col("b") < BATCHES - 1))
    again = again.select("event_id", "event_type", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.least(F.lit(BATCHES - 1), F.col("b") + 1 + F.col("event_id") % 3).alias("b"))
    rows = scratch.keep(own.unionByName(again), "rows")
    for b in range(BATCHES):
        rows.where(F.col("b") == b).coalesce(1).write.mode("append").parquet(scratch.path("arrived"))
    return stream_table(spark, scratch.path("arrived"), rows.schema, files_per_trigger=1)


@query(f"""WITH {ARRIVED},
firsts AS (SELECT * FROM live WHERE NOT again AND (late_mark IS NULL OR ts > late_mark)),
repeats AS (
  SELECT live.* FROM live LEFT JOIN firsts ON firsts.event_id = live.event_id
  WHERE live.again AND (live.late_mark IS NULL OR live.ts > live.late_mark)
    AND (firsts.event_id IS NULL OR firsts.ts + INTERVAL {LATE_DAYS} DAY <= live.late_mark))
SELECT event_id, event_type, ts FROM firsts UNION ALL SELECT event_id, event_type, ts FROM repeats""")
def stream_dedupe_watermarked(spark, sf_dir):
    """First arrivals within the watermark; what is known of an event is dropped with it, so that a repeat long after counts as new."""
    scratch = Scratch(spark, "stream-dedupe")
    rows = deduplicated(_arrivals(spark, sf_dir, scratch), ["event_id"], "ts", f"{LATE_DAYS} days")
    out = scratch.path("kept")
    run_available(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), scratch.path("progress"))
    return spark.read.parquet(out).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {ARRIVED},
days AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, late_mark FROM live)
SELECT start, event_type, count(*) AS n FROM days
WHERE (late_mark IS NULL OR start + INTERVAL 1 DAY > late_mark) AND start + INTERVAL 1 DAY <= (SELECT mark FROM seen WHERE b = {BATCHES}) GROUP BY start, event_type""")
def stream_window_counts(spark, sf_dir):
    """Daily counts that are final: a day is given once the watermark has passed it, and later rows of it are left out."""
    scratch = Scratch(spark, "stream-counts")
    rows = windowed_counts(_arrivals(spark, sf_dir, scratch), "ts", "event_type", "1 day", f"{LATE_DAYS} days")
    out = scratch.path("kept")
    run_available(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), scratch.path("progress"))
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
