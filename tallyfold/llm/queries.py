"""The operators over their whole tables, reduced to the columns of the contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_tree import ball_tree_clusters
from .bpe import encode_documents
from .contamination import find_contamination
from .context_mixing import score_documents
from .jaccard_join import shingle_components
from .learned_partitions import search_neighbours
from .licenses import scan_licenses
from .line_runs import dedup_lines
from .perspectives import rotate_perspectives
from .repair import repair_conversations
from .secret_scan import scan_secrets
from .toxicity import THRESHOLD, score_toxicity, train_toxicity
from .wrappers import extract_main_text

TOKENIZER_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_held_out() -> Column:
    """Rows that no label may be learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~toxicity_held_out())
    out = score_toxicity(docs, model, keep_text=False).withColumn("held_out", toxicity_held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), training)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep_text=False)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    digest = F.sha2("segment", 256).alias("segment_sha256")
    return out.select("conv_id", "perspective", "position", "speaker", digest, "start", "stop", "mask_start", "mask_stop")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies, after the contract's damage by crc32 of ``conv_id:turn``; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(harm == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(harm == 1, F.lit("")).when(harm == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), F.col("copies"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_context_mixing": op3_context_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_learned_partitions": op5_learned_partitions,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_perspectives": op10_perspectives,
    "op11_repair": op11_repair,
    "op12_ball_tree": op12_ball_tree,
    "op13_wrappers": op13_wrappers,
}


def ball_tree_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """SQL of op12: the same assignments and means over all vectors, a pair of expressions for each round."""
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v AS w
  FROM kept ORDER BY sha256('1:' || vec_id) NULLS LAST, v LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v,
         min(CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * {k} + c) AS best
  FROM kept, c{r} GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""p{r} AS (SELECT best % {k} AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}),
m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM p{r} GROUP BY c, i),
c{r + 1} AS (
  SELECT c{r}.c AS c, coalesce(moved.w, c{r}.w) AS w
  FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM m{r} GROUP BY c) AS moved ON moved.c = c{r}.c)""")
    return f"""WITH {", ".join(parts)},
found AS (SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM found JOIN c{rounds} ON c = cluster"""

ORACLE_SQL: dict[str, str] = {
    "op11_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
crcs AS (
  SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''),
         lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, x: xor(xor(a, x) // 2, 3988292384 * (xor(a, x) % 2))) AS r
  FROM keyed),
harmed AS (SELECT *, (4294967295 - r) % 20 AS h FROM crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS again
  FROM harmed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS c
  FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, i, c, said = '' AS blank,
         said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice,
         lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS then_c, right(said, 1) NOT IN ('.', '!', '?') AS open_end
  FROM placed),
turns AS (
  SELECT *, blank OR twice AS gone, CASE WHEN NOT blank AND NOT twice AND open_end THEN 3 ELSE 0 END AS extra FROM judged),
sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE twice) AS duplicate, count(*) FILTER (WHERE extra > 0) AS truncated,
         count(*) FILTER (WHERE c || then_c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
raw AS (
  SELECT conv_id, n + 1 AS i, CAST(0 AS BIGINT) AS c0, CAST(6 AS BIGINT) AS c1, CAST(3 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS c3 FROM sizes
  UNION ALL
  SELECT conv_id, i, least(b0, 3 + b2, 6 + b3), least(b1, 3 + b2, 6 + b3), least(b2, 3 + b3), least(b3, 3 + b2)
  FROM (
    SELECT turns.conv_id AS conv_id, turns.i AS i,
           CASE WHEN gone THEN 4 + c0 ELSE least(4 + c0, 3 + extra + c2, CASE c WHEN 's' THEN extra + c1 WHEN 'u' THEN extra + c2 END) END AS b0,
           CASE WHEN gone THEN 4 + c1 ELSE least(4 + c1, 3 + extra + c2, CASE c WHEN 'u' THEN extra + c2 END) END AS b1,
           CASE WHEN gone THEN 4 + c2 ELSE least(4 + c2, 3 + extra + c3, CASE c WHEN 'a' THEN extra + c3 END) END AS b2,
           CASE WHEN gone THEN 4 + c3 ELSE least(4 + c3, 3 + extra + c2, CASE c WHEN 'u' THEN extra + c2 END) END AS b3
    FROM raw JOIN turns ON turns.conv_id IS NOT DISTINCT FROM raw.conv_id AND turns.i = raw.i - 1) AS before),
costs AS (SELECT conv_id, i, [c0, c1, c2, c3] AS f FROM raw),
pairs AS (
  SELECT a.conv_id AS conv_id, a.i AS i, a.f AS f, b.f AS g, gone, extra, role, text, c, b.i IS NULL AS done
  FROM costs a LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1
  LEFT JOIN turns ON turns.conv_id IS NOT DISTINCT FROM a.conv_id AND turns.i = a.i),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM sizes
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nxt END, audit || e,
         CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
              ELSE list_append(said, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE WHEN NOT done AND f[s] = 4 + g[s] THEN 'D' WHEN f[s] = 3 + f[nxt] THEN 'I' WHEN f[s] = extra + g[kept] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT walk.conv_id AS conv_id, walk.i AS i, s, audit, said, f, g, extra, role, text, done, CASE WHEN s = 3 THEN 4 ELSE 3 END AS nxt,
             CASE WHEN c = 's' AND s = 1 THEN 2 WHEN c = 'u' AND s <> 3 THEN 3 WHEN c = 'a' AND s = 3 THEN 4 END AS kept
      FROM walk JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM walk.conv_id AND pairs.i = walk.i
      WHERE NOT (done AND s IN (1, 4))) AS seen) AS chosen),
ends AS (
  SELECT walk.conv_id AS conv_id, audit, said FROM walk JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM walk.conv_id
  WHERE i = n + 1 AND s IN (1, 4)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(c0, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN raw ON raw.conv_id IS NOT DISTINCT FROM ids.conv_id AND raw.i = 1
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id""",
    "op12_ball_tree": ball_tree_sql(),
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT keyed.doc_id, pos, line, coalesce(owner < keyed.doc_id, FALSE) AS gone
  FROM keyed LEFT JOIN owners ON owners.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op9_decontamination": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
found AS (
  SELECT doc_id, i, places.n AS n, item_id FROM places JOIN wins
  ON wins.n = places.n AND wins.win = array_to_string(list_slice(w, i, i + places.n - 1), ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) AS t GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) AS t GROUP BY doc_id)
SELECT words.doc_id AS doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(c, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits ON hits.doc_id = words.doc_id LEFT JOIN ids ON ids.doc_id = words.doc_id""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w
  FROM documents),
starts AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT words.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, coalesce(l, 0) AS n_links
FROM words JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) AS r ON r.x = words.doc_id LEFT JOIN sizes ON sizes.doc_id = words.doc_id
LEFT JOIN (SELECT x AS linked, count(*) AS l FROM links GROUP BY x) AS k ON linked = words.doc_id""",
    "op10_perspectives": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS p FROM turns WHERE speaker <> 'system'),
seen AS (SELECT turns.*, coalesce(p, 'system') AS perspective FROM turns LEFT JOIN people ON c = conv_id),
opened AS (
  SELECT *, speaker = perspective AND speaker <> 'system' AS own,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM seen),
sized AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment, length(head) AS lead, length(head || said || '<|im_end|>' || chr(10)) AS size FROM opened),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said) - 1 AS position,
         sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till
  FROM sized)
SELECT conv_id, perspective, position, speaker, sha256(segment) AS segment_sha256,
       CAST(till - size AS BIGINT) AS start, CAST(till AS BIGINT) AS stop,
       CASE WHEN own THEN CAST(till - size + lead AS BIGINT) END AS mask_start, CASE WHEN own THEN CAST(till AS BIGINT) END AS mask_stop
FROM placed""",
}
