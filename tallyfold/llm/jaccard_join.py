"""N-gram Jaccard join by prefix filters under several global token orders.

The orders are: the hash order of all shingles; the order by document frequency
of the shingles that the first filter looks at; and a second hash order. Two sets
whose Jaccard similarity reaches the threshold share enough of their first
shingles under each of them, so that a pair that fails one needs no verification.

1. Each document sends only the start of its set in hash order (the extended
   prefix: l more shingles than the plain prefix filter needs, of which a
   partner must share l). Shingles go out in compact blocks per hash range.
2. A range counts how many documents sent each shingle and answers for those
   sent more than once. Documents with fewer than l such answers have no partner.
3. The others keep the rarest of their answers (the prefix in frequency order,
   needed overlap l); these make the postings. Postings of the same documents
   are one bucket, and buckets that share documents make a cluster. Documents of
   different clusters cannot link.
4. In large clusters every document is first compared with the one that leads
   most of its buckets, where the member with the fewest shingles of its own
   leads. A group of n near copies costs n comparisons here.
5. What stays apart is compared with all other components of its cluster in
   tasks of bounded size: documents must share prefixes in hash order and in
   the second hash order, and then the exact overlap counts. A task returns only
   the links that join components. Large clusters are cut into a grid of tasks,
   the documents outside the largest component against all.
6. Links are counted inside the components that came out: all different sets of
   one meet in a grid of bounded tasks, behind the same filters. A task returns
   one sum per document, weighed by how many documents hold the other set, so
   that neither copies nor pairs are ever written.

Sets are held as 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..scratch import Scratch
from .words import scramble, shingle_hashes, spaced_words

WIDTH = 5
PERCENT = 80
#: The overlap l that partners must have in their extended prefixes: one in EXTRA of a set.
EXTRA = 5
#: Shingles a block-building step holds at once.
CHUNK_SHINGLES = 1_500_000
CHUNK_ROWS = 1_000
#: Clusters beyond this many documents are compared with leaders first; a task holds about TASK_DOCS documents of a side.
LARGE_CLUSTER = 200
TASK_DOCS = 2_000
#: Shingles that a side of a counting task holds, apart from a single longer document.
TASK_SHINGLES = 2_000_000

SKETCH = "doc_id long, n long, set_a long, set_b long, part int, tokens binary, ids binary"
_LOW = np.uint64((1 << 40) - 1)


def needed(n: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-n * PERCENT // 100)


def extra(n: int) -> int:
    return max(1, n // EXTRA)


def sent_length(n: int) -> int:
    """Length of the extended prefix."""
    return n - needed(n) + extra(n)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit values, byte position by byte position."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    size = len(data) // width
    full = np.zeros((size, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8).reshape(width, size).T
    return full.view("<u8").reshape(-1)


def _blocks(ids: list[int], prefixes: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Per hash range: the low 40 bits of the shingles and the differences of their documents' ids."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    owner = np.repeat(np.array([ids[i] for i in order], np.int64), [len(prefixes[i]) for i in order])
    tokens = np.concatenate([prefixes[i] for i in order])
    part = ((tokens >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
    by_part = np.argsort(part, kind="stable")
    part, tokens, owner = part[by_part], tokens[by_part] & _LOW, owner[by_part]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for k, (t, o) in enumerate(zip(np.split(tokens, cuts), np.split(owner, cuts))):
        steps = np.concatenate([o[:1], np.diff(o)]).view(np.uint64)
        yield int(part[0 if k == 0 else cuts[k - 1]]), _planes(t, 5), _planes(steps[:1], 8) + _planes(steps[1:], 8)


def _sketches(parts: int, width: int):
    """Per document its set size and set fingerprint; per chunk of documents the blocks of extended prefixes."""

    def flush(ids: list[int], prefixes: list[np.ndarray]) -> pa.RecordBatch:
        blocks = list(_blocks(ids, prefixes, parts))
        empty = [None] * len(blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array(empty, pa.int64())] * 4
            + [
                pa.array([b[0] for b in blocks], pa.int32()),
                pa.array([b[1] for b in blocks], pa.binary()),
                pa.array([b[2] for b in blocks], pa.binary()),
            ],
            names=["doc_id", "n", "set_a", "set_b", "part", "tokens", "ids"],
        )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                info = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    tokens = shingle_hashes(spaced_words(text.as_py()), width)
                    n = len(tokens)
                    info.append((doc_id, n, tokens.sum(dtype=np.uint64).astype(np.int64), scramble(tokens ^ np.uint64(n)).sum(dtype=np.uint64).astype(np.int64)))
                    if n and doc_id is not None:
                        held_ids.append(doc_id)
                        held.append(tokens[: sent_length(n)].copy())
                        size += len(held[-1])
                nulls = [None] * len(info)
                columns = zip(*info)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns] + [pa.array(nulls, pa.int32()), pa.array(nulls, pa.binary()), pa.array(nulls, pa.binary())],
                    names=["doc_id", "n", "set_a", "set_b", "part", "tokens", "ids"],
                )
                if size >= CHUNK_SHINGLES:
                    yield flush(held_ids, held)
                    held_ids, held, size = [], [], 0
        if held:
            yield flush(held_ids, held)

    return sketch


def _answers(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """doc_id, token and the number of documents that sent it, for tokens sent more than once."""
    tokens = np.concatenate([_unplanes(b, 5) for b in blocks["tokens"]])
    owner = np.concatenate([np.cumsum(np.concatenate([_unplanes(b[:8], 8), _unplanes(b[8:], 8)]).view(np.int64)) for b in blocks["ids"]])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.append(starts, len(tokens)))
    sent = np.repeat(counts, counts)
    shared = sent > 1
    return pd.DataFrame(
        {"doc_id": owner[shared], "token": tokens[shared].astype(np.int64) | (int(key[0]) << 40), "sent": sent[shared].astype(np.int64)}
    )


def _full_sets(width: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                sets = [shingle_hashes(spaced_words(t.as_py()), width) for t in part.column(1)]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "shingles"])

    return build


class _Index:
    """Documents by token."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))
        self.size = len(sets)

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each document has."""
        at = np.searchsorted(self.tokens, tokens)
        inside = at < len(self.tokens)
        at = at[inside][self.tokens[at[inside]] == tokens[inside]]
        if not len(at):
            return np.zeros(self.size, np.int64)
        return np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(self.starts[at], self.ends[at])]), minlength=self.size)


def _second_prefix(tokens: np.ndarray) -> np.ndarray:
    turned = np.sort(scramble(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    return turned[: len(tokens) - needed(len(tokens)) + 1]


class _Filters:
    """Sets by their prefixes under two orders and by all their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.every = _Index(sets)
        self.first = _Index([s[: len(s) - needed(len(s)) + 1] for s in sets])
        self.second = _Index([_second_prefix(s) for s in sets])

    def near(self, tokens: np.ndarray) -> np.ndarray:
        """Which sets are of a fitting size and share the prefix in hash order."""
        n = len(tokens)
        shared = self.first.shared(tokens[: n - needed(n) + 1]) > 0
        return shared & (100 * self.sizes >= PERCENT * n) & (100 * n >= PERCENT * self.sizes)

    def linked(self, tokens: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Which of the near sets share the second prefix too and reach the threshold."""
        near = near & (self.second.shared(_second_prefix(tokens)) > 0)
        if not near.any():
            return near
        both = self.every.shared(tokens)
        return near & (100 * both >= PERCENT * (len(tokens) + self.sizes - both))


def _sets_of(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(s, np.int64).view(np.uint64) for s in rows["shingles"]]


def _joining_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of a task's documents, one for each time that two of them join."""
    sets = _sets_of(rows)
    ids, mine = rows["doc_id"].to_numpy(), rows["mine"].to_numpy()
    held = np.flatnonzero(rows["held"].to_numpy())
    root = {c: c for c in rows["component"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    component = rows["component"].to_numpy()
    out: list[tuple[int, int]] = []
    if len(held) and mine.any():
        filters = _Filters([sets[i] for i in held])
        for u in np.flatnonzero(mine):
            near = filters.near(sets[u]) & (ids[held] != ids[u])
            own = find(component[u])
            if not any(find(component[held[k]]) != own for k in np.flatnonzero(near)):
                continue
            for k in np.flatnonzero(filters.linked(sets[u], near)):
                a, b = find(component[u]), find(component[held[k]])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[u]), int(ids[held[k]])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _count_links(rows: pd.DataFrame) -> pd.DataFrame:
    """How many documents hold the sets that each of a task's sets links with; two sides that meet are counted for both."""
    sets, ids, weight = _sets_of(rows), rows["doc_id"].to_numpy(), rows["weight"].to_numpy()
    mine, holds = rows["mine"].to_numpy(), rows["held"].to_numpy()
    held = np.flatnonzero(holds)
    links = np.zeros(len(rows), np.int64)
    if len(held) and mine.any():
        filters = _Filters([sets[i] for i in held])
        for u in np.flatnonzero(mine):
            to = held[filters.linked(sets[u], filters.near(sets[u]) & (ids[held] != ids[u]))]
            links[u] += weight[to].sum()
            if not holds[u]:
                links[to] += weight[u]
    return pd.DataFrame({"doc_id": ids[links > 0], "links": links[links > 0]})


def _least(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def _postings(answers: DataFrame, representatives: DataFrame) -> DataFrame:
    """token, doc_id and alone of the frequency-order prefixes of documents that may have a partner.

    ``alone`` counts the sent shingles that no other document sent.
    """
    # ``least_extra``: the overlap that even the smallest possible partner asks for.
    known = answers.join(representatives, "doc_id")
    each = Window.partitionBy("doc_id")
    least_extra = F.greatest(F.lit(1), F.floor(_least(F.col("n")) / EXTRA))
    ranked = known.select(
        "doc_id",
        "token",
        (F.col("n") - _least(F.col("n")) + F.greatest(F.lit(1), F.floor(F.col("n") / EXTRA))).alias("sent_length"),
        F.count("*").over(each).alias("shared"),
        F.row_number().over(each.orderBy("sent", "token")).alias("rank"),
        least_extra.alias("least_extra"),
    )
    kept = ranked.where(F.col("rank") <= F.col("shared") - F.col("least_extra") + 1)
    return kept.select("token", "doc_id", (F.col("sent_length") - F.col("shared")).alias("alone"))


def _buckets(postings: DataFrame) -> DataFrame:
    """The postings of one token for each distinct group of at least two documents."""
    members = postings.groupBy("token").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "doc_id").cast("decimal(38,0)")).alias("s")
    )
    chosen = members.where(F.col("size") > 1).groupBy("size", "x", "s").agg(F.min("token").alias("token")).select("token")
    return postings.join(chosen, "token", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share a prefix in hash order and whose sets reach the threshold."""
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    prefix = lambda s, n: F.slice(s, F.lit(1), (n - _least(n) + 1).cast("int"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    rows = pairs.join(right, "b").join(left, "a")
    rows = rows.where(F.arrays_overlap(prefix(F.col("set_a"), F.col("n_a")), prefix(F.col("set_b"), F.col("n_b"))))
    return rows.where(100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _leader_pairs(buckets: DataFrame, members: DataFrame) -> DataFrame:
    """Each document of a large cluster with the one that leads most of its buckets."""
    large = buckets.join(members.where(F.col("docs") > LARGE_CLUSTER).select("doc_id"), "doc_id", "left_semi")
    leads = large.groupBy("token").agg(F.min(F.struct("alone", "doc_id")).getField("doc_id").alias("a"))
    led = large.join(leads, "token").where(F.col("a") != F.col("doc_id")).groupBy("doc_id", "a").agg(F.count("*").alias("n"))
    best = led.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("a")).alias("last"), "a")).getField("a").alias("a"))
    return best.select("a", F.col("doc_id").alias("b"))


def _tasks(members: DataFrame, components: DataFrame, spread: int) -> DataFrame:
    """task, doc_id, component, mine (to be compared with the task's held documents), held."""
    joined = members.join(components, members.doc_id == components.id, "left")
    known = joined.select("cluster", "docs", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = known.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cluster").agg(
        F.max(F.struct("size", (-F.col("component")).alias("last"))).alias("top"), F.sum("size").alias("all")
    )
    largest = largest.select(F.col("cluster").alias("of"), (-F.col("top.last")).alias("main"), (F.col("all") - F.col("top.size")).alias("outside"))
    rows = known.join(largest, F.col("cluster") == F.col("of")).where(F.col("outside") > 0)
    mine = F.col("component") != F.col("main")
    across = F.ceil(F.col("docs") / TASK_DOCS).cast("int")
    down = F.ceil(F.col("outside") / TASK_DOCS).cast("int")
    slot = F.pmod(F.xxhash64("doc_id"), across)
    row = F.pmod(F.xxhash64(F.lit("row"), "doc_id"), down)
    small = rows.where(F.col("docs") <= TASK_DOCS).select(
        F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(spread))).alias("task"), "doc_id", "component", mine.alias("mine"), F.lit(True).alias("held")
    )
    big = rows.where(F.col("docs") > TASK_DOCS).withColumns({"down": down, "across": across, "slot": slot, "row": row})
    held = big.select("*", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i")).select(
        F.concat_ws(":", F.lit("b"), "cluster", "i", "slot").alias("task"), "doc_id", "component", F.lit(False).alias("mine"), F.lit(True).alias("held")
    )
    asked = big.where(mine).select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j")).select(
        F.concat_ws(":", F.lit("b"), "cluster", "row", "j").alias("task"), "doc_id", "component", F.lit(True).alias("mine"), F.lit(False).alias("held")
    )
    return small.unionByName(held).unionByName(asked)


def _counting_tasks(sets: DataFrame, labels: DataFrame, same: DataFrame) -> DataFrame:
    """task, doc_id, shingles, weight, mine, held: the sets of each component, large ones cut into sides that meet pairwise."""
    weights = same.groupBy(F.col("first").alias("doc_id")).agg(F.max("members").alias("weight"))
    known = sets.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id")
    counts = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / TASK_DOCS), F.ceil(F.sum("n") / TASK_SHINGLES)).cast("int").alias("sides"))
    sums = known.agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
    spread = 1 + sums["docs"] // TASK_DOCS + (sums["n"] or 0) // TASK_SHINGLES
    rows = known.join(counts, "component").join(weights, "doc_id").withColumn("side", F.pmod(F.xxhash64("doc_id"), "sides").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    met = rows.select("component", "sides", "side", "doc_id", "shingles", "weight", other)
    small = F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(spread)))
    large = F.concat_ws(":", F.lit("b"), "component", F.least("side", "other"), F.greatest("side", "other"))
    return met.select(
        F.when(F.col("sides") == 1, small).otherwise(large).alias("task"),
        "doc_id",
        "shingles",
        "weight",
        (F.col("side") <= F.col("other")).alias("mine"),
        (F.col("side") >= F.col("other")).alias("held"),
    )


def shingle_components(docs: DataFrame, width: int = WIDTH, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of ``docs`` (columns doc_id, text).

    Words are maximal runs without blanks, A-Z lower-cased; a set holds the
    distinct runs of ``width`` words, or the whole of a shorter text. Documents
    link at a Jaccard similarity of 0.8; component_id is the smallest doc_id that
    links reach, n_links how many other documents a document links with, those of
    the same set included (left out without ``count_links``). Texts without words
    (null too) have an empty set and link with nothing; a null doc_id has a null
    component and null links. Rows repeated with one doc_id are copies of one
    document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = texts.where(F.col("doc_id").isNotNull())
    sketch = scratch.keep(texts.mapInArrow(_sketches(parts, width), SKETCH), "sketch")
    info = scratch.keep(sketch.where(F.col("part").isNull()).select("doc_id", "n", "set_a", "set_b"), "info")
    same = info.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).distinct()
    same = same.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    same = scratch.keep(same, "classes")
    representatives = same.select(F.col("first").alias("doc_id"), "n").distinct()
    answers = sketch.where(F.col("part").isNotNull()).select("part", "tokens", "ids")
    answers = answers.groupBy("part").applyInPandas(_answers, "doc_id long, token long, sent long")
    postings = scratch.keep(_postings(answers, representatives), "postings")
    scratch.drop("sketch")
    left = scratch.keep(_buckets(postings), "buckets-0")
    partners = scratch.keep(left.select("doc_id").distinct(), "partners")
    mine = named.join(partners, "doc_id", "left_semi").mapInArrow(_full_sets(width), "doc_id long, n long, shingles array<long>")
    sets = scratch.keep(mine.dropDuplicates(["doc_id"]), "sets")

    edges = left.join(left.groupBy("token").agg(F.min("doc_id").alias("b")), "token").select(F.col("doc_id").alias("a"), "b")
    clusters = scratch.keep(connected_components(edges, scratch=Scratch(spark, "jaccard-clusters")), "clusters")
    counts = clusters.groupBy("component").agg(F.count("*").alias("docs"))
    members = clusters.join(counts, "component").select(F.col("component").alias("cluster"), F.col("id").alias("doc_id"), "docs")
    members = scratch.keep(members, "members")
    joined = scratch.keep(_verified(_leader_pairs(left, members), sets), "leader-links")
    led = scratch.keep(connected_components(joined, scratch=Scratch(spark, "jaccard-led")), "led")
    spread = max(1, partners.count() // TASK_DOCS)
    work = _tasks(members, led, spread).join(sets.select("doc_id", "shingles"), "doc_id")
    links = work.groupBy("task").applyInPandas(_joining_links, "a long, b long")
    every = scratch.keep(links.union(led.select(F.col("id").alias("a"), F.col("component").alias("b"))), "links")
    labels = scratch.keep(connected_components(every, scratch=Scratch(spark, "jaccard-components")), "labels")
    if count_links:
        counted = _counting_tasks(sets, labels, same).groupBy("task").applyInPandas(_count_links, "doc_id long, links long")
        counted = scratch.keep(counted.groupBy(F.col("doc_id").alias("linked_id")).agg(F.sum("links").alias("links")), "counted")
    scratch.drop("postings", "buckets-0", "partners", "sets", "clusters", "members", "leader-links", "led", "links")

    classes = same.select(F.col("n").alias("n_c"), F.col("set_a").alias("a_c"), F.col("set_b").alias("b_c"), "first", "members")
    joined = info.join(classes, (F.col("n") == F.col("n_c")) & (F.col("set_a") == F.col("a_c")) & (F.col("set_b") == F.col("b_c")), "left")
    joined = joined.join(labels, F.col("first") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")]
    if count_links:
        joined = joined.join(counted, F.col("first") == F.col("linked_id"), "left")
        others = F.coalesce(F.col("members") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
        out.append(F.when(F.col("doc_id").isNotNull(), others).alias("n_links"))
    return joined.select(*out)
