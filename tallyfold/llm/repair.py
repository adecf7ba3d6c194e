"""Repair of conversation structure.

Each conversation is edited at least cost into ``(s?(ua)+)?``, initials of system,
user and assistant. A backward pass over the turns holds the cost to go from every
grammar state (nothing yet, system seen, user seen, answered), with insertions
relaxed before each turn; a forward walk takes, among the transitions whose cost is
tight, the one with the ASCII-least letter, and rebuilds the turns.

Rows are sorted by conversation and turn over range partitions and cut into segments
of bounded size, so that a conversation of any length is spread over tasks. One that
lies inside a partition and a segment is finished where it is read. For the others a
segment is a (min, +) matrix of four states: costs to go are carried backward over
these small rows, and the walk reads the segments in order as a stream, since the
hash of the rebuilt turns is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from ..scratch import Scratch

#: Distinct rows and characters of a segment.
SEGMENT_ROWS = 512
SEGMENT_CHARS = 1 << 18
#: Characters of role and text that place a row among the range partitions.
PLACE_CHARS = 96

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
START, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after an insertion (or a new role), and the role it takes.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
ROLES = ("user", "user", "assistant", "user")
#: States after a kept turn, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
#: Costs at the end of a conversation: what is open is completed by insertions.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
BLANKS = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}

Costs = tuple[int, int, int, int]
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<turn: long, role: string, text: string, copies: long>>"


def cost_before(after: Costs, initial: str, extra: int) -> Costs:
    """Costs to go before a turn that may be kept, from those after it."""
    user, assistant = REROLE + extra + after[ASKED], REROLE + extra + after[ANSWERED]
    costs = [min(DELETE + after[state], assistant if state == ASKED else user) for state in range(4)]
    for state, then in KEPT.get(initial, {}).items():
        costs[state] = min(costs[state], KEEP + extra + after[then])
    asked, answered = min(costs[ASKED], INSERT + costs[ANSWERED]), min(costs[ANSWERED], INSERT + costs[ASKED])
    return min(costs[START], INSERT + asked), min(costs[SYSTEM], INSERT + asked), asked, answered


class Turn:
    """A run of equal turns: its first row may stay unless it ``goes``; ``more`` rows after it are deleted."""

    __slots__ = ("role", "text", "initial", "goes", "extra", "more")

    def __init__(self, role: str, text: str, goes: bool, extra: int, more: int):
        self.role, self.text, self.initial, self.goes, self.extra, self.more = role, text, role[:1], goes, extra, more


class Walk:
    """A conversation read segment by segment, in order."""

    def __init__(self) -> None:
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.initial = None
        self.distinct = self.cost = self.made = 0
        self.state = START
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def judge(self, rows: Iterable[tuple], earlier: Iterable[int] = ()) -> list[Turn]:
        """Turns with their faults; ``earlier`` has the places of rows that an earlier segment holds too."""
        seen: set[tuple[str, str]] = set()
        gone, turns = set(earlier), []
        for place, (turn, role, text, copies) in enumerate(rows):
            if not copies:
                continue
            self._order(turn, role[:1], copies)
            said = text.strip(BLANKS)
            if not said:
                self.counts["blank"] += copies
                turns.append(Turn(role, text, True, 0, copies - 1))
                continue
            again = place in gone or (role, text) in seen
            seen.add((role, text))
            self.counts["duplicate"] += copies if again else copies - 1
            cut = not again and said[-1] not in ".!?"
            self.counts["truncated"] += cut
            turns.append(Turn(role, text, again, CUT_OFF * cut, copies - 1))
        return turns

    def _order(self, turn: int | None, initial: str, copies: int) -> None:
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += copies - 1
        self.initial = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn

    def _emit(self, role: str, text: str, kept: list[dict]) -> None:
        self.digest.update((b"\n" if self.made else b"") + f"{role}:{text}".encode())
        self.made += 1
        kept.append({"role": role, "text": text})

    def segment(self, turns: list[Turn], end: Costs) -> list[dict]:
        """Walks over the turns, towards the costs after them; the turns it keeps or makes."""
        costs: list[Costs] = [end]
        for turn in reversed(turns):
            gone = (turn.goes + turn.more) * DELETE
            after = tuple(c + turn.more * DELETE for c in costs[-1])
            costs.append(tuple(c + gone for c in costs[-1]) if turn.goes else cost_before(after, turn.initial, turn.extra))
        costs.reverse()
        kept: list[dict] = []
        for i, turn in enumerate(turns):
            if not turn.goes:
                self._step(turn, costs[i], tuple(c + turn.more * DELETE for c in costs[i + 1]), kept)
            gone = turn.goes + turn.more
            self.audit.append("D" * gone)
            self.cost += gone * DELETE
        return kept

    def _step(self, turn: Turn, here: Costs, after: Costs, kept: list[dict]) -> None:
        """One turn: insertions before it, as long as nothing tight has a smaller letter, then its own edit."""
        while here[self.state] != DELETE + after[self.state] and here[self.state] == INSERT + here[NEXT[self.state]]:
            self._insert(kept)
        then = KEPT.get(turn.initial, {}).get(self.state)
        if here[self.state] == DELETE + after[self.state]:
            self.audit.append("D")
            self.cost += DELETE
        elif then is not None and here[self.state] == KEEP + turn.extra + after[then]:
            self.audit.append("K")
            self.cost += KEEP + turn.extra
            self._emit(turn.role, turn.text, kept)
            self.state = then
        else:
            self.audit.append("R")
            self.cost += REROLE + turn.extra
            self._emit(ROLES[self.state], turn.text, kept)
            self.state = NEXT[self.state]

    def _insert(self, kept: list[dict]) -> None:
        self.audit.append("I")
        self.cost += INSERT
        self._emit(ROLES[self.state], "", kept)
        self.state = NEXT[self.state]

    def close(self) -> tuple[dict, list[dict]]:
        """The conversation's report, and the turns that complete it."""
        kept: list[dict] = []
        while self.state in (SYSTEM, ASKED):
            self._insert(kept)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        done = {"cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}
        return {"gaps": gaps} | self.counts | done, kept


def segment_matrix(turns: list[Turn]) -> list[int]:
    """Costs to go before the turns for an end that costs nothing in one state and can't be in the others, state by state."""
    columns = []
    for end in range(4):
        costs: Costs = tuple(0 if s == end else NEVER for s in range(4))
        for turn in reversed(turns):
            costs = tuple(c + turn.more * DELETE for c in costs)
            costs = tuple(c + DELETE for c in costs) if turn.goes else cost_before(costs, turn.initial, turn.extra)
        columns.append(costs)
    return [min(NEVER, columns[end][start]) for start in range(4) for end in range(4)]


def repair_conversations(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, for every conv_id of ``turns``.

    ``copies`` says for how many equal, adjacent turns a row stands (1 if not given);
    0 stands for none, but its conversation still has a row. Turns are taken by turn
    (nulls first), then role and text. A null role or text is one space, a null
    conv_id a conversation like any other. gaps, illegal pairs and faults are those
    before the repair; a conversation without turns has zeros, an empty audit and the
    hash of an empty string; texts of any length are kept whole; an empty table gives
    an empty result. Other columns are left out, whatever their names.
    """
    walked = _walked(turns, copies, keep_turns=False)
    return walked.where("last").select("conv_id", *StructType.fromDDL(REPORT).fieldNames())


def repaired_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """The rebuilt conversations: conv_id, position (from 0), role, text. See ``repair_conversations`` for the rules."""
    walked = _walked(turns, copies, keep_turns=True).select("conv_id", "before", F.posexplode("turns").alias("place", "made"))
    return walked.select("conv_id", (F.col("before") + F.col("place")).alias("position"), "made.role", "made.text")


def _walked(turns: DataFrame, copies: Column | None, keep_turns: bool) -> DataFrame:
    scratch = Scratch(turns.sparkSession, "repair")
    runs = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )
    live = F.col("copies") > 0
    runs = runs.select("conv_id", F.when(live, F.col("turn")).alias("turn"), *(F.when(live, F.col(c)).otherwise("").alias(c) for c in ("role", "text")), "copies")
    runs = runs.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    spoken = F.concat("role", F.lit("\0"), "text")
    dealt = runs.repartitionByRange(*order, F.substring(spoken, 1, PLACE_CHARS)).sortWithinPartitions(*order, spoken)
    id_type = turns.schema["conv_id"].dataType
    cut = scratch.keep(_cut(dealt, id_type, keep_turns), "segments")

    edges = cut.where("edge").select("conv_id", "seg", "rows", "keys")
    marked = scratch.keep(edges.join(_held_earlier(edges), "seg", "left").drop("keys"), "marked")
    ended = marked.join(_ends(marked, id_type), "seg").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    out = StructType().add("conv_id", id_type)
    for field in StructType.fromDDL(f"{REPORT}, last boolean, before long, turns array<struct<role: string, text: string>>"):
        out = out.add(field)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments in order; the report goes with the last one of a conversation."""
        current, found, open_ = None, {}, None

        def closed() -> dict:
            report, kept = open_.close()
            return {"conv_id": current} | report | {"last": True, "before": open_.made - len(kept), "turns": kept if keep_turns else None}

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if open_ is None or row["conv_id"] != current:
                    if open_ is not None:
                        made.append(closed())
                    current, open_ = row["conv_id"], Walk()
                before = open_.made
                kept = open_.segment(open_.judge(_tuples(row["rows"]), row["earlier"] or ()), tuple(row["end"]))
                if keep_turns:
                    made.append({"conv_id": current, "last": False, "before": before, "turns": kept})
            yield pa.RecordBatch.from_pylist(made, schema=to_arrow_schema(out))
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=to_arrow_schema(out))

    stitched = ended.select("conv_id", "rows", "earlier", "end").mapInArrow(walk, out)
    whole = cut.where(~F.col("edge")).withColumns({"last": F.lit(True), "before": F.lit(0).cast("long")}).select(*out.fieldNames())
    return whole.unionByName(stitched)


def _tuples(rows: list[dict]) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"], r["copies"]) for r in rows]


def _cut(dealt: DataFrame, id_type: DataType, keep_turns: bool) -> DataFrame:
    """Finished conversations, and segments of those that reach a partition's ends or exceed a segment."""
    out = StructType().add("conv_id", id_type)
    made_of = f"seg long, edge boolean, {REPORT}, turns array<struct<role: string, text: string>>, rows {ROWS}, keys array<binary>"
    for field in StructType.fromDDL(made_of):
        out = out.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        current, rows, chars, open_ended, made = None, [], 0, True, []

        def flush(edge: bool) -> None:
            nonlocal number
            row = {"conv_id": current, "seg": number, "edge": edge}
            number += 1
            if edge:
                row["rows"] = [dict(zip(("turn", "role", "text", "copies"), r)) for r in rows]
                row["keys"] = _keys(rows)
            else:
                walk = Walk()
                kept = walk.segment(walk.judge(rows), AT_END)
                report, last = walk.close()
                row |= report | {"turns": kept + last if keep_turns else None}
            made.append(row)

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and conv != current:
                    flush(open_ended)
                    rows, chars, open_ended = [], 0, False
                elif len(rows) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                    flush(True)
                    rows, chars, open_ended = [], 0, True
                current = conv
                rows.append(tuple(row))
                chars += len(row[1]) + len(row[2])
            yield pa.RecordBatch.from_pylist(made, schema=to_arrow_schema(out))
            made = []
        if rows:
            flush(True)
            yield pa.RecordBatch.from_pylist(made, schema=to_arrow_schema(out))

    return dealt.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, out)


def _keys(rows: list[tuple]) -> list[bytes | None]:
    """For each row that may be a duplicate of an earlier segment's, 128 bits of its role and text."""
    seen, keys = set(), []
    for _, role, text, copies in rows:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() if copies and text.strip(BLANKS) else None
        keys.append(None if key in seen else key)
        seen.add(key)
    return keys


def _held_earlier(edges: DataFrame) -> DataFrame:
    """seg, earlier: the places of rows that an earlier segment of the conversation holds too."""
    keyed = edges.select("conv_id", "seg", F.posexplode("keys").alias("place", "key")).where("key IS NOT NULL")
    first = keyed.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("seg").alias("first"))
    later = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("seg") > F.col("first")))
    return later.groupBy("seg").agg(F.collect_list("place").alias("earlier"))  # at most the rows of a segment


def _ends(marked: DataFrame, id_type: DataType) -> DataFrame:
    """seg, end: the costs to go after each segment, carried backward over the segments' matrices."""
    summary = StructType().add("conv_id", id_type)
    for field in StructType.fromDDL("seg long, matrix array<long>"):
        summary = summary.add(field)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                {"conv_id": r["conv_id"], "seg": r["seg"], "matrix": segment_matrix(Walk().judge(_tuples(r["rows"]), r["earlier"] or ()))}
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(made, schema=to_arrow_schema(summary))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, end, fresh = None, AT_END, True
        for batch in batches:
            segs, ends = [], []
            for conv, seg, m in zip(*(c.to_pylist() for c in batch.columns)):
                if fresh or conv != current:
                    current, end, fresh = conv, AT_END, False
                segs.append(seg)
                ends.append(list(end))
                end = tuple(min(m[4 * s + t] + end[t] for t in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["seg", "end"])

    summed = marked.select("conv_id", "seg", "rows", "earlier").mapInArrow(sum_up, summary)
    backward = summed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc())
    return backward.mapInArrow(carry, "seg long, end array<long>")
