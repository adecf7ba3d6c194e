"""Recorded answers of models: what was answered once is not asked again.

An answer's key is the model, the stage and the hash of the prompt. Prompts without
an answer are asked in waves of a bounded number for each task, and every wave is
appended as it ends. A task that is told that no calls are left returns its other
prompts unasked instead of failing, so that all answers of the wave are kept; the
run then stops as paused, and the next one asks exactly what is missing. A lost
executor costs its task's share of one wave.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .providers import Check, Provider, ProviderError, call
from .scratch import Scratch, exists

#: Prompts of one task in a wave.
PROMPTS_PER_TASK = 20
ANSWERED, FAILED, UNASKED = "answered", "failed", "unasked"
ROWS = (
    "stage string, model string, prompt_hash string, status string, answer string, error string, attempts int, truncated boolean, "
    "seconds double, tokens_in long, tokens_out long, used_model string, run string, wave int"
)
ANSWERS = "key string, answer string, error string, attempts int, truncated boolean"


@dataclass
class RunMetrics:
    """What the calls of a run came to; they are summed beside the waves, and are there when a run is paused."""

    calls: int = 0
    answered: int = 0
    attempts: int = 0
    truncations: int = 0
    seconds: float = 0.0
    tokens_in: int = 0
    tokens_out: int = 0

    def add(self, seen: dict) -> None:
        for f in fields(self):
            setattr(self, f.name, getattr(self, f.name) + (seen.get(f.name) or 0))


class AnswerStore:
    """An append-only table of answers; a failed call is recorded too, but counts as not answered."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """Every recorded call; none where nothing was stored yet."""
        if exists(self.spark, self.path):
            return self.spark.read.schema(ROWS).parquet(self.path)
        return self.spark.createDataFrame([], ROWS)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def latest(self, stage: str, model: str) -> DataFrame:
        """One row of each prompt: an answer before a failure, later runs' failures before earlier ones."""
        mine = self.rows().where((F.col("stage") == stage) & (F.col("model") == model))
        best = F.max(F.struct(F.col("status") == ANSWERED, "run", "answer", "error", "attempts", "truncated")).alias("best")
        return mine.groupBy("prompt_hash").agg(best).select("prompt_hash", "best.answer", "best.error", "best.attempts", "best.truncated")

    def totals(self) -> DataFrame:
        """Calls, answers, attempts, seconds and tokens of every stage and model, over all runs."""
        answered = F.count_if(F.col("status") == ANSWERED).alias("answered")
        sums = [F.sum(c).alias(c) for c in ("attempts", "seconds", "tokens_in", "tokens_out")]
        return self.rows().groupBy("stage", "model").agg(F.count("*").alias("calls"), answered, F.count_if("truncated").alias("truncations"), *sums)


@dataclass
class Recorded:
    """A provider whose answers are kept in a store; it stands wherever a provider does."""

    provider: Provider
    store: AnswerStore
    per_task: int = PROMPTS_PER_TASK

    def __post_init__(self) -> None:
        self.metrics = RunMetrics()
        # Names of runs are in the order of their beginning.
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    @property
    def name(self) -> str:
        return self.provider.name

    def ask(self, prompts: DataFrame, check: Check | None, stage: str) -> DataFrame:
        """key, answer, error, attempts, truncated of prompts (key, prompt), from the store where it has an answer."""
        spark = self.store.spark
        scratch = Scratch(spark, "ask")
        keyed = scratch.keep(prompts.select("key", "prompt", F.sha2("prompt", 256).alias("prompt_hash")), "prompts")
        held = self.store.latest(stage, self.name).where(F.col("answer").isNotNull()).select("prompt_hash")
        missing = keyed.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt")).join(held, "prompt_hash", "left_anti")
        tasks = max(1, spark.sparkContext.defaultParallelism)
        missing = scratch.keep(missing, "missing")
        waves = max(1, -(-missing.count() // (tasks * self.per_task)))
        dealt = missing.withColumn("wave", F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)).cast("int"))
        dealt = scratch.keep(dealt.repartition("wave"), "dealt", partition_by=["wave"])
        for wave in range(waves):
            self._wave(dealt.where(F.col("wave") == wave).repartition(tasks), check, stage, wave)
        answers = keyed.join(self.store.latest(stage, self.name), "prompt_hash", "left")
        return scratch.keep(answers.select("key", "answer", "error", "attempts", "truncated"), "answers")

    def _wave(self, prompts: DataFrame, check: Check | None, stage: str, wave: int) -> None:
        provider, run, model = self.provider, self.run, self.name
        schema = to_arrow_schema(StructType.fromDDL(ROWS))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spent = False
            for batch in batches:
                rows = []
                for code, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                    row = {"stage": stage, "model": model, "prompt_hash": code, "run": run, "wave": wave}
                    if not spent:
                        began, used = time.monotonic(), {}
                        try:
                            answer, error, attempts, cut = call(provider, prompt, check, used)
                            said = None if answer is None else json.dumps(answer, sort_keys=True)
                            row |= {"status": FAILED if said is None else ANSWERED, "answer": said, "error": error, "attempts": attempts, "truncated": cut}
                            row |= {"seconds": time.monotonic() - began} | used
                        except ProviderError as failed:
                            if not failed.out_of_quota:
                                raise
                            spent = True
                    rows.append({"status": UNASKED} | row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        seen = Observation()
        asked = F.col("status") != UNASKED
        sums = [F.sum(c).alias(c) for c in ("attempts", "seconds", "tokens_in", "tokens_out")]
        counts = [F.count_if(asked).alias("calls"), F.count_if(F.col("status") == ANSWERED).alias("answered"), F.count_if("truncated").alias("truncations")]
        rows = prompts.select("prompt_hash", "prompt").mapInArrow(ask, ROWS)
        self.store.append(rows.observe(seen, F.count_if(~asked).alias("left"), *counts, *sums).where(asked))
        self.metrics.add(seen.get)
        if seen.get["left"]:
            raise ProviderError(f"{seen.get['left']} prompts of {stage} are left in this wave", retryable=False, out_of_quota=True)
