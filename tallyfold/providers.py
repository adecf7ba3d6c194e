"""Model calls as pluggable providers, with bounded retries and recorded answers."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import QUOTA_MARKERS

RETRIES, MAX_TOKENS, TOKEN_GROWTH, TOKEN_LIMIT = 3, 6_000, 1.5, 16_000
MODELS_PER_REQUEST = 3


class ProviderError(Exception):
    """A failed call; only some may be tried again, and some say that no calls are left."""

    def __init__(self, message: str, retryable: bool = True, out_of_quota: bool = False):
        super().__init__(f"out of quota: {message}" if out_of_quota else message)
        self.retryable, self.out_of_quota = retryable, out_of_quota


class Completion(str):
    """A JSON text that knows the model that wrote it and the tokens it took."""

    model: str | None = None
    tokens_in: int = 0
    tokens_out: int = 0

    @classmethod
    def of(cls, text: str, model: str | None, tokens_in: int | None, tokens_out: int | None) -> Completion:
        out = cls(text)
        out.model, out.tokens_in, out.tokens_out = model, tokens_in or 0, tokens_out or 0
        return out


@dataclass(frozen=True)
class Provider:
    """complete(prompt, max_tokens, attempt) gives a JSON text (a ``Completion`` where it knows more); name is part of the key of recorded answers."""

    name: str
    complete: Callable[[str, int, int], str]


def rotated(models: list[str], attempt: int, width: int = MODELS_PER_REQUEST) -> list[str]:
    """The models to try on an attempt: ``width`` of them, beginning one further each time."""
    start = (attempt - 1) % len(models)
    return (models + models)[start : start + min(width, len(models))]


def classify_error(status: int, message: str) -> ProviderError:
    low = message.lower()
    daily = any(m in low for m in QUOTA_MARKERS)
    if status in (401, 402):
        return ProviderError(message, retryable=False, out_of_quota=status == 402)
    if status == 429 and daily:
        return ProviderError(message, retryable=False, out_of_quota=True)
    return ProviderError(message, retryable=True)


@dataclass
class Metrics:
    """What a run's calls came to."""

    calls: int = 0
    attempts: int = 0
    failures: int = 0
    truncations: int = 0


Check = Callable[[dict], str | None]


def call(provider: Provider, prompt: str, check: Check | None = None, used: dict | None = None) -> tuple[dict | None, str | None, int, bool]:
    """Answer, error, attempts, and whether every failure was an answer cut off.

    An answer must be a JSON object that ``check`` has nothing to say against; one
    that was cut off is asked for again with more room. ``used`` is given the tokens
    of all attempts and the model of the last one.
    """
    used = {} if used is None else used
    room, error, cut = MAX_TOKENS, None, 0
    for attempt in range(1, RETRIES + 1):
        try:
            said = provider.complete(prompt, room, attempt)
            if isinstance(said, Completion):
                used["used_model"] = said.model
                used["tokens_in"] = used.get("tokens_in", 0) + said.tokens_in
                used["tokens_out"] = used.get("tokens_out", 0) + said.tokens_out
            text = said.strip()
            if text.startswith("```") and text.endswith("```") and len(text) > 3:
                text = text.strip("`").removeprefix("json").strip()
            answer = json.loads(text)
            error = "not an object" if not isinstance(answer, dict) else check(answer) if check else None
            if error is None:
                return answer, None, attempt, False
        except ProviderError as failed:
            if failed.out_of_quota:
                raise
            error = str(failed)
            if not failed.retryable:
                return None, error, attempt, False
        except ValueError as failed:
            error = f"not JSON: {failed}"
            if text and not text.endswith("}"):
                cut += 1
                room = min(TOKEN_LIMIT, int(room * TOKEN_GROWTH))
    return None, error, RETRIES, cut == RETRIES


def required(fields: dict[str, type], lists: dict[str, int] | None = None) -> Check:
    """A check that an answer has the named fields of the given types, and lists no longer than allowed."""

    def check(answer: dict) -> str | None:
        for name, kind in fields.items():
            if not isinstance(answer.get(name), kind):
                return f"{name} is missing or of another type"
        for name, most in (lists or {}).items():
            if isinstance(answer.get(name), list) and len(answer[name]) > most:
                return f"{name} has more than {most} entries"
        return None

    return check


def entries(name: str, rules: dict[str, Callable[[object], bool]], whole: Callable[[dict], bool] | None = None, least: int = 0) -> Check:
    """A check that every entry of the list ``name`` is an object whose fields keep their ``rules``, and which ``whole`` accepts."""

    def check(answer: dict) -> str | None:
        found = answer.get(name) or []
        if len(found) < least:
            return f"{name} has fewer than {least} entries"
        for i, entry in enumerate(found):
            if not isinstance(entry, dict):
                return f"{name}[{i}] is not an object"
            for field, rule in rules.items():
                if not rule(entry.get(field)):
                    return f"{name}[{i}].{field} is missing or not allowed"
            if whole is not None and not whole(entry):
                return f"{name}[{i}]: its fields contradict each other"
        return None

    return check


def every(*checks: Check) -> Check:
    """The first objection of several checks."""
    return lambda answer: next((said for c in checks if (said := c(answer)) is not None), None)


def one_of(*allowed: str) -> Callable[[object], bool]:
    return lambda value: value in allowed


def text(value: object) -> bool:
    return isinstance(value, str)


def optional_text(value: object) -> bool:
    return value is None or isinstance(value, str)


def whole_number(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def confidence(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1


def ask(prompts: DataFrame, provider: Provider, check: Check | None = None, stage: str = "") -> DataFrame:
    """key, answer (JSON), error, attempts, truncated for prompts (key, prompt), called in batches on the executors.

    A recorded provider (``answers.Recorded``) asks only what its store has no answer
    to. With a plain one, running out of quota fails the job and its answers are lost.
    """
    if not isinstance(provider, Provider):
        return provider.ask(prompts, check, stage)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["key"], frame["prompt"]):
                answer, error, attempts, cut = call(provider, prompt, check)
                rows.append((key, None if answer is None else json.dumps(answer, sort_keys=True), error, attempts, cut))
            yield pd.DataFrame(rows, columns=["key", "answer", "error", "attempts", "truncated"])

    return prompts.select("key", "prompt").mapInPandas(run, "key string, answer string, error string, attempts int, truncated boolean")


def metrics(answers: DataFrame) -> Metrics:
    """Counts over the answers of a run, which name the model, its attempts and what failed in their columns."""
    row = answers.agg(F.count("*"), F.sum("attempts"), F.count_if(F.col("error").isNotNull()), F.count_if("truncated")).first()
    return Metrics(*[int(v or 0) for v in row])


def load_models(path: str, fallback: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The models of a JSON list; the fallback where there is no readable one."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return fallback
    models = tuple(m for m in found if isinstance(m, str) and m.strip()) if isinstance(found, list) else ()
    return models or fallback


class Scrub(logging.Filter):
    """Takes registered secrets out of log records."""

    def __init__(self, secrets: list[str]):
        super().__init__()
        self.secrets = [s for s in secrets if s]

    def filter(self, record: logging.LogRecord) -> bool:
        message = record.getMessage()
        for secret in self.secrets:
            message = message.replace(secret, "***")
        record.msg, record.args = message, ()
        return True


_LOADED: dict[tuple, object] = {}


def once(kind: str, key: object, make: Callable[[], object]) -> object:
    """A reader or model that a worker process makes once for each setting."""
    if (kind, key) not in _LOADED:
        _LOADED[kind, key] = make()
    return _LOADED[kind, key]


def embed_new(wanted: DataFrame, cache: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], model: str) -> DataFrame:
    """id, content_hash, vector, model of the texts (id, content_hash, text) that the cache has no vector of; ``load`` gives the embedder."""
    todo = wanted.join(cache.where(F.col("model") == model).select("id", "content_hash"), ["id", "content_hash"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = once("embedder", model, load)(list(frame["text"])) if len(frame) else []
            yield pd.DataFrame({"id": frame["id"], "content_hash": frame["content_hash"], "vector": vectors})

    kind = wanted.schema["id"].dataType.simpleString()
    made = todo.select("id", "content_hash", "text").mapInPandas(run, f"id {kind}, content_hash string, vector array<double>")
    return made.withColumn("model", F.lit(model))
