"""Providers over HTTP: a hosted service with a list of models, and a server on one's own machine.

Nothing is called unless such a provider is made and used.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from .providers import Completion, Provider, ProviderError, classify_error, rotated

ERROR_CHARS = 500


def headers(key: str | None, referer: str | None = None, title: str | None = None) -> dict[str, str]:
    """Request headers; without a key no call can be made, and none is tried again."""
    if not key:
        raise ProviderError("no API key", retryable=False)
    out = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
    return out | ({"HTTP-Referer": referer} if referer else {}) | ({"X-Title": title} if title else {})


def error_message(body: str) -> str:
    """The message in an error's JSON, or the beginning of the body."""
    try:
        message = json.loads(body)["error"]["message"]
    except (ValueError, KeyError, TypeError):
        message = None
    return str(message) if message else body[:ERROR_CHARS]


def _post(url: str, body: dict | None, head: dict[str, str], seconds: float) -> dict:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), head)
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as failed:
        raise classify_error(failed.code, error_message(failed.read().decode("utf-8", "replace"))) from failed
    except (OSError, ValueError) as failed:
        raise ProviderError(str(failed)) from failed


def _content(answer: dict) -> str:
    choices = answer.get("choices") or []
    return (choices[0].get("message", {}).get("content") or "") if choices else ""


def hosted(base: str, key: str | None, models: list[str], seconds: float = 120.0, **extra: str) -> Provider:
    """A hosted service; every attempt begins with another model of the list."""
    if not models:
        raise ProviderError("no models", retryable=False)

    def complete(prompt: str, room: int, attempt: int) -> str:
        wanted = rotated(models, attempt)
        body = {"model": wanted[0], "models": wanted, "messages": [{"role": "user", "content": prompt}], "max_tokens": room, "temperature": 0, "response_format": {"type": "json_object"}}
        answer = _post(f"{base}/chat/completions", body, headers(key, **extra), seconds)
        usage = answer.get("usage") or {}
        return Completion.of(_content(answer), answer.get("model") or wanted[0], usage.get("prompt_tokens"), usage.get("completion_tokens"))

    return Provider(f"hosted:{models[0]}", complete)


def key_works(base: str, key: str | None, seconds: float = 20.0) -> tuple[bool, str]:
    """Whether the service takes the key, and what it says."""
    try:
        _post(f"{base}/auth/key", None, headers(key), seconds)
    except ProviderError as failed:
        return False, str(failed)
    return True, "ok"


#: When a local model is loaded anew.
RELOAD_POLICIES = ("persistent", "reload_per_paper", "reload_every_n_calls", "reload_on_failure")


def local(base: str, model: str, context: int = 16_384, seconds: float = 1_800.0, seed: int | None = None) -> Provider:
    """A server on one's own machine that holds one model."""
    options = {"temperature": 0, "num_ctx": context} | ({"seed": seed} if seed is not None else {})

    def complete(prompt: str, room: int, attempt: int) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "format": "json", "stream": False, "options": options | {"num_predict": room}}
        answer = _post(f"{base}/api/chat", body, {"Content-Type": "application/json"}, seconds)
        return Completion.of(answer.get("message", {}).get("content") or "", model, answer.get("prompt_eval_count"), answer.get("eval_count"))

    return Provider(f"local:{model}", complete)


def unload(base: str, model: str, seconds: float = 30.0) -> bool:
    """Asks a local server to drop its model; a failure is told, not raised."""
    try:
        _post(f"{base}/api/generate", {"model": model, "keep_alive": 0}, {"Content-Type": "application/json"}, seconds)
    except ProviderError:
        return False
    return True


@dataclass
class Reloading:
    """A local provider under a reload policy; ``drop`` unloads the model."""

    provider: Provider
    drop: Callable[[], bool]
    policy: str = "persistent"
    every: int = 5
    calls: int = field(default=0)

    def __post_init__(self) -> None:
        if self.policy not in RELOAD_POLICIES:
            raise ValueError(f"unknown reload policy: {self.policy}")

    def begin_paper(self) -> None:
        if self.policy == "reload_per_paper":
            self.drop()

    def complete(self, prompt: str, room: int, attempt: int) -> str:
        if (self.policy == "reload_every_n_calls" and self.calls and self.calls % self.every == 0) or (self.policy == "reload_on_failure" and attempt > 1):
            self.drop()
        self.calls += 1
        return self.provider.complete(prompt, room, attempt)
