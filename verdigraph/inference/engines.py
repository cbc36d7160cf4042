"""Engines that answer prompts."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from verdigraph.config import Config


class InferenceError(RuntimeError):
    """An engine can't be reached or doesn't answer."""


@dataclass(frozen=True)
class Answer:
    response: str
    thinking: str | None = None


class Engine(Protocol):
    def is_available(self) -> bool: ...

    def ensure_model(self, model: str) -> bool: ...

    def warmup(self, model: str) -> None: ...

    def generate(self, model: str, prompt: str, think: bool | None = None) -> Answer: ...


class LocalEngine:
    """What engines without a server have in common."""

    def is_available(self) -> bool:
        return True

    def ensure_model(self, model: str) -> bool:
        return True

    def warmup(self, model: str) -> None:
        pass


@dataclass
class RuleEngine(LocalEngine):
    """Answers by a function of model and prompt; for tests and for rules that need no model."""

    rule: Callable[[str, str], str]

    def generate(self, model: str, prompt: str, think: bool | None = None) -> Answer:
        return Answer(self.rule(model, prompt))


def prompt_key(prompt: str) -> str:
    return hashlib.sha256(prompt.encode("utf-8")).hexdigest()


@dataclass
class ReplayEngine(LocalEngine):
    """Answers recorded before, by the hash of the prompt."""

    answers: dict[str, str]

    def generate(self, model: str, prompt: str, think: bool | None = None) -> Answer:
        try:
            return Answer(self.answers[prompt_key(prompt)])
        except KeyError:
            raise InferenceError("no recorded answer to this prompt") from None


@dataclass
class HttpEngine:
    """A model server with the endpoints /api/generate, /api/tags and /api/pull."""

    host: str
    timeout: float = 600.0

    def _call(self, path: str, body: dict | None = None) -> urllib.request.addinfourl:
        data = None if body is None else json.dumps(body).encode("utf-8")
        request = urllib.request.Request(f"{self.host.rstrip('/')}{path}", data, {"Content-Type": "application/json"})
        return urllib.request.urlopen(request, timeout=self.timeout)

    def is_available(self) -> bool:
        try:
            with urllib.request.urlopen(self.host, timeout=3.0) as r:
                return r.status == 200
        except OSError:
            return False

    def ensure_model(self, model: str) -> bool:
        try:
            with self._call("/api/tags") as r:
                if any(m.get("model") == model or m.get("name") == model for m in json.load(r)["models"]):
                    return True
        except (OSError, ValueError, KeyError) as e:
            raise InferenceError(f"models can't be listed: {e}") from e
        try:
            with self._call("/api/pull", {"model": model, "stream": True}) as r:
                return all("error" not in json.loads(line) for line in r if line.strip())
        except (OSError, ValueError):
            return False

    def warmup(self, model: str) -> None:
        self.generate(model, "")

    def generate(self, model: str, prompt: str, think: bool | None = None) -> Answer:
        body = {"model": model, "prompt": prompt, "stream": False} | ({} if think is None else {"think": think})
        try:
            with self._call("/api/generate", body) as r:
                said = json.load(r)
        except (OSError, ValueError) as e:
            raise InferenceError(f"model {model!r} doesn't answer: {e}") from e
        return Answer(said.get("response", ""), said.get("thinking"))


#: Engines by the name that a configuration gives; others may be added.
ENGINES: dict[str, Callable[[Config], Engine]] = {"ollama": lambda c: HttpEngine(c.host, c.request_timeout)}


def create_engine(config: Config) -> Engine:
    """The engine a configuration names."""
    make = ENGINES.get(config.inference_engine)
    if make is None:
        raise InferenceError(f"no engine {config.inference_engine!r}; there are {', '.join(sorted(ENGINES))}")
    return make(config)


def prepare(engine: Engine, config: Config) -> None:
    """The engine is reachable and has its models, or InferenceError."""
    if not engine.is_available():
        raise InferenceError(f"no inference engine at {config.host}")
    models = config.needed_models()
    if missing := [m for m in models if not engine.ensure_model(m)]:
        raise InferenceError(f"models that can't be had: {', '.join(missing)}")
    for model in models:
        engine.warmup(model)
