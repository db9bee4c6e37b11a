"""Models behind HTTP as embedder and generator; plain JSON requests, for any server that speaks one of the two forms below."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np

from quarry.functions.embedding import TooLong

# The names of fields in requests and answers are the servers' own, the seed makes answers repeat.
SEED = 42


def completion(model: str, prompt: str, temperature: float) -> dict[str, Any]:
    """Request of a server that completes a prompt; the answer's text is its `response`."""
    return {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "seed": SEED}}


def messages(model: str, prompt: str, temperature: float) -> dict[str, Any]:
    """Request of a server that answers a dialogue; the answer's text is in the first part of its `content`."""
    return {"model": model, "max_tokens": 4096, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}


FORMS = {"completion": completion, "messages": messages}


def post(url: str, body: dict[str, Any], headers: Mapping[str, str], timeout: float) -> dict[str, Any]:
    """The JSON answer, that of an error too."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as error:
        return json.load(error)


def _said(answer: dict[str, Any]) -> str:
    if "response" in answer:
        return answer["response"]
    if answer.get("content"):
        return answer["content"][0]["text"]
    raise ValueError(f"no text in the answer: {answer.get('error', sorted(answer))}")


class HttpGenerator:
    def __init__(self, url: str, model: str, form: Callable[[str, str, float], dict] = completion, temperature: float = 0.0, headers: Mapping[str, str] | None = None, timeout: float = 300):
        self.url, self.model, self.form, self.temperature, self.headers, self.timeout = url, model, form, temperature, dict(headers or {}), timeout

    def __call__(self, prompt: str) -> str:
        return _said(post(self.url, self.form(self.model, prompt, self.temperature), self.headers, self.timeout)).strip()


def context_length_of(url: str, model: str, headers: Mapping[str, str] | None = None, timeout: float = 10) -> int | None:
    """The tokens that a served model takes, from what its server says of it: the length that is set, else the one it was built for; None where it says neither or cannot be asked."""
    try:
        said = post(url, {"model": model}, headers or {}, timeout)
    except (OSError, ValueError):
        return None
    was_set = re.search(r"^\s*num_ctx\s+(\d+)", str(said.get("parameters") or ""), re.MULTILINE)
    if was_set:
        return int(was_set[1])
    built = [v for k, v in (said.get("model_info") or {}).items() if k.rsplit(".", 1)[-1] == "context_length"]
    return int(built[0]) if built else None


class HttpEmbedder:
    """A request for each text, from the task that embeds it; a refusal over the context's length is TooLong. The context's length is what the caller says, else what the server answers at `about_url`."""

    def __init__(
        self, url: str, model: str, dim: int, context_length: int | None = None, headers: Mapping[str, str] | None = None, timeout: float = 60, about_url: str | None = None
    ):
        self.url, self.model, self.dim, self.headers, self.timeout = url, model, dim, dict(headers or {}), timeout
        self.context_length = context_length or (context_length_of(about_url, model, self.headers) if about_url else None)

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self._one(t) for t in texts], np.float64).reshape(len(texts), self.dim)

    def _one(self, text: str) -> list[float]:
        answer = post(self.url, {"model": self.model, "prompt": text}, self.headers, self.timeout)
        if "embedding" in answer:
            return answer["embedding"]
        problem = str(answer.get("error", sorted(answer)))
        raise (TooLong if "context length" in problem else ValueError)(problem)
