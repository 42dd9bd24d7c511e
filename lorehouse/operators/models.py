"""Connectors to models that speak the common chat and embedding protocols, by a transport that the caller gives.

A transport takes a path and a request and returns the response, both plain dictionaries; tests use deterministic ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol
from urllib.parse import urlparse

from .knowledge import MOST_INPUTS, PREDICATE, REF, ContractError

Transport = Callable[[str, dict], dict]


class ChatModel(Protocol):
    """A language model: a prompt and a text to its completion."""

    def complete(self, system: str, text: str) -> str: ...


def local(url: str) -> str:
    """An address on this machine; anything else is refused."""
    at = urlparse(url)
    if at.scheme not in ("http", "https") or at.hostname not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError("models are asked on this machine only")
    return url.rstrip("/")


def _items(**fields: dict) -> dict:
    return {"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}


_SURE = {"type": "number", "minimum": 0, "maximum": 1}
_NAME = {"type": "string", "pattern": REF}
#: What an answer looks like: for each fragment its entities, attributes and relationships.
ANSWER = {
    "type": "object",
    "properties": {
        "fragments": _items(
            id={"type": "string"},
            entities=_items(ref=_NAME, label={"type": "string"}, type={"type": "string"}, confidence=_SURE),
            attributes=_items(subject_ref=_NAME, predicate={"type": "string", "pattern": PREDICATE}, value={"type": ["string", "number", "boolean"]}, confidence=_SURE),
            relationships=_items(subject_ref=_NAME, predicate={"type": "string", "pattern": PREDICATE}, object_ref=_NAME, confidence=_SURE),
        )
    },
    "required": ["fragments"],
    "additionalProperties": False,
}


@dataclass
class ChatExtractor:
    """Candidates from a chat model. The answer's schema is asked for; a server that refuses it is asked for plain JSON."""

    transport: Transport
    model_id: str
    revision: str
    system: str
    most_bytes: int
    most_tokens: int = 2048

    def __post_init__(self) -> None:
        if not self.model_id or not self.revision:
            raise ValueError("a model needs an identity")
        if self.most_bytes <= 0 or self.most_tokens <= 0:
            raise ValueError("a model needs positive bounds")

    def complete(self, system: str, text: str, form: dict | None = None) -> str:
        request: dict[str, Any] = {"model": self.model_id, "temperature": 0, "max_tokens": self.most_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}]}
        answer = self.transport("/v1/chat/completions", request | ({"response_format": form} if form else {}))
        try:
            choice = answer["choices"][0]
            content = choice["message"]["content"]
        except (KeyError, IndexError, TypeError) as wrong:
            raise ContractError("the model's response has no completion") from wrong
        if choice.get("finish_reason") == "length" or not isinstance(content, str):
            raise ContractError("the model's completion is cut")
        return content

    def extract(self, fragments: list[tuple[str, str]]) -> dict[str, dict]:
        text = json.dumps({"fragments": [{"id": i, "text": t} for i, t in fragments]}, ensure_ascii=False)
        if len(text.encode()) > self.most_bytes:
            raise ContractError("the input exceeds the model's bound")
        try:
            raw = self.complete(self.system, text, {"type": "json_schema", "json_schema": {"name": "knowledge", "strict": True, "schema": ANSWER}})
        except LookupError:  # the transport's word for a form that the server does not know
            raw = self.complete(self.system, text, {"type": "json_object"})
        return decoded(raw)


def decoded(raw: str) -> dict[str, dict]:
    """An answer by fragment; one JSON value and nothing after it, each fragment once."""
    try:
        value = json.loads(raw)
        parts = [(f["id"], {k: list(f[k]) for k in ("entities", "attributes", "relationships")}) for f in value["fragments"]]
    except (ValueError, KeyError, TypeError) as wrong:
        raise ContractError("the answer is not of its form") from wrong
    if len({i for i, _ in parts}) != len(parts) or set(value) != {"fragments"}:
        raise ContractError("the answer names a fragment twice or more than fragments")
    return dict(parts)


@dataclass
class Embedder:
    """Vectors of texts, in their order, however the server orders its answer."""

    transport: Transport
    model_id: str
    dimensions: int

    def __call__(self, texts: Any) -> list[list[float]]:
        texts = list(texts)
        if len(texts) > MOST_INPUTS:
            raise ContractError(f"more than {MOST_INPUTS} inputs")
        data = self.transport("/v1/embeddings", {"model": self.model_id, "input": texts}).get("data", [])
        rows = {d.get("index"): d.get("embedding") for d in data}
        if len(data) != len(texts) or set(rows) != set(range(len(texts))):
            raise ContractError("the embedder's rows are not those asked for")
        for row in rows.values():
            if len(row) != self.dimensions or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in row) or not any(row):
                raise ContractError("a vector is of another length, not finite or zero")
        return [[float(x) for x in rows[i]] for i in range(len(texts))]
