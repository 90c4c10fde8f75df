"""Model and service backends: what answers for a trainable or a service step.

A backend is called with (payload, schema, identity=, config=, transport=) and returns JSON text of
an object for a trainable, or any value for a service.  It runs on the executors.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from itertools import chain
from typing import Any

from loomwork.functions.rendering import RESERVED, RenderError, grammar


def _answer(schema: Mapping[str, Any], seed: str, config: Mapping[str, Any]) -> Any:
    """A value that the schema admits, which the seed determines."""
    digest = hashlib.sha256(seed.encode()).hexdigest()
    if "enum" in schema:
        return schema["enum"][int(digest, 16) % len(schema["enum"])]
    if "anyOf" in schema:
        return _answer(schema["anyOf"][0], seed, config)
    match schema["type"]:
        case "string":
            size = max(schema.get("minLength", 12), min(12, schema.get("maxLength", 12)))
            return (digest * (size // 64 + 1))[:size]
        case "integer":
            return int(digest[:8], 16)
        case "number":
            return int(digest[:8], 16) / 2**32
        case "boolean":
            return int(digest, 16) % 2 == 0
        case "array":
            return [_answer(schema["items"], f"{seed}/{k}", config) for k in range(int(digest[0], 16) % 4)]
    if "properties" in schema:
        return {k: _answer(v, f"{seed}/{k}", config) for k, v in schema["properties"].items()}
    return {}


class Fake:
    """Answers offline and always alike; rejects what a strict backend would reject."""

    def __init__(self, form: str = "json_schema"):
        self.form = form

    def __call__(self, payload: Any, schema: Mapping[str, Any] | None, identity: Mapping, config: Mapping, transport: Mapping) -> Any:
        if schema is None:
            return {"echo": payload}
        if self.form == "gbnf":
            grammar(schema)
        elif "additionalProperties" in json.dumps(schema).replace('"additionalProperties": false', ""):
            raise RenderError("a strict JSON schema has no open keys")
        return json.dumps(_answer(schema, f"{sorted(identity.items())}{sorted(config.items())}{payload}", config), ensure_ascii=False)

    def fragments(self, payload: Any, schema: Mapping[str, Any], identity: Mapping, config: Mapping, transport: Mapping, size: int = 7) -> Iterator[str]:
        """The same answer in pieces."""
        text = self(payload, schema, identity, config, transport)
        yield from (text[k : k + size] for k in range(0, len(text), size))




def secret(reference: str | None) -> str | None:
    """The secret that ``[env]NAME`` or ``[file]/path`` names, read where it is used."""
    if reference is None:
        return None
    m = re.fullmatch(r"\[(env|file)\](.+)", reference)
    if not m:
        raise ValueError("a secret is named by [env]NAME or [file]/path")
    if m[1] == "env":
        return os.environ[m[2]]
    with open(m[2], encoding="utf-8") as f:
        return f.read().strip()


def _post(url: str, body: Mapping[str, Any], key: str | None, timeout_ms: int | None) -> Iterator[bytes]:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=None if timeout_ms is None else timeout_ms / 1000) as r:
        yield from r


def sse_data(lines: Iterator[bytes]) -> Iterator[str]:
    """The data of server-sent events as they come, up to ``[DONE]``; comments and other fields are left out."""
    held: list[str] = []
    for line in chain(lines, [b"\n"]):
        text = line.decode().rstrip("\r\n")
        if text.startswith("data:"):
            held.append(text[5:].removeprefix(" "))
        elif not text and held:
            data = "\n".join(held)
            held.clear()
            if data == "[DONE]":
                return
            yield data


def _extras(config: Mapping[str, Any]) -> dict[str, Any]:
    extras = dict(config.get("extras") or {})
    if RESERVED & set(extras):
        raise ValueError(f"extras may not set {sorted(RESERVED & set(extras))}")
    return extras | {k: v for k, v in config.items() if k != "extras"}


def _limit(transport: Mapping, remaining_budget_ms: int | None) -> int | None:
    """The shorter of a call's own time limit and of what is left of the run's."""
    known = [x for x in (transport.get("timeout_ms"), remaining_budget_ms) if x is not None]
    if known and min(known) <= 0:
        raise TimeoutError("no time is left for the call")
    return min(known, default=None)


class ChatCompletions:
    """``POST <endpoint>/chat/completions`` with a strict JSON schema, whole or as fragments."""

    form = "json_schema"

    def __init__(self, post: Callable[..., Iterator[bytes]] = _post):
        self.post = post

    def body(self, payload: str, schema: Mapping[str, Any], identity: Mapping, config: Mapping) -> dict[str, Any]:
        form = {"type": "json_schema", "json_schema": {"name": "output", "strict": True, "schema": schema}}
        return {**_extras(config), "model": identity["model"], "messages": [{"role": "user", "content": payload}], "response_format": form}

    def __call__(
        self, payload: str, schema: Mapping[str, Any], identity: Mapping, config: Mapping, transport: Mapping, remaining_budget_ms: int | None = None,
    ) -> str:
        limit = _limit(transport, remaining_budget_ms)
        sent = self.post(f"{transport['endpoint']}/chat/completions", self.body(payload, schema, identity, config), secret(transport.get("api_key_ref")), limit)
        choice = json.loads(b"".join(sent))["choices"][0]
        _accepted(choice.get("message") or {})
        _ended(choice.get("finish_reason"))
        text = choice["message"].get("content")
        if not isinstance(text, str):
            raise ValueError("the answer has no text")
        return text

    def fragments(
        self, payload: str, schema: Mapping[str, Any], identity: Mapping, config: Mapping, transport: Mapping, remaining_budget_ms: int | None = None,
    ) -> Iterator[str]:
        body = self.body(payload, schema, identity, config) | {"stream": True}
        sent = self.post(f"{transport['endpoint']}/chat/completions", body, secret(transport.get("api_key_ref")), _limit(transport, remaining_budget_ms))
        ended = None
        for data in sse_data(sent):
            for choice in (json.loads(data).get("choices") or [])[:1]:  # a chunk without any tells of usage
                delta = choice.get("delta") or {}
                _accepted(delta)
                ended = choice.get("finish_reason") or ended
                if delta.get("content"):
                    yield delta["content"]
        _ended(ended)


def _accepted(message: Mapping[str, Any]) -> None:
    if message.get("refusal"):
        raise ValueError(f"the model refused: {message['refusal']}")


def _ended(reason: str | None) -> None:
    """Only an answer that the backend itself calls complete is whole; a stream may just stop."""
    if reason != "stop":
        raise ValueError(f"the answer ended by {reason}" if reason else "the answer has no end")


class GrammarCompletion:
    """``POST <endpoint>/completion`` with a GBNF grammar, whole or as fragments."""

    form = "gbnf"

    def __init__(self, post: Callable[..., Iterator[bytes]] = _post):
        self.post = post

    def __call__(
        self, payload: str, schema: Mapping[str, Any], identity: Mapping, config: Mapping, transport: Mapping, remaining_budget_ms: int | None = None,
    ) -> str:
        body = {**_extras(config), "prompt": payload, "grammar": grammar(schema)}
        sent = self.post(f"{transport['endpoint']}/completion", body, secret(transport.get("api_key_ref")), _limit(transport, remaining_budget_ms))
        answer = json.loads(b"".join(sent))
        _whole(answer)
        return answer["content"]

    def fragments(
        self, payload: str, schema: Mapping[str, Any], identity: Mapping, config: Mapping, transport: Mapping, remaining_budget_ms: int | None = None,
    ) -> Iterator[str]:
        body = {**_extras(config), "prompt": payload, "grammar": grammar(schema), "stream": True}
        sent = self.post(f"{transport['endpoint']}/completion", body, secret(transport.get("api_key_ref")), _limit(transport, remaining_budget_ms))
        for data in sse_data(sent):
            piece = json.loads(data)
            if piece.get("content"):
                yield piece["content"]
            _whole(piece)


def _whole(answer: Mapping[str, Any]) -> None:
    if answer.get("truncated") or answer.get("stopped_limit"):
        raise ValueError("the answer was cut short")
