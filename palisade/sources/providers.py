"""Text generation behind one interface.

Two providers are columns and stay in the plan: ``replayed`` (the recorded
answer) and ``extracted`` (the best passage). The others are chat services
reached over HTTP, each described by its wire format; a partition's rows go
through one connection, and rows that a guard has blocked never reach it.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.settings import Settings, get_settings
from palisade.sources.calls import Calls, called

MESSAGES = "array<struct<role:string,content:string>>"
REPLY = "struct<content:string,model:string,input_tokens:int,output_tokens:int,raw_response:string>"
MAX_TOKENS = 1024

Message = dict[str, Any]


class ProviderError(Exception):
    """A provider is not configured, or its service failed."""


@dataclass(frozen=True)
class ProviderResponse:
    content: str
    model: str
    input_tokens: int = 0
    output_tokens: int = 0
    raw_response: dict[str, Any] = field(default_factory=dict)


class Provider(Protocol):
    """What generates text. Subclasses of anything will do that have these methods."""

    def complete(self, messages: list[Message], **options: Any) -> ProviderResponse: ...

    def stream(self, messages: list[Message], **options: Any) -> Iterator[str]: ...

    def get_model_name(self) -> str: ...


# --- messages, on the driver and as columns ---------------------------------


def split_system(messages: list[Message]) -> tuple[str, list[Message]]:
    """The system parts, one a line, and the other messages."""
    parts: dict[bool, list[Message]] = {True: [], False: []}
    for m in messages:
        parts[m.get("role") == "system"].append({k: m[k] for k in ("role", "content")})
    return "\n".join(m["content"] for m in parts[True]), parts[False]


def flat_prompt(messages: list[Message]) -> str:
    return "\n\n".join(f"{m.get('role', 'user')}: {m.get('content', '')}" for m in messages)


def chain_roles(messages: list[Message]) -> list[Message]:
    """Roles as system, ai or human."""
    kinds = {"system": "system", "assistant": "ai", "ai": "ai"}
    return [{"role": kinds.get(m.get("role", "user"), "human"), "content": m.get("content", "")} for m in messages]


def flat_content(content: Any) -> str:
    """The text of a message: a string, or a list of strings and blocks with a text."""
    if isinstance(content, list):
        return "".join(b if isinstance(b, str) else str(b["text"]) for b in content if isinstance(b, str) or isinstance(b, dict) and "text" in b)
    return content if isinstance(content, str) else str(content)


def split_system_column(messages: Column) -> Column:
    """``struct<system, chat>`` of an array of messages."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
    return F.struct(system.alias("system"), F.filter(messages, lambda m: ~m["role"].eqNullSafe("system")).alias("chat"))


def flat_prompt_column(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def flat_content_column(parts: Column) -> Column:
    """``flat_content`` of an array of parts ``struct<plain, text>``: plain ones, texts of others, nothing for those with neither."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["plain"], p["text"], F.lit(""))), "")


def chain_roles_column(messages: Column) -> Column:
    kind = lambda r: F.when(r == "system", "system").when(r.isin("assistant", "ai"), "ai").otherwise("human")
    return F.transform(messages, lambda m: F.struct(kind(m["role"]).alias("role"), m["content"].alias("content")))


# --- providers that are columns ----------------------------------------------


def replayed(recorded: Column) -> Column:
    """The draft that was recorded; empty if none was."""
    return F.coalesce(recorded, F.lit(""))


def extracted(sources: Column) -> Column:
    """The content of the first passage; empty without passages."""
    return F.coalesce(F.get(sources, F.lit(0))["content"], F.lit(""))


# --- chat services -------------------------------------------------------------


@dataclass(frozen=True)
class Wire:
    """How a chat service is spoken to. ``key`` names the setting that holds its secret (none: no secret)."""

    name: str
    model: str
    key: str | None
    url: Callable[[Settings, str, bool], str]
    headers: Callable[[str], dict[str, str]]
    body: Callable[[list[Message], str, bool, dict[str, Any]], dict[str, Any]]
    reply: Callable[[dict[str, Any], str], ProviderResponse]
    delta: Callable[[dict[str, Any]], str]
    hint: str = ""


def _first(items: Any) -> dict[str, Any]:
    return items[0] if items else {}


def _bearer(secret: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {secret}"}


def _plain(messages: list[Message], model: str, stream: bool, options: dict[str, Any]) -> dict[str, Any]:
    return {"model": model, "messages": messages, "stream": stream, **options}


def _choice(r: dict[str, Any], model: str) -> ProviderResponse:
    usage = r.get("usage") or {}
    return ProviderResponse(flat_content(_first(r.get("choices")).get("message", {}).get("content") or ""), r.get("model", model), usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0, r)


def _choice_delta(e: dict[str, Any]) -> str:
    return _first(e.get("choices")).get("delta", {}).get("content") or ""


def _claude_body(messages: list[Message], model: str, stream: bool, options: dict[str, Any]) -> dict[str, Any]:
    system, chat = split_system(messages)
    return {"model": model, "max_tokens": MAX_TOKENS, "messages": chat, "stream": stream, **({"system": system} if system else {}), **options}


def _claude_reply(r: dict[str, Any], model: str) -> ProviderResponse:
    usage = r.get("usage") or {}
    return ProviderResponse(_first(r.get("content")).get("text", ""), r.get("model", model), usage.get("input_tokens") or 0, usage.get("output_tokens") or 0, r)


def _gemini_text(r: dict[str, Any]) -> str:
    return flat_content(_first(r.get("candidates")).get("content", {}).get("parts") or [])


def _gemini_reply(r: dict[str, Any], model: str) -> ProviderResponse:
    usage, text = r.get("usageMetadata") or {}, _gemini_text(r)
    return ProviderResponse(text, model, usage.get("promptTokenCount") or 0, usage.get("candidatesTokenCount") or 0, {"text": text})


def _cohere_reply(r: dict[str, Any], model: str) -> ProviderResponse:
    blocks = (r.get("message") or {}).get("content") or []
    tokens = (r.get("usage") or {}).get("tokens") or {}
    return ProviderResponse(next((b["text"] for b in blocks if b.get("text")), ""), model, int(tokens.get("input_tokens") or 0), int(tokens.get("output_tokens") or 0), r)


def _cohere_delta(e: dict[str, Any]) -> str:
    return e["delta"]["message"]["content"]["text"] or "" if e.get("type") == "content-delta" else ""


def _ollama_reply(r: dict[str, Any], model: str) -> ProviderResponse:
    return ProviderResponse((r.get("message") or {}).get("content") or "", r.get("model", model), r.get("prompt_eval_count") or 0, r.get("eval_count") or 0, r)


_OPENAI_URL = "https://api.openai.com/v1/chat/completions"
WIRES = {
    w.name: w
    for w in (
        Wire("openai", "gpt-4o-mini", "openai_api_key", lambda s, m, st: _OPENAI_URL, _bearer, _plain, _choice, _choice_delta),
        Wire("openrouter", "gpt-4o-mini", "openrouter_api_key", lambda s, m, st: f"{s.openrouter_base_url}/chat/completions", _bearer, _plain, _choice, _choice_delta),
        Wire(
            "anthropic", "claude-3-5-haiku-20241022", "anthropic_api_key", lambda s, m, st: "https://api.anthropic.com/v1/messages",
            lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"}, _claude_body, _claude_reply, lambda e: (e.get("delta") or {}).get("text") or "",
        ),
        Wire(
            "gemini", "gemini-1.5-flash", "gemini_api_key",
            lambda s, m, st: f"https://generativelanguage.googleapis.com/v1beta/models/{m}:" + ("streamGenerateContent?alt=sse" if st else "generateContent"),
            lambda k: {"x-goog-api-key": k}, lambda ms, m, st, o: {"contents": [{"role": "user", "parts": [{"text": flat_prompt(ms)}]}], **o}, _gemini_reply, _gemini_text,
        ),
        Wire("cohere", "command-r-plus", "cohere_api_key", lambda s, m, st: "https://api.cohere.com/v2/chat", _bearer, _plain, _cohere_reply, _cohere_delta),
        Wire("mistral", "mistral-small-latest", "mistral_api_key", lambda s, m, st: "https://api.mistral.ai/v1/chat/completions", _bearer, _plain, _choice, _choice_delta),
        Wire(
            "ollama", "llama3.2", None, lambda s, m, st: f"{s.ollama_base_url}/api/chat", lambda k: {}, _plain, _ollama_reply,
            lambda e: (e.get("message") or {}).get("content") or "", "Ensure the server is running and the model is pulled.",
        ),
        Wire("langchain", "gpt-4o-mini", "openai_api_key", lambda s, m, st: _OPENAI_URL, _bearer, _plain, _choice, _choice_delta),
    )
}


def post(url: str, headers: dict[str, str], body: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """JSON values of a response: one, or one for each line or server-sent event."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=120) as response:  # noqa: S310
        if not body.get("stream") and "alt=sse" not in url:
            yield json.load(response)
            return
        for line in response:
            text = line.decode().strip().removeprefix("data:").strip()
            if text.startswith("{"):
                yield json.loads(text)


class HttpProvider:
    """A chat service by its wire format. ``transport`` stands in for ``post`` in tests."""

    def __init__(self, name: str | None = None, settings: Settings | None = None, transport: Callable[..., Iterator[dict[str, Any]]] = post):
        self.settings = settings or get_settings()
        self.wire = WIRES[name or self.settings.provider]
        self.transport = transport
        self.model = self.settings.model_name or self.wire.model
        if self.wire.key and not getattr(self.settings, self.wire.key):
            raise ProviderError(f"{self.wire.name}: no key; set {self.wire.key.upper()} in the environment or .env file")

    def get_model_name(self) -> str:
        return self.model

    def _call(self, messages: list[Message], stream: bool, options: dict[str, Any]) -> tuple[str, Iterator[dict[str, Any]]]:
        model = options.pop("model", self.model)
        secret = getattr(self.settings, self.wire.key) if self.wire.key else ""
        return model, self.transport(self.wire.url(self.settings, model, stream), self.wire.headers(secret), self.wire.body(messages, model, stream, options))

    def _failure(self, e: Exception) -> ProviderError:
        kinds = {401: "authentication failed", 403: "authentication failed", 429: "rate limit exceeded"}
        what = kinds.get(e.code, "API error") if isinstance(e, urllib.error.HTTPError) else "request failed"
        return ProviderError(f"{self.wire.name}: {what}: {e}. {self.wire.hint}".strip())

    def complete(self, messages: list[Message], **options: Any) -> ProviderResponse:
        try:
            model, replies = self._call(messages, False, options)
            return self.wire.reply(next(iter(replies)), model)
        except (OSError, ValueError, KeyError, TypeError, StopIteration) as e:
            raise self._failure(e) from e

    def stream(self, messages: list[Message], **options: Any) -> Iterator[str]:
        """Pieces of text as they come; empty ones are dropped."""
        try:
            for event in self._call(messages, True, options)[1]:
                if piece := self.wire.delta(event):
                    yield piece
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise self._failure(e) from e


class ChainProvider:
    """Any chat model with ``invoke`` and ``stream`` over (role, content) pairs, such as a chain library's."""

    def __init__(self, llm: Any = None, settings: Settings | None = None, transport: Callable[..., Iterator[dict[str, Any]]] = post):
        self.llm = llm
        self.fallback = HttpProvider("langchain", settings, transport) if llm is None else None

    def get_model_name(self) -> str:
        if self.fallback:
            return self.fallback.get_model_name()
        return str(getattr(self.llm, "model_name", None) or getattr(self.llm, "model", None) or type(self.llm).__name__)

    def complete(self, messages: list[Message], **options: Any) -> ProviderResponse:
        if self.fallback:
            return self.fallback.complete(messages, **options)
        try:
            reply = self.llm.invoke([(m["role"], m["content"]) for m in chain_roles(messages)], **options)
            usage = getattr(reply, "usage_metadata", None) or {}
            return ProviderResponse(flat_content(reply.content), self.get_model_name(), usage.get("input_tokens", 0), usage.get("output_tokens", 0), dict(getattr(reply, "response_metadata", None) or {}))
        except Exception as e:
            raise ProviderError(f"chain: {e}") from e

    def stream(self, messages: list[Message], **options: Any) -> Iterator[str]:
        if self.fallback:
            yield from self.fallback.stream(messages, **options)
            return
        try:
            for chunk in self.llm.stream([(m["role"], m["content"]) for m in chain_roles(messages)], **options):
                if piece := flat_content(chunk.content):
                    yield piece
        except Exception as e:
            raise ProviderError(f"chain: {e}") from e


def completed(rows: DataFrame, provider: Provider, column: str = "reply", messages: str = "messages", calls: Calls = Calls(), **options: Any) -> DataFrame:
    """``rows`` with the provider's reply to an array of messages, as a struct of type ``REPLY``.

    Only rows that should be answered may be passed: filter before, since the
    call is made for each row. A task has a few requests under way at once and tries again
    after failures that pass (``calls``; a provider that threads may not share wants ``Calls(1)``). Each row has one reply
    in the result; a task that is run again asks again.
    """
    import pyarrow as pa

    at = rows.columns.index(messages)
    schema = rows.withColumn(column, F.lit(None).cast(REPLY)).schema
    kind = pa.struct([("content", pa.string()), ("model", pa.string()), ("input_tokens", pa.int32()), ("output_tokens", pa.int32()), ("raw_response", pa.string())])

    def run(batches):
        for b in batches:
            replies = called(b.column(at).to_pylist(), lambda m: provider.complete(list(m or []), **options), calls)
            out = [replace(r, raw_response=json.dumps(r.raw_response, default=str)).__dict__ for r in replies]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, column])

    return rows.mapInArrow(run, schema)
