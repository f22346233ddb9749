"""Settings, from arguments or the environment. Secrets never reach a plan or a repr."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from functools import lru_cache

PROVIDERS = ("openai", "openrouter", "langchain", "anthropic", "ollama", "gemini", "cohere", "mistral")


@dataclass(frozen=True)
class Settings:
    provider: str = "openai"
    model_name: str = "gpt-4o-mini"
    openai_api_key: str | None = field(default=None, repr=False)
    openrouter_api_key: str | None = field(default=None, repr=False)
    openrouter_base_url: str = "https://openrouter.ai/api/v1"
    anthropic_api_key: str | None = field(default=None, repr=False)
    ollama_base_url: str = "http://localhost:11434"
    gemini_api_key: str | None = field(default=None, repr=False)
    cohere_api_key: str | None = field(default=None, repr=False)
    mistral_api_key: str | None = field(default=None, repr=False)
    qdrant_url: str | None = None
    qdrant_collection: str = "rag_documents"
    memory_window: int = 10
    input_guard_enabled: bool = True
    output_guard_enabled: bool = True
    emergency_detection_enabled: bool = True
    hallucination_threshold: float = 0.7

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}")
        if self.memory_window < 0:
            raise ValueError("memory_window must not be negative")
        if not 0 <= self.hallucination_threshold <= 1:
            raise ValueError("hallucination_threshold must be between 0 and 1")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
        """From a .env file and the environment (which wins); names in any case, unknown ones ignored."""
        found: dict[str, str] = {}
        if dotenv and os.path.exists(dotenv):
            with open(dotenv, encoding="utf-8") as f:
                for line in f:
                    key, eq, value = line.strip().removeprefix("export ").partition("=")
                    if eq and not key.startswith("#"):
                        found[key.strip().lower()] = value.strip().strip("'\"")
        found |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        values = {f.name: _typed(found[f.name], f.default) for f in fields(cls) if f.name in found}
        return cls(**values)


def _typed(text: str, default):
    if isinstance(default, bool):
        if text.lower() in ("1", "true", "t", "yes", "y", "on"):
            return True
        if text.lower() in ("0", "false", "f", "no", "n", "off"):
            return False
        raise ValueError(f"not a boolean: {text!r}")
    return type(default)(text) if isinstance(default, (int, float)) else text


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """The process-wide settings; ``get_settings.cache_clear()`` reads them anew."""
    return Settings.load()
