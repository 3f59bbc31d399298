"""Settings: code over environment over a .env file, loaded on first use."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PARSERS, RERANK_MODES = ("vision", "docintel"), ("llm", "endpoint", "off")


class ConfigError(RuntimeError):
    """A setting that can't be used; the message names it."""


@dataclass(frozen=True)
class Settings:
    api_key: str = ""
    base_url: str = ""
    chat_model: str = "gpt-5.4-mini"
    embed_model: str = "text-embedding-3-large"
    parse_model: str = ""
    parser: str = "vision"
    docintel_endpoint: str = ""
    docintel_key: str = ""
    vector_dir: str = ""
    rerank_model: str = ""
    rerank_base_url: str = ""
    rerank_api_key: str = ""
    retrieval_rerank: str = "llm"
    context_doc_cap: int = 250_000
    context_part_tokens: int = 48_000
    context_concurrency: int = 4
    chat_temperature: float = 0.2

    def __post_init__(self) -> None:
        for name, allowed in (("parser", PARSERS), ("retrieval_rerank", RERANK_MODES)):
            value = str(getattr(self, name)).strip().lower()
            if value not in allowed:
                raise ConfigError(f"{name} is {value!r}; it can be {', '.join(allowed)}")
            object.__setattr__(self, name, value)


#: fields whose variable isn't their name in capitals
_VARIABLES = {"api_key": "OPENAI_API_KEY", "base_url": "OPENAI_BASE_URL"}
_active: Settings | None = None


def read_dotenv(path: str | Path = ".env") -> dict[str, str]:
    """NAME=value lines of a file; {} if there is none."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, mark, value = line.strip().removeprefix("export ").partition("=")
            if mark and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                found[name.strip()] = value[1:-1] if quoted else value
    return found


def _typed(variable: str, raw: str, default):
    """raw as the type of default."""
    if isinstance(default, str):
        return raw
    try:
        return type(default)(raw)
    except ValueError:
        kind = "an integer" if isinstance(default, int) else "a number"
        raise ConfigError(f"{variable} must be {kind}, not {raw!r}") from None


def from_environment() -> Settings:
    """Empty and missing variables give the default; malformed ones raise ConfigError."""
    given = {**read_dotenv(), **os.environ}
    values = {}
    for field in fields(Settings):
        variable = _VARIABLES.get(field.name, field.name.upper())
        raw = given.get(variable, "").strip()
        if raw:
            values[field.name] = _typed(variable, raw, field.default)
    return Settings(**values)


def get_settings() -> Settings:
    global _active
    if _active is None:
        _active = from_environment()
    return _active


def configure(**overrides) -> Settings:
    """The active settings with some replaced; they stay as they were if a value is rejected."""
    global _active
    _active = replace(get_settings(), **overrides)
    return _active


def reset_settings() -> None:
    global _active
    _active = None
