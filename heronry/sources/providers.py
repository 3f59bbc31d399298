"""The seam to models: chat, embeddings, page transcription. Offline providers are deterministic.

A provider is picklable and travels to the Python workers, where network providers would open one client a
process. Its columns are marked nondeterministic, so that no call is planned twice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.settings import ConfigError, Settings, get_settings

EMBED_BATCH = 64


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cached_tokens: int = 0
    model: str = ""

    @property
    def total_tokens(self) -> int:
        return self.prompt_tokens + self.completion_tokens


class Provider(Protocol):
    def chat(self, prompt: str, temperature: float | None = None) -> Reply: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def transcribe(self, image: bytes, prompt: str) -> Reply: ...

    def models(self) -> list[str]: ...


class Columns:
    """Columns and DataFrames from a provider's calls."""

    def chat_column(self, prompt: Column) -> Column:
        me = self

        @F.pandas_udf("string")
        def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in prompts:
                yield pd.Series([None if p is None else me.chat(p, temperature=0.0).text for p in batch], dtype=object)

        return ask.asNondeterministic()(prompt)

    def embed_column(self, text: Column) -> Column:
        me = self

        @F.pandas_udf("array<float>")
        def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                held = batch.fillna("").tolist()
                vectors: list = []
                for at in range(0, len(held), EMBED_BATCH):
                    vectors += me.embed(held[at : at + EMBED_BATCH])
                yield pd.Series(vectors, dtype=object)

        return embed.asNondeterministic()(text)

    def reranks(self) -> bool:
        """Whether a reranking service is configured."""
        return False

    def rerank_column(self, query: Column, documents: Column) -> Column:
        me = self

        @F.pandas_udf("string")
        def ask(queries: pd.Series, lists: pd.Series) -> pd.Series:
            return pd.Series([me.rerank(q, list(d)) for q, d in zip(queries, lists)], dtype=object)

        return ask.asNondeterministic()(query, documents)

    def stream(self, prompt: str) -> Iterator[tuple[str, object]]:
        """("delta", text) events and one ("usage", Reply) at the end."""
        reply = self.chat(prompt)
        for word in re.findall(r"\S+\s*", reply.text):
            yield "delta", word
        yield "usage", reply


_WORD = re.compile(r"\w+")


class Offline(Columns):
    """Hashed bag-of-words vectors; replies from the prompt's own text: a blurb from the first titles, the
    identity order for a listing, a citation of the first source for a question."""

    def __init__(self, dim: int = 128) -> None:
        self.dim = dim
        self.primed: set[str] = set()

    def chat(self, prompt: str, temperature: float | None = None) -> Reply:
        return Reply(self._reply(prompt), *self._usage(prompt), model="offline")

    def _usage(self, prompt: str) -> tuple[int, int, int]:
        """Prompts that share a prefix find 80 % of it cached after the first."""
        prefix = prompt.split("<chunk>")[0]
        cached = int(0.8 * len(prefix)) // 4 if prefix in self.primed else 0
        self.primed.add(prefix)
        return len(prompt) // 4, 12, cached

    def _reply(self, prompt: str) -> str:
        if "<chunk>" in prompt:
            head, _, tail = prompt.partition("<chunk>")
            title = next((x[2:].strip() for x in head.splitlines() if x.startswith("# ")), "")
            part = next((x[3:].strip() for x in tail.splitlines() if x.startswith("## ")), "")
            return f"This chunk is from '{title}'" + (f", in the {part} section." if part else ".")
        if "Passages:" in prompt:
            return ", ".join(re.findall(r"(?m)^\[(\d+)\]", prompt))
        return "The sources say so [S1]." if "Sources:" in prompt else ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            slots = {zlib.crc32(w.encode()) % self.dim for w in _WORD.findall(text.lower())}
            out.append([float(k in slots) for k in range(self.dim)] if slots else [1e-6] * self.dim)
        return out

    def transcribe(self, image: bytes, prompt: str) -> Reply:
        return Reply(image.decode("utf-8", "replace"), 0, 0, 0, "offline")

    def models(self) -> list[str]:
        return ["offline"]


_factories: dict[str, Callable[[Settings], Provider]] = {}
_clients: dict[tuple[str, int], Provider] = {}


def register(name: str, factory: Callable[[Settings], Provider]) -> None:
    """Makes a kind of provider known; the factory gets the settings."""
    _factories[name] = factory


def provider(name: str = "offline", settings: Settings | None = None) -> Provider:
    """One provider for each kind and settings object."""
    settings = settings or get_settings()
    if name not in _factories:
        raise ConfigError(f"no provider {name!r}; known: {', '.join(sorted(_factories))}")
    key = name, id(settings)
    if key not in _clients:
        _clients[key] = _factories[name](settings)
    return _clients[key]


register("offline", lambda settings: Offline())


def adapted(call: Callable[..., Reply], arguments: dict, refused: Callable[[Exception], str | None], tries: int = 3) -> Reply:
    """call(**arguments), again without what an endpoint refuses: refused() gives the name of the argument that an
    error is about, or None. max_tokens becomes max_completion_tokens, others are dropped."""
    arguments = dict(arguments)
    for left in range(tries, -1, -1):
        try:
            return call(**arguments)
        except Exception as error:
            name = refused(error)
            if not left or name not in arguments:
                raise
            value = arguments.pop(name)
            if name == "max_tokens":
                arguments["max_completion_tokens"] = value
    raise AssertionError("unreachable")


def embedded(df: DataFrame, provider_: Provider, text: str = "embed_text", into: str = "embedding") -> DataFrame:
    return df.withColumn(into, provider_.embed_column(F.col(text)))
