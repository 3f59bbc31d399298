"""A provider for endpoints with the widespread chat-completions interface, by the standard library alone."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from heronry.settings import ConfigError, Settings
from heronry.sources.providers import Columns, Reply, adapted, register

PUBLIC, TIMEOUT, RERANK_TIMEOUT = "https://api.openai.com/v1", 120, 30


class Refused(Exception):
    """An HTTP 400, with what the endpoint said."""


def _argument(error: Exception) -> str | None:
    """The argument that an endpoint refuses."""
    if not isinstance(error, Refused):
        return None
    said = str(error)
    return "max_tokens" if "max_tokens" in said else "temperature" if "temperature" in said else None


def _call(url: str, key: str, body: dict | None, timeout: float = TIMEOUT):
    """An open response; body None is a GET."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers)
    try:
        return urllib.request.urlopen(request, timeout=timeout)
    except urllib.error.HTTPError as error:
        if error.code == 400:
            raise Refused(error.read().decode("utf-8", "replace")) from None
        raise


def _reply(usage: dict | None, text: str, model: str) -> Reply:
    usage = usage or {}
    cached = (usage.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
    return Reply(text, usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0, cached, model)


@dataclass
class Endpoint(Columns):
    """Holds settings only, so it travels to the workers as it is."""

    settings: Settings

    def __post_init__(self) -> None:
        if not self.settings.api_key and not self.settings.base_url:
            raise ConfigError("api_key is empty; set OPENAI_API_KEY, or OPENAI_BASE_URL for an endpoint without keys")
        self.url = (self.settings.base_url or PUBLIC).rstrip("/")
        self.key = self.settings.api_key or "none"

    def _completion(self, **body):
        return adapted(lambda **b: _call(f"{self.url}/chat/completions", self.key, b), body, _argument)

    def _asked(self, content, model: str, temperature: float | None, max_tokens: int | None) -> Reply:
        body = {"model": model, "messages": [{"role": "user", "content": content}], "temperature": self.settings.chat_temperature if temperature is None else temperature}
        if max_tokens:
            body["max_tokens"] = max_tokens
        with self._completion(**body) as response:
            got = json.load(response)
        return _reply(got.get("usage"), got["choices"][0]["message"].get("content") or "", got.get("model", model))

    def chat(self, prompt: str, temperature: float | None = None, max_tokens: int | None = None) -> Reply:
        return self._asked(prompt, self.settings.chat_model, temperature, max_tokens)

    def transcribe(self, image: bytes, prompt: str, detail: str = "high", max_tokens: int | None = None) -> Reply:
        picture = {"url": "data:image/png;base64," + base64.b64encode(image).decode(), "detail": detail}
        content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": picture}]
        return self._asked(content, self.settings.parse_model or self.settings.chat_model, 0.0, max_tokens)

    def stream(self, prompt: str) -> Iterator[tuple[str, object]]:
        body = {"model": self.settings.chat_model, "messages": [{"role": "user", "content": prompt}], "temperature": self.settings.chat_temperature, "stream": True, "stream_options": {"include_usage": True}}
        whole, usage = "", None
        with self._completion(**body) as response:
            for line in response:
                data = line.decode().strip().removeprefix("data:").strip()
                if not data or data == "[DONE]":
                    continue
                event = json.loads(data)
                usage = event.get("usage") or usage
                for choice in event.get("choices") or []:
                    text = (choice.get("delta") or {}).get("content")
                    if text:
                        whole += text
                        yield "delta", text
        yield "usage", _reply(usage, whole, self.settings.chat_model)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        with _call(f"{self.url}/embeddings", self.key, {"model": self.settings.embed_model, "input": texts}) as response:
            rows = json.load(response)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    def models(self) -> list[str]:
        with _call(f"{self.url}/models", self.key, None) as response:
            return sorted(r["id"] for r in json.load(response)["data"])

    def reranks(self) -> bool:
        return bool(self.settings.rerank_base_url and self.settings.rerank_model)

    def rerank(self, query: str, documents: list[str]) -> str:
        """The JSON response of the reranking service."""
        body = {"model": self.settings.rerank_model, "query": query, "documents": documents, "top_n": len(documents)}
        with _call(self.settings.rerank_base_url.rstrip("/") + "/rerank", self.settings.rerank_api_key, body, RERANK_TIMEOUT) as response:
            return response.read().decode()


register("endpoint", Endpoint)
