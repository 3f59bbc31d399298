"""Exact token counts by a byte-pair vocabulary, for chunking and budgets."""

from __future__ import annotations

import base64

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ExactCounter:
    """A callable for segment.chunk(count=...): tokens of a text by a file of lines "base64 of a token, its rank".
    It travels as a path and loads the vocabulary where it counts first; without the package tiktoken, or the file,
    it counts a token for four characters, as the columns of functions.text do."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    def _load(self):
        try:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        except (ModuleNotFoundError, FileNotFoundError):
            return False
        return tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        if self._encoding is None:
            self._encoding = self._load()
        if self._encoding:
            return len(self._encoding.encode_ordinary(text))
        return max(1, round(len(text) / 4)) if text else 0
