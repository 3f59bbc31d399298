"""Vocabulary files of public tokenizers, read on the driver; the path is a parameter."""

from __future__ import annotations

import base64
import os

FOLDER = os.environ.get("HERONRY_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: how the byte-level vocabulary's words are cut before merging (published with it)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str = BYTE_BPE) -> dict[bytes, int]:
    """token -> id of a file with a base64 token and an id a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
