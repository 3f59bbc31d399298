"""Token ids in patched frame-of-reference blocks.

A text's token ids are cut into blocks of BLOCK ids. Of each block the minimum is subtracted, the rest
is packed at the smallest width that holds PERCENTILE of its values, and values that are wider leave
their low bits there and go, with their position and high bits, to the block's exception list. A block
is, little-endian: minimum (4 bytes), width (1), exceptions (1), ids (2), the packed bits (lowest bit
first), exception positions (1 each), exception high bits (4 each). block_starts has the byte where each
block begins, so any block is read alone.

Ids come from a byte-level BPE file whose path is a parameter; they equal those of its library. A text
is cut where white space follows other characters, which never splits what the tokenizer matches, and
each distinct part is tokenised once and kept while there is room.

Cases: null and empty texts have 0 tokens, no blocks and an empty blob; ids of any size below 2 ** 32;
a null doc_id and other columns change nothing; repeated rows are encoded each; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import vectext, vocabulary
from heronry.llm.vectext import expand

BLOCK, PERCENTILE, HEADER, KEPT_PARTS = 128, 90, 8, 1_000_000
_BATCH = 4 << 20


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blobs of consecutive lists of ids with these lengths: (all bytes, bytes of each list, all block starts
    inside their list, blocks of each list)."""
    ids = ids.astype(np.int64)
    n_blocks = -(-lengths // block)
    total = int(n_blocks.sum())
    if not total:
        return np.zeros(0, np.uint8), np.zeros(len(lengths), np.int64), np.zeros(0, np.int64), n_blocks
    owner = np.repeat(np.arange(len(lengths)), n_blocks)
    number = np.arange(total) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    size = np.minimum(block, lengths[owner] - number * block)
    first = np.cumsum(size) - size
    low = np.minimum.reduceat(ids, first)
    of = np.repeat(np.arange(total), size)
    place = np.arange(len(ids)) - first[of]
    delta = (ids - low[of]).astype(np.uint64)
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.int64)
    held = np.cumsum(np.bincount(of * 33 + bits, minlength=33 * total).reshape(total, 33), axis=1)
    width = (held * 100 < size[:, None] * percentile).sum(axis=1)
    out_of = bits > width[of]
    n_out = np.bincount(of[out_of], minlength=total)
    packed = (size * width + 7) // 8
    bytes_ = HEADER + packed + 5 * n_out
    at = np.cumsum(bytes_) - bytes_
    blob = np.zeros(int(bytes_.sum()), np.uint8)
    for k in range(4):
        blob[at + k] = low >> 8 * k & 255
    blob[at + 4], blob[at + 5], blob[at + 6], blob[at + 7] = width, n_out, size & 255, size >> 8
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        for lo in range(0, len(some), 4096):
            part = some[lo : lo + 4096]
            grid = np.zeros((len(part), block), np.uint64)
            source = expand(first[part], size[part])
            grid[np.repeat(np.arange(len(part)), size[part]), place[source]] = delta[source]
            cells = (grid[:, :, None] >> np.arange(w, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(len(part), -1)
            rows = np.packbits(cells, axis=1, bitorder="little")
            blob[expand(at[part] + HEADER, packed[part])] = rows[np.repeat(np.arange(len(part)), packed[part]), expand(np.zeros(len(part), np.int64), packed[part])]
    where = np.flatnonzero(out_of)
    if len(where):
        b = of[where]
        nth = np.arange(len(where)) - (np.cumsum(n_out) - n_out)[b]
        base = at[b] + HEADER + packed[b]
        blob[base + nth] = place[where]
        high = delta[where] >> width[b].astype(np.uint64)
        for k in range(4):
            blob[base + n_out[b] + 4 * nth + k] = (high >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8)
    list_bytes = np.bincount(owner, bytes_, len(lengths)).astype(np.int64)
    return blob, list_bytes, at - (np.cumsum(list_bytes) - list_bytes)[owner], n_blocks


def decode_block(blob: bytes, start: int) -> np.ndarray:
    """The ids of the block that begins at byte start."""
    data = np.frombuffer(blob, np.uint8)
    low = int.from_bytes(blob[start : start + 4], "little")
    width, n_out, size = int(data[start + 4]), int(data[start + 5]), int(data[start + 6]) | int(data[start + 7]) << 8
    end = start + HEADER + (size * width + 7) // 8
    bits = np.unpackbits(data[start + HEADER : end], bitorder="little")[: size * width].reshape(size, width).astype(np.int64)
    delta = (bits << np.arange(width)).sum(axis=1)
    where = data[end : end + n_out]
    high = np.frombuffer(blob, "<u4", n_out, end + n_out).astype(np.int64) if n_out else np.zeros(0, np.int64)
    delta[where] |= high << width
    return delta + low


def decode(blob: bytes, block_starts: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(decode_block(blob, s) for s in block_starts)])


def _parts(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of each text begin and end: each is white space, if any, then other characters."""
    n = len(data)
    space = ~vectext.SOLID[data]
    after = np.zeros(n, bool)
    after[1:] = space[1:] & ~space[:-1]
    if n > 3:  # white space beyond ASCII goes on as white space
        b = [data[3 - k : n - k] for k in range(4)]
        wide = ((b[2] == 0xC2) & ((b[1] == 0x85) | (b[1] == 0xA0))) | ((b[3] == 0xE1) & (b[2] == 0x9A)) | ((b[3] == 0xE2) & ((b[2] == 0x80) | (b[2] == 0x81))) | ((b[3] == 0xE3) & (b[2] == 0x80))
        after[3:] &= ~wide
        after[1:3] &= data[0:2] < 0x80
    after[row_starts[:-1][row_starts[:-1] < n]] = True
    begin = np.flatnonzero(after)
    return begin, np.append(begin[1:], n)


class Tokenizer:
    """Ids of many parts of text at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.bpe = tiktoken.Encoding("file", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.first, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many each part has). Equal hashes only say which parts to compare."""
        sample, which = vectext.named(data, begin, end, hashes)
        if len(self.place) > KEPT_PARTS:
            self._clear()
        raw = data.tobytes()
        parts = [raw[b:e] for b, e in zip(begin[sample].tolist(), end[sample].tolist())]
        new = [x for x in parts if x not in self.place]
        lists = [self.bpe.encode_ordinary(x.decode("utf-8", "replace")) for x in new]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.place.update(zip(new, range(len(self.first), len(self.first) + len(new))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter((x for one in lists for x in one), np.int32, int(lengths.sum()))])
        at = np.fromiter((self.place[x] for x in parts), np.int64, len(parts))[which]
        return self.ids[expand(self.first[at], self.length[at])], self.length[at]


def token_blocks(docs: DataFrame, path: str = vocabulary.BYTE_BPE, block: int = BLOCK, percentile: int = PERCENTILE) -> DataFrame:
    """(doc_id, n_tokens, block_starts, data) of every row."""
    if not 1 <= block <= 128:
        raise ValueError("a block has 1 to 128 ids")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.ranks(path))  # its size is the vocabulary's

    def run(batches):
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            doc = batch.column(0)
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            for first, data, row_starts in vectext._slices(texts, _BATCH):
                n_rows = len(row_starts) - 1
                begin, end = _parts(data, row_starts)
                ids, per_part = tokenizer.encode(data, begin, end, vectext.hashes(data, begin, end))
                lengths = np.bincount(np.searchsorted(row_starts, begin, "right") - 1, per_part, n_rows).astype(np.int64)
                blob, bytes_, starts, n_blocks = encode(ids, lengths, block, percentile)
                cut = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.slice(first, n_rows),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(cut(n_blocks)), pa.array(starts.astype(np.int32))),
                        pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(cut(bytes_).tobytes()), pa.py_buffer(blob.tobytes())]),
                    ],
                    ["doc_id", "n_tokens", "block_starts", "data"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, block_starts array<int>, data binary")
