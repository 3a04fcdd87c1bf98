"""Words, word hashes and n-gram hashes of Arrow text columns, without a Python object per word.

A batch of texts is one byte buffer with row offsets.  Word borders come from a table over byte
values, hashes from eight-byte loads, n-grams from a rolling polynomial: all numpy over the buffer.
Hashes depend on the bytes alone, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows are worked on in runs of about so many text bytes.
RUN_BYTES = 4 << 20

U = np.uint64


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """What each byte value counts as: 256 for a separator, else the byte, A-Z lowered if asked."""
    table = np.arange(256, dtype=np.uint16)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 256
    return table


#: `[^\x20\x09-\x0D]+`
BLANKS = bytes([32, *range(9, 14)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lowering
NOT_ALNUM = bytes([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class TextRun:
    """Some rows of a batch: their bytes, row offsets and words."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    table: np.ndarray

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        word = self.table[self.data] != 256
        before = np.zeros_like(word)
        before[1:] = word[:-1]
        starts = self.offsets[:-1]
        before[starts[starts < len(word)]] = False
        after = np.zeros_like(word)
        after[:-1] = word[1:]
        ends = self.offsets[1:]
        after[ends[ends > 0] - 1] = False
        return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1

    @property
    def start(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def end(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def first(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words as last entry."""
        return np.searchsorted(self.start, self.offsets)

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.table[self.data]  # separators are never inside a word
        chunks = np.lib.stride_tricks.as_strided(
            padded[:8].view("<u8"), shape=(len(self.data) + 1,), strides=(1,)
        )
        length = self.end - self.start
        h = mix(length.astype(U) + U(0x9E3779B97F4A7C15) * U(seed + 1))
        todo, done = np.arange(len(length)), 0
        while len(todo):
            left = np.minimum(length[todo] - done, 8)
            part = chunks[self.start[todo] + done]
            part = np.where(left < 8, part & ((U(1) << (U(8) * left.astype(U) % U(64))) - U(1)), part)
            h[todo] = mix(h[todo] ^ part) + U(0x9E3779B97F4A7C15)
            done += 8
            todo = todo[length[todo] > done]
        return h


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; rows are not looked at."""
    if len(hashes) < n:
        return hashes[:0]
    base = 0xD6E8FEB86659FD93
    total, size, power, width, at = None, 0, hashes, 1, n
    while at:
        if at & 1:
            if total is None:
                total, size = power, width
            else:
                m = len(hashes) - size - width + 1
                factor = U(pow(base, width, 1 << 64))
                total, size = total[:m] * factor + power[size : size + m], size + width
        at >>= 1
        if at:
            m = len(hashes) - 2 * width + 1
            power = power[:m] * U(pow(base, width, 1 << 64)) + power[width : width + m]
            width *= 2
    return mix(total)


def text_runs(
    batches: Iterator[pa.RecordBatch], table: np.ndarray, text: str = "text", limit: int = RUN_BYTES
) -> Iterator[TextRun]:
    """Cut batches into runs of rows with about ``limit`` bytes of text; null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        whole = column.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield TextRun(
                batch.slice(at, to - at),
                data[offsets[at] : offsets[to]],
                offsets[at : to + 1] - offsets[at],
                table,
            )
            at = to


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each of ``counts`` items per row."""
    return np.repeat(np.arange(len(counts)), counts)
