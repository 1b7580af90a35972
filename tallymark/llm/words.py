"""Words of many texts at once: boundaries and 64-bit hashes, in numpy.

Texts arrive as UTF-8 bytes.  A chunk of texts is joined with a separator byte,
so every array below belongs to a bounded number of bytes; one text larger than
the bound is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed values of the contracts: the white space that separates words, and the
#: ASCII bytes that belong to words of the decontamination rule.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
CHUNK_BYTES = 512 << 10

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
IN_WORD = np.array([b not in SPACES for b in range(256)])

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes, with the first row of each run; null is empty."""
    first, held, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text or b"")
        held += len(run[-1]) + 1
        if held >= limit:
            yield first, run
            first, held, run = i + 1, 0, []
    if run:
        yield first, run


def spans(buffer: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = in_word[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _series(name: str, base: int, length: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < length:
        have = np.full(max(length, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[name] = have
    return have


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly (a splitmix finish)."""
    x = values + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same for the same bytes in any buffer."""
    out = np.empty(len(starts), dtype=np.uint64)
    inverse = pow(_MULTIPLIER, -1, 2**64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, side="right")))
        high = ends[to - 1]
        up = _series("up", _MULTIPLIER, high - low + 1)
        down = _series("down", inverse, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((buffer[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


def runs(values: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each ``width`` consecutive values (fewer values: none)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = (out ^ values[i : i + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * seed)
        out ^= out >> np.uint64(29)
    return mix(out, seed)


class Chunk:
    """The words of a run of texts: ``doc`` is each word's text, counted from 0."""

    def __init__(self, texts: list[bytes], table: bytes | None = None, hashed: bool = True):
        self.joined = b"\n".join(texts)
        if table:
            self.joined = self.joined.translate(table)
        self.buffer = np.frombuffer(self.joined, dtype=np.uint8)
        self.starts, self.ends = spans(self.buffer)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = hashes(self.buffer, self.starts, self.ends) if hashed else None


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
