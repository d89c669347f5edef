"""The words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on together; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64)
STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column that hold about SLICE_BYTES of text each."""
    if not len(column):
        return
    bounds = _bytes(column)[1]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        yield at, min(end, len(column))
        at = end


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where its texts begin and end; null: empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


@dataclass
class Words:
    """``joined``: the bytes of all texts, words parted by one space and nothing between texts; word i
    lies at starts[i]:ends[i], and text t has the words first[t]:first[t + 1]."""

    joined: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def span(self, a: int, b: int) -> bytes:
        """The words a to b - 1 of one text, joined by a space."""
        return self.joined[self.starts[a] : self.ends[b - 1]].tobytes() if b > a else b""

    def hashes(self, lane: int) -> np.ndarray:
        """A 64-bit hash of each word, computed over the bytes of many words at once."""
        lengths = self.ends - self.starts
        out = np.empty(len(lengths), dtype=np.uint64)
        through = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            end = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + SLICE_BYTES, "right")))
            some = lengths[at:end]
            begin = np.cumsum(some) - some
            inside = np.arange(int(some.sum())) - np.repeat(begin, some)
            values = _BYTE[lane][self.joined[inside + np.repeat(self.starts[at:end], some)]]
            powers = np.full(int(some.max()), STEP[lane], dtype=np.uint64)
            powers[0] = 1
            out[at:end] = np.add.reduceat(values * np.cumprod(powers)[inside], begin) + some.astype(np.uint64)
            at = end
        return mixed(out)


def words(column: pa.Array) -> Words:
    """The words ([^\\x20\\x09-\\x0D]+) of the texts of a string column; null: none."""
    raw, bounds = _bytes(column)
    inside = ~_SPACE[raw]
    before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(raw)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, bounds)
    # One byte of the white space after a word stays, unless the word is the last of its text.
    parted = np.ones(len(ends), dtype=bool)
    parted[first[1:][first[1:] > first[:-1]] - 1] = False
    keep = inside
    keep[ends[parted]] = True
    joined = raw.copy()
    joined[ends[parted]] = 0x20
    joined = joined[keep]
    lengths = ends - starts
    begin = np.cumsum(lengths + parted) - lengths - parted
    return Words(joined, begin, begin + lengths, first)


def sums(values: np.ndarray, step: np.uint64, width: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every ``width`` neighbouring values."""
    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    out = values.copy()
    done, power = 1, step
    # Doubling: a span of 2n is two spans of n; the bits of ``width`` say which spans to join.
    result, covered = np.zeros(0, dtype=np.uint64), 0
    for bit in bin(width)[2:][::-1]:
        if bit == "1":
            if covered:
                n = len(values) - covered - done + 1
                result = result[:n] * power + out[covered : covered + n]
            else:
                result = out
            covered += done
        n = len(out) - done
        out = out[:n] * power + out[done : done + n] if n > 0 else out[:0]
        done, power = 2 * done, np.uint64(int(power) ** 2 % 2**64)
    return mixed(result)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """np.minimum or np.maximum of every ``width`` neighbouring values."""
    if len(values) < width:
        return values[:0]
    out, done = values, 1
    while 2 * done <= width:
        out, done = best(out[:-done], out[done:]), 2 * done
    rest = width - done
    return best(out[:-rest], out[rest:]) if rest else out
