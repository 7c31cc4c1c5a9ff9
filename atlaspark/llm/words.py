"""Words of whole batches of texts as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are cut into words at a time.
BLOCK = 4 << 20
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Longer words are hashed one at a time.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, one to one, to numbers whose every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Bytes of some texts (or of one stretch of a longer one), lower-cased: text i is data[edges[i]:edges[i + 1]] and stands at row rows[i].

    `opens` and `closes`: whether the first text's start and the last one's end are here.
    """

    data: np.ndarray
    edges: np.ndarray
    rows: np.ndarray
    opens: bool = True
    closes: bool = True


def blocks(column: pa.Array, breaks: bytes, most: int = BLOCK) -> Iterator[Texts]:
    """The texts of a column (null: empty) in blocks of about `most` bytes.

    A longer text comes in stretches of that size, each but the last ending
    after a byte of `breaks`, so that no word is cut; a word longer than that
    makes its stretch longer.
    """
    column = column.cast(pa.large_binary())
    n = len(column)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, "right")) - 1)
        start, stop = int(edges[first]), int(edges[last])
        if stop - start <= most:
            yield Texts(LOWER[whole[start:stop]], edges[first : last + 1] - start, np.arange(first, last))
        else:
            at = start
            while True:
                end = min(stop, at + most)
                while end < stop and whole[end - 1] not in breaks:
                    ahead = np.flatnonzero(np.isin(whole[end : end + most], list(breaks)))
                    end = min(stop, end + (int(ahead[0]) + 1 if len(ahead) else most))
                yield Texts(LOWER[whole[at:end]], np.array([0, end - at]), np.array([first]), at == start, end == stop)
                at = end
                if at == stop:
                    break
        first = last


def cut(texts: Texts, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: maximal runs of bytes for which `parting` (by byte) is false, within a text."""
    inside = np.zeros(len(texts.data) + 2, bool)
    inside[1:-1] = ~parting[texts.data]
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = texts.edges[1:-1]
    joined = edges[inside[edges] & inside[edges + 1]]
    starts[joined] = ends[joined] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes a turn over all words that still have some."""
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    found = sizes.astype(np.uint64) * _MULTIPLIERS[1]
    open_ = np.arange(len(sizes))
    for k in range(0, LONG, 8):
        left = np.minimum(sizes[open_] - k, 8)
        part = eight[starts[open_] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))
        found[open_] = mixed(found[open_] ^ part)
        open_ = open_[sizes[open_] > k + 8]
        if not len(open_):
            break
    for i in np.flatnonzero(sizes > LONG):
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return found
