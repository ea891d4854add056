"""Array-form tokenising of Arrow text columns, shared by the text operators.

All helpers work on the bytes of a whole column slice at once, so no Python code runs per row.
Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z count as a-z.  Bytes of
multi-byte characters never equal a separator in UTF-8, so the byte rule is the character rule.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the 64-bit mixing steps.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each piece holds about ``max_bytes`` of text.

    One text longer than that stays whole in a piece of its own.
    """
    array = batch.column(batch.schema.get_field_index(column))
    if not len(array):
        return
    ends = offsets(array)[1:]
    at, base = 0, int(offsets(array)[0])
    while at < len(array):
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, stop - at)
        at, base = stop, int(ends[stop - 1])


def marked(text: Column, mark: Callable[[pa.Array], np.ndarray]) -> Column:
    """A boolean column that ``mark`` gives for slices of texts; only texts reach the Python tasks, and only
    marks come back, so a filter by it carries no row through them."""

    @F.arrow_udf("boolean")
    def marks(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            parts = [mark(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([array], names=["text"]), "text")]
            yield pa.array(np.concatenate([np.zeros(0, dtype=bool), *parts]))

    return marks(text)


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of each value, one more than there are values."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets between them."""
    if array.null_count:
        array = array.fill_null("")
    at = offsets(array) if len(array) else np.zeros(1, dtype=np.int64)
    data = array.buffers()[2] if len(array) else None
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of maximal runs of True that never cross a bound."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, read eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    out = lengths.astype(np.uint64) * MIX[0] + MIX[2]
    out = mix64(out ^ ((words[starts] & _MASKS[np.minimum(lengths, 8)]) + MIX[0]))
    todo, step = np.flatnonzero(lengths > 8), 1
    while len(todo):
        left = np.minimum(lengths[todo] - 8 * step, 8)
        out[todo] = mix64(out[todo] ^ ((words[starts[todo] + 8 * step] & _MASKS[left]) + MIX[0]))
        step += 1
        todo = todo[lengths[todo] > 8 * step]
    return out


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of its like among the distinct ones, and those as they first occur."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``values`` is sorted in place."""
    values.sort()
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]


@dataclass
class Words:
    """Words of a column slice: hashes, spans in ``data`` and per-document word offsets."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(array: pa.Array) -> Words:
    """All words of a text column slice, lower-cased for A-Z."""
    raw, bounds = text_bytes(array)
    data = LOWER[raw]
    starts, ends = runs(~SPACE[data], bounds)
    return Words(data, bounds, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, bounds))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (``len - n + 1`` results, none if too short)."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, MIX[0], dtype=np.uint64)
    for k in range(n):
        out = mix64(out * MIX[1] + hashes[k : k + count])
    return out


def shingle_sets(array: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingle hashes per document, sorted, end to end, and their offsets.

    A document with fewer words has one shingle, its whole sequence; without words it has none.
    """
    w = words(array)
    counts = np.diff(w.offsets)
    every = windows(w.hashes, n)
    sets = []
    for row in range(len(counts)):
        at, k = w.offsets[row], counts[row]
        if k >= n:
            sets.append(np.unique(every[at : at + k - n + 1]))
        elif k:
            sets.append(windows(w.hashes[at : at + k], int(k)))
        else:
            sets.append(every[:0])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else every[:0]), at
