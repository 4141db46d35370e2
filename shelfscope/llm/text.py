"""Words of whole texts as 64-bit hashes, computed over Arrow's byte buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Its hash is the sum of a random number per byte
value times odd powers by position, then mixed; no Python string is made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
STEP_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes whose hashes are added up at a time; a task holds some 32 bytes for each.
PIECE = 1 << 16
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(4)
def byte_values(lower: bool, words: bool) -> np.ndarray:
    """A random number per byte value; `lower` gives A-Z the numbers of a-z, `words` separators 0."""
    values = mixed(np.arange(1, 257, dtype=U64) * STEP)
    if lower:
        values[65:91] = values[97:123]
    if words:
        values[SEPARATORS] = 0
    return values


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, 0 to n - 1."""
    both = []
    for base in (STEP, STEP_INVERSE):
        out = np.full(n, base, dtype=U64)
        out[:1] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


@dataclass
class Texts:
    """A column of texts as bytes: text i is data[ends[i]:ends[i + 1]]; null texts are empty."""

    data: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[at[0] : at[-1]], at - at[0])


def word_starts(texts: Texts) -> np.ndarray:
    """Byte positions at which words start, over all texts."""
    if not len(texts.data):
        return np.zeros(0, np.int64)
    inside = ~SEPARATORS[texts.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = texts.ends[1:-1]
    edges = edges[edges < len(inside)]
    first[edges] = inside[edges]
    return np.flatnonzero(first)


def run_hashes(texts: Texts, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash per run of bytes from one start to the next; bytes whose value is 0 do not count."""
    out = np.empty(len(starts), dtype=U64)
    done = 0
    while done < len(starts):
        begin = starts[done]
        stop = max(done + 1, int(np.searchsorted(starts, begin + PIECE)))
        end = starts[stop] if stop < len(starts) else len(texts.data)
        n = int(end - begin)
        up, down = powers(max(PIECE, 1 << (n - 1).bit_length()))
        at = starts[done:stop] - begin
        sums = np.add.reduceat(values[texts.data[begin:end]] * up[:n], at)
        out[done:stop] = sums * down[at]
        done = stop
    return mixed(out)


def words_of(texts: Texts, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash per word, its byte position, and the index of each text's first word (one more at the end)."""
    starts = word_starts(texts)
    return run_hashes(texts, starts, byte_values(lower, True)), starts, np.searchsorted(starts, texts.ends)


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; the whole sequence as one where it is shorter."""
    n = len(words) - size + 1
    if n < 1:
        size, n = len(words), min(1, len(words))
    out = np.zeros(n, dtype=U64)
    for k in range(size):
        out = mixed(out * STEP + words[k : k + n])
    return out


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a record batch with at most `most` bytes of text, a longer text alone."""
    if not batch.num_rows:
        return
    ends = texts_of(batch.column(column)).ends
    done = 0
    while done < batch.num_rows:
        stop = max(done + 1, int(np.searchsorted(ends, ends[done] + most, side="right")) - 1)
        yield batch.slice(done, stop - done)
        done = stop
