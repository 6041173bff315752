"""Vectorised text handling for Arrow batches: words, word hashes and shingles by numpy, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm import wordcache

U64 = np.uint64
#: Bytes hashed by a table of their own per place; longer spans are taken in blocks of so many.
PLACES = 64
HASHED_BYTES = 1 << 19
_TABLE = np.random.default_rng(20_240_901).integers(0, 2**64, PLACES * 256, dtype=np.uint64)


def _byte_class(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Words `[^\x20\x09-\x0D]+`: every byte but white space.
SPACED = ~_byte_class([0x20, *range(0x09, 0x0E)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all beyond ASCII.
ALNUM = _byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of stretches of a string column; a null counts as an empty text.

    A stretch has at most ``most_bytes`` bytes, or a single longer text whole.
    """
    wordcache.release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin among them (one more entry than texts)."""
    inside = word_bytes[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (all of them non-empty), worked out for about HASHED_BYTES at a time.

    Each byte has a random number per place in a block of PLACES bytes; a block's sum is mixed with its number, and the
    sum of the blocks with the length, so that no pattern of repeated bytes cancels out.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    if len(starts) > 1 and total[-1] > HASHED_BYTES:
        cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(HASHED_BYTES, total[-1], HASHED_BYTES)) + 1, [len(starts)])))
        parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(parts) > 1:
            return np.concatenate([span_hashes(data, starts[a:b], ends[a:b]) for a, b in parts])
    blocks = (lengths + (PLACES - 1)) // PLACES
    if int(blocks.max()) == 1:
        begin, size, number, first = starts, lengths, None, None
    else:
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        begin = np.repeat(starts, blocks) + number * PLACES
        size = np.minimum(np.repeat(ends, blocks) - begin, PLACES)
    base = np.cumsum(size) - size
    shift = np.repeat(begin - base, size)
    at = np.arange(len(shift))
    within = at - np.repeat(base, size)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_TABLE[(within << 8) + data[at + shift]], base)
        if number is not None:
            sums = np.add.reduceat(mix(sums + mix(number.astype(np.uint64) * U64(0xA24BAED4963EE407))), first)
        return mix(sums + lengths.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words in a run of word hashes; with fewer words, of the whole run as one."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * U64(0x9FB21C651E98DF25) + words[k : k + n])
    return out
