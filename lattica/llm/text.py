"""Vectorised words, shingles and hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes of text that one vectorised step works on; a longer single text is its own step.
CHUNK_BYTES = 2 << 20

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[ord("0") : ord("9") + 1] = True
_WORD_BYTES[ord("a") : ord("z") + 1] = True
_WORD_BYTES[ord("_")] = True
_WORD_BYTES[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BYTE_VALUE[~_WORD_BYTES] = 0
_PLACE_VALUE = mix64(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | np.uint64(1)
_SLOT_VALUE = mix64(np.arange(9000, 9000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``size`` bytes and at most ``rows`` rows, with the index of their first row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        stop = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, done + size, side="right"))))
        yield begin, texts.slice(begin, stop - begin)
        begin = stop


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the offsets of its rows in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word of every text, and each text's offsets among them.

    A word is a run of ASCII letters, digits, underscores and non-ASCII bytes of the
    lower-cased text.
    """
    body, offsets = raw_bytes(pc.utf8_lower(texts))
    inside = _WORD_BYTES[body]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(starts[0], len(body)) - np.repeat(starts, np.diff(np.append(starts, len(body))))
    value = _BYTE_VALUE[body[starts[0] :]]
    value *= _PLACE_VALUE[place & 4095]
    hashes = np.add.reduceat(value, starts - starts[0])
    return mix64(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles; a text of fewer words has one, of all its words."""
    counts = np.diff(offsets)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    total = int(out_offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), out_offsets
    at = np.arange(total) + np.repeat(offsets[:-1] - out_offsets[:-1], sizes)
    end = np.repeat(offsets[1:], sizes)
    padded = np.append(words, np.zeros(width, np.uint64))
    acc = np.zeros(total, np.uint64)
    short = bool((counts < width).any())
    for j in range(width):
        w = padded[at + j]
        if short:
            w = np.where(at + j < end, w, np.uint64(0))
        acc += w * _SLOT_VALUE[j % SHINGLE]
    return mix64(acc), out_offsets


def words_of(text: str) -> list[bytes]:
    """The words of one text, by the rule of :func:`word_hashes`."""
    import re

    lowered = pc.utf8_lower(pa.array([text or ""], pa.large_string()))[0].as_py()
    return re.findall(rb"[0-9a-z_\x80-\xff]+", lowered.encode())


def shingles_of(words: list[bytes], width: int = SHINGLE) -> list[tuple[bytes, ...]]:
    """The shingles of one text as tuples of words, with repeats."""
    if len(words) < width:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(width)), strict=False))
