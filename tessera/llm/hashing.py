"""64-bit hashes of words and of windows of words, for many documents at a time in numpy.

Texts are split and their distinct words found by Arrow's kernels; a word's hash adds up hashes of its
bytes at their places, a window's hash folds those of its words in order. Equal windows are taken to be
those of equal hashes: over n windows two different ones meet with a chance of about n^2 / 2^65. Nothing
is kept between calls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def string_hashes(words: pa.Array) -> np.ndarray:
    """The hash of each string of an array without nulls."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    size = np.diff(offsets) if n else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(begin, size)
    each = mix((place.astype(np.uint64) * MIX) ^ (data.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return mix(total[begin + size] - total[begin] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has. Null: none. `lower` lower-cases A-Z."""
    texts = texts.fill_null("")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    found = string_hashes(words.dictionary)[words.indices.to_numpy()]
    edges = split.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    empty = pc.index(words.dictionary, "").as_py()  # beside leading and trailing white space
    if empty >= 0:
        real = words.indices.to_numpy() != empty
        before = np.concatenate([[0], np.cumsum(real)])
        return found[real], np.diff(before[edges])
    return found, np.diff(edges)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The same hashes of words that are split already."""
    return string_hashes(pa.array(words, pa.binary()))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window of `length` words, also across documents; none where there are fewer words."""
    n = max(0, len(words) - length + 1)
    out = mix(words[:n] + np.uint64(length))
    for k in range(1, length):
        out = mix(out * MIX + words[k : k + n])
    return out


def doubled(half: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows of twice `length` from those of `length`."""
    n = max(0, len(half) - length)
    return mix(mix(half[:n] * MIX + half[length : length + n]) + np.uint64(2 * length))


def chunks(rows, size, limit: int = CHUNK_BYTES):
    """Groups rows so that the sum of size(row) stays about under the limit."""
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size(row)
        if total >= limit:
            yield group
            group, total = [], 0
    if group:
        yield group


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return []
    edges = np.flatnonzero(np.diff(np.cumsum(size) // limit, prepend=-1, append=-1)).tolist()
    return list(zip(edges, edges[1:]))
