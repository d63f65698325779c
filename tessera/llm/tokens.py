"""Token ids of whole texts with a public tokenizer, worked out in numpy for many words at a time.

The tokenizer lower-cases, drops white space, cuts words into pieces (letters, single digits, runs of
other characters) and merges the bytes of each piece by rank. So a text's ids are those of its words one
after another: texts are split and their distinct words found by Arrow's kernels, the pieces of all
distinct words are merged side by side, and the ids of texts gathered. Words beyond the characters that
`_SIMPLE` lists, and texts that hold a special token's string, go to the library as they are.
`tests/llm/test_tokens.py` holds this against the library on whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tessera.llm.common import ship_code

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CHUNK_BYTES = 6_000_000  # of text at a time
CACHE_WORDS, CACHE_CHARS = 50_000, 1_000_000  # of words that went to the library
GROUP = 2_000  # words given to the library at a time
LONGEST = 64  # bytes of a piece that is merged here
CELLS = 1 << 18  # symbols merged at a time

#: Kinds of bytes: letters, digits, other visible ASCII but the apostrophe; 0 is for all else.
LETTER, DIGIT, MARK = 1, 2, 3
_SIMPLE = np.zeros(256, np.uint8)
_SIMPLE[0x21:0x7F] = MARK
_SIMPLE[ord("'")] = 0  # contractions are pieces
_SIMPLE[ord("0") : ord("9") + 1] = DIGIT
_SIMPLE[ord("a") : ord("z") + 1] = LETTER
_LATIN = 0xC3  # with a byte from 0x9F to 0xBF but 0xB7: the small letters U+00DF to U+00FF, each its own normal form

_encoders: dict[int, "WordEncoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible, else the next one from U+0100 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Merges:
    """Ranks and outcomes of pairs of symbols, in a hash table with linear probing."""

    NONE = np.int32(1 << 30)

    def __init__(self, pairs: list[tuple[int, int, int]], symbols: int):
        """pairs: (left, right, outcome) in order of rank."""
        self.symbols, self.shift = np.int64(symbols), np.uint64(64 - max(10, (4 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(size + 64, -1, np.int64), np.full(size + 64, self.NONE, np.int32)
        self.outcome = np.array([p[2] for p in pairs] or [0], np.int32)
        keys = np.array([p[0] * symbols + p[1] for p in pairs], np.int64)
        at, left = self._home(keys), np.arange(len(pairs))
        while len(left):
            free = self.keys[at[left]] < 0
            # of several that want one place the first gets it
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], won
            left = left[self.keys[at[left]] != keys[left]]
            at[left] += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.symbols + right
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] += 1
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def apply(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row (symbols, then anything) until no pair is left that merges, the lowest rank first, the leftmost of equals."""
        n, width = symbols.shape
        out, out_length, row = symbols, length.copy(), np.arange(n)
        if width < 2:
            return out, out_length
        place = np.arange(width)
        live, size = symbols, length.astype(np.int64)
        inner = place[1:] < size[:, None]
        ranks = np.full((n, width), self.NONE, np.int32)
        ranks[:, :-1][inner] = self.rank(live[:, :-1][inner], live[:, 1:][inner])
        out, live = live, live.copy()
        while len(row):
            at = ranks.argmin(axis=1)
            k = np.arange(len(row))
            best = ranks[k, at]
            done = best == self.NONE
            if done.any():
                out[row[done]], out_length[row[done]] = live[done], size[done]
                keep = ~done
                row, live, ranks, size, at, best = row[keep], live[keep], ranks[keep], size[keep], at[keep], best[keep]
                if not len(row):
                    break
                k = np.arange(len(row))
            # what stands right of the merged pair moves up by one
            after = place[:-1] > at[:, None]
            np.copyto(live[:, :-1], live[:, 1:], where=after)
            np.copyto(ranks[:, :-1], ranks[:, 1:], where=after)
            live[k, at] = self.outcome[best]
            size -= 1
            ranks[k, at] = self.NONE
            has = np.flatnonzero(at + 1 < size)
            ranks[has, at[has]] = self.rank(live[has, at[has]], live[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(live[has, at[has] - 1], live[has, at[has]])
        return out, out_length


class WordEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids, with the end id appended."""

    def __init__(self, definition: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.end = np.uint32(end_id).astype("<u4").tobytes()
        self.cache: dict[str, np.ndarray] = {}
        self.chars = 0
        parsed = json.loads(definition)
        model, suffix = parsed["model"], parsed["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.specials = [t["content"] for t in parsed["added_tokens"]]
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in characters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], max(vocab.values()) + 1)

    def encode(self, texts: pa.Array | Sequence[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none) and the end id. Memory follows CHUNK_BYTES and the longest text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        chunk = np.cumsum(sizes) // CHUNK_BYTES
        edges = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1)) if len(chunk) else []
        for a, b in zip(edges, edges[1:]):
            yield from self._chunk(texts.slice(a, b - a))

    def _chunk(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.fill_null("")
        plain = pc.ascii_lower(texts)
        special: np.ndarray = np.zeros(len(texts), bool)
        for mark in self.specials:
            special |= pc.match_substring(plain, mark).to_numpy(zero_copy_only=False)
        if special.any():  # they are told apart by case and cut words, so such texts are left to the library
            plain = pc.if_else(pa.array(special), "", plain)
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        flat, begin, length = self._ids(words.dictionary)
        at = words.indices.to_numpy()
        each = length[at]
        stop = np.cumsum(each)
        total = int(stop[-1]) if len(stop) else 0
        gathered = flat[np.repeat(begin[at] - (stop - each), each) + np.arange(total)].astype("<u4").tobytes()
        edges = np.concatenate([[0], stop])[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if special[k]:
                yield np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes() + self.end
            else:
                yield gathered[a:b] + self.end

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words: all of them in one array, where each word's begin, how many they are."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        size = np.diff(offsets)
        kind = _SIMPLE[data]
        latin = np.flatnonzero(data[:-1] == _LATIN) if len(data) else np.zeros(0, np.int64)
        follows = data[latin + 1]
        latin = latin[(follows >= 0x9F) & (follows <= 0xBF) & (follows != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
        word = np.repeat(np.arange(n), size)
        # Pieces begin with a word, where the kind changes, and at each digit.
        starts = np.ones(len(data), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (word[1:] != word[:-1])
        begin = np.flatnonzero(starts)
        stop = np.append(begin[1:], len(data))[: len(begin)]
        odd = np.zeros(n, bool)
        odd[word[kind == 0]] = True
        odd[word[begin[stop - begin > LONGEST]]] = True
        mine = ~odd[word[begin]]
        begin, stop = begin[mine], stop[mine]
        symbols, counts = self._merged(data, begin, stop)
        length = np.bincount(word[begin], counts, n).astype(np.int64)
        place = np.cumsum(length) - length
        names = np.flatnonzero(odd)
        if len(names):
            found = self._odd(words.take(pa.array(names)).to_pylist())
            length[names] = [len(f) for f in found]
            place[names] = len(symbols) + np.cumsum(length[names]) - length[names]
            symbols = np.concatenate([symbols, *found])
        return symbols, place, length

    def _merged(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all pieces in order, and how many each has. Pieces of like length are merged side by side."""
        size = stop - begin
        counts = np.ones(len(size), np.int64)
        merged: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        ordered = size[order]
        at = 0
        while at < len(order):
            # rows of up to twice the width of the first one
            top = at + max(1, CELLS // int(ordered[min(len(order) - 1, at + CELLS // max(1, int(ordered[at])) // 2)]))
            top = min(top, int(np.searchsorted(ordered, max(4, int(1.3 * ordered[at])), "right")), len(order))
            top = max(top, at + 1)
            rows = order[at:top]
            width = int(ordered[top - 1])
            raw = data[np.minimum(begin[rows][:, None] + np.arange(width), len(data) - 1)]
            symbols = self.inner[raw]
            k = np.arange(len(rows))
            symbols[k, size[rows] - 1] = self.last[raw[k, size[rows] - 1]]
            symbols, found = self.merges.apply(symbols, size[rows])
            counts[rows] = found
            merged.append((rows, symbols, found))
            at = top
        place = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for rows, symbols, found in merged:
            held = np.arange(symbols.shape[1]) < found[:, None]
            out[(place[rows][:, None] + np.arange(symbols.shape[1]))[held]] = symbols[held]
        return out, counts

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.cache, self.chars = {}, 0
        found = {w: self.cache.get(w) for w in words}
        new = [w for w, ids in found.items() if ids is None]
        for k in range(0, len(new), GROUP):
            group = new[k : k + GROUP]
            for word, encoding in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False)):
                found[word] = np.array(encoding.ids, np.int32)
        short = [w for w in new if len(w) <= 100]
        self.cache.update((w, found[w]) for w in short)
        self.chars += sum(map(len, short))
        return [found[w] for w in words]


def definition(spark: SparkSession, path: str | None = None):
    """The tokenizer's definition (at most a few MB, the size of its file) as a broadcast."""
    ship_code(spark)
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def worker_encoder(definition: str, end_id: int) -> WordEncoder:
    """This worker's encoder; it outlives the task."""
    key = hash((definition, end_id))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(definition, end_id)
    return _encoders[key]
