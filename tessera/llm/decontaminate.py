"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is over normalised words, so its transitions are word numbers. Training documents are
streamed through it; the state and the longest matching length are tracked word by word. A match of at
least `window` words, or of a whole shorter item, is an occurrence; the words that it covers are hit.
Spans are then removed, and documents dropped whose hit share reaches a limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, lean, materialize, ship_code

WINDOW = 10
#: Words of one automaton, at most some 700 bytes each; a larger benchmark is scanned in blocks, one pass for each.
BLOCK_WORDS = 200_000

#: Words are runs of 0-9, a-z and anything beyond ASCII; A-Z are lower-cased.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

MATCHES = "doc_id long, n_words long, n_hit long, items array<string>, spans array<int>"


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items in which each long state occurs."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[str]] = [set()]
        whole: dict[int, set[tuple[int, str]]] = {}
        seen: dict[tuple[int, ...], list[str]] = {}
        for name, words in items:
            if words:
                seen.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers)) for w in words), []).append(name)
        for sequence, names in seen.items():
            state = 0
            for n in sequence:
                state = self._extend(state, n)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[state].update(names)
            if len(sequence) < window:
                whole.setdefault(state, set()).update((len(sequence), x) for x in names)
        while len(ends) < len(self.next):
            ends.append(set())
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            up = self.link[s]
            if self.length[up] >= window:
                ends[up] |= ends[s]
        #: By state: the items that contain its last `window` words; the short items that end there.
        self.items: list[frozenset[str]] = [frozenset()] * len(self.next)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            if self.length[up] >= window:
                self.items[s] = self.items[up]
            elif self.length[s] >= window:
                self.items[s] = frozenset(ends[s])
            self.short[s] = (*self.short[up], *sorted(whole.get(s, ())))
        self.least = min([window, *(len(q) for q in seen)])

    def _extend(self, last: int, n: int) -> int:
        if n in self.next[last]:
            q = self.next[last][n]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, n, q)
        new = self._state(self.length[last] + 1, {}, 0)
        while last != -1 and n not in self.next[last]:
            self.next[last][n] = new
            last = self.link[last]
        if last != -1:
            q = self.next[last][n]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._clone(last, n, q)
        return new

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, n: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(n) == q:
            self.next[p][n] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit spans of a document, merged and in order, and the items with occurring windows."""
        numbers = list(map(self.numbers.get, words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        stop, at = len(numbers), 0
        while at < stop:
            if numbers[at] is None:
                at += 1
                continue
            end = at + 1
            while end < stop and numbers[end] is not None:
                end += 1
            if end - at >= self.least:
                self._run(numbers, at, end, spans, items)
            at = end + 1
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items

    def _run(self, numbers: list, at: int, end: int, spans: list, items: set) -> None:
        after, link, length, window, short, found = self.next, self.link, self.length, self.window, self.short, self.items
        state = matched = 0
        for i in range(at, end):
            n = numbers[i]
            while True:
                to = after[state].get(n)
                if to is not None:
                    state, matched = to, matched + 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            if matched >= window:
                spans.append((i + 1 - matched, i + 1))
                s = state
                items |= found[s]
            if short[state]:
                for size, name in short[state]:
                    if size <= matched:
                        spans.append((i + 1 - size, i + 1))
                        items.add(name)


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items, made when asked for."""
    for rows in item_blocks(benchmark, block_words):
        yield SuffixAutomaton(rows, window)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about `block_words` words, by hash; bytes are counted before a block is gathered."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2), F.lit(0.0))).first()[0]  # no more words than this
    blocks = max(1, -(-int(total) // (2 * block_words)))  # some four bytes a word and more
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield sorted((r.item, normal_words(r.text.encode())) for r in part.toLocalIterator())


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish, schema: str) -> DataFrame:
    """Runs `finish(batch, found)` on all rows: found gives the merged spans and the items of the k-th row of a batch.

    With one block, documents are streamed through its automaton. With more, each block is a pass of its own over
    the rows, so that a worker holds one automaton at a time; only rows that it hits are written, and all passes'
    findings meet by row.
    """
    spark = docs.sparkSession
    ship_code(spark)
    text_at = docs.columns.index("text")
    blocks = item_blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        model = spark.sparkContext.broadcast(SuffixAutomaton(first, window))

        def stream(batches):
            for batch in batches:
                texts = batch.column(text_at).to_pylist()
                yield finish(batch, lambda k: model.value.scan(normal_words(encoded(texts[k]))))

        return docs.mapInArrow(lean(stream), schema)

    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = []
    for rows in chain((first, second), blocks):
        model = spark.sparkContext.broadcast(SuffixAutomaton(rows, window))
        parts.append(materialize(keyed.select("_row", "text").mapInArrow(lean(_hits(model)), "_row long, items array<string>, spans array<int>"), "hits"))
        model.unpersist()
    hits = reduce(DataFrame.union, parts).groupBy("_row").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    joined = materialize(keyed.join(hits, "_row", "left").select(*docs.columns, "_items", "_spans"), "hit")
    discard(keyed, *parts)

    def merge(batches):
        for batch in batches:
            items, spans = (batch.column(k).to_pylist() for k in (-2, -1))
            own = batch.select(batch.schema.names[:-2])
            yield finish(own, lambda k: (union(pairs(spans[k] or [])), set(items[k] or [])))

    return joined.mapInArrow(lean(merge), schema)


def _hits(model):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans, items = model.value.scan(normal_words(encoded(text)))
                if spans:
                    out.append((row, sorted(items), [x for s in spans for x in s]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())))], names=["_row", "items", "spans"])

    return run


def encoded(text: str | bytes | None) -> bytes | None:
    return text.encode() if isinstance(text, str) else text


def pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Scans every whole document: n_words, n_hit, the items (sorted as strings), the hit spans.

    spans is start, end, start, end, ... in words. Null text has no words; items with a null id or text
    and items without words occur nowhere; an empty benchmark hits nothing; equal items all count;
    repeated rows of documents all stay.
    """

    def finish(batch, found):
        out: tuple[list, ...] = ([], [], [], [])
        for k, text in enumerate(batch.column(1).to_pylist()):
            spans, items = found(k)
            for column, x in zip(out, (len(normal_words(text)), sum(b - a for a, b in spans), sorted(items), [x for s in spans for x in s])):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return scanned(rows, benchmark, window, block_words, finish, MATCHES)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `matches`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Removes the hit spans from texts and drops documents of which at least `coverage` is hit.

    Returns all columns of the documents, n_chars of changed texts counted anew where there is such a
    column. Documents without a hit stay as they are, null and empty texts included;
    repeated rows are treated alike; an empty table gives no rows, an empty benchmark changes nothing.
    """
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def finish(batch, found):
        texts = batch.column(text_at).to_pylist()
        keep, changed = [], {}
        for k, text in enumerate(texts):
            spans, _ = found(k)
            hit = sum(b - a for a, b in spans)
            if not hit:
                keep.append(k)
            elif hit < coverage * len(normal_words(text.encode())):
                keep.append(k)
                changed[k] = cut_spans(text, [x for s in spans for x in s])
        columns = list(batch.columns)
        if changed:
            columns[text_at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(columns[chars_at].to_pylist())], columns[chars_at].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).take(pa.array(keep, pa.int64()))

    return scanned(docs, benchmark, window, block_words, finish, docs.schema)
