"""Substring dedup by level-wise doubling.

Windows of half the length come first. Of every whole-length window, one half-length window in it is
looked at: that with the smallest hash, which equal windows have at the same place, so nothing is lost
and about a sixth of the places is left. Those that repeat in the corpus, alone, are extended: only
whole-length windows around them are hashed and compared. `levels` goes on doubling from there until no
candidates survive, to tell how long the longest repeats are.

Before each shuffle a task keeps one row for each hash, its first place; what repeats within the task is
settled there. So a window that a third of all documents have is as many rows as there are chunks; these
are aggregated before they meet, and joined back so that Spark can split them over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, lean, materialize, ship_code, splittable
from tessera.llm.hashing import MIX, chunks, doubled, mix, slices, split_words, window_hashes, word_hashes

LENGTH = 20

MARKS = "key long, doc_id long, pos int, n int, text_hash long"
WINDOWS = "key long, doc_id long, text_hash long, pos int, stop int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Chunk:
    """Words of some documents in one array, with their windows of half and of whole length."""

    def __init__(self, texts: pa.Array, length: int):
        self.length, self.half = length, length // 2
        self.words, self.sizes = split_words(texts)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        halves = window_hashes(self.words, self.half)
        whole = doubled(halves, self.half)
        n = len(whole)
        #: Places where a whole window starts, and their hashes.
        self.at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 : length - 1 + n]) if n else np.zeros(0, np.int64)
        self.whole = whole[self.at]
        self.anchor = self._anchors(halves, n)[self.at] if n else self.at
        self.halves = halves

    def _anchors(self, halves: np.ndarray, n: int) -> np.ndarray:
        """The place of the smallest half-length hash in each whole window."""
        least, place = halves[:n].copy(), np.arange(n)
        for k in range(1, self.length - self.half + 1):
            other = halves[k : k + n]
            smaller = other < least
            least = np.where(smaller, other, least)
            place = np.where(smaller, np.arange(k, k + n), place)
        return place

    def place(self, at: np.ndarray) -> np.ndarray:
        """Places in their documents."""
        return at - self.starts[self.doc[at]]


def firsts(keys: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by key, then the order columns: the permutation, the index of each row's first one, counts of groups by row."""
    perm = np.lexsort((*order[::-1], keys))
    sorted_keys = keys[perm]
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return perm, begin[group] if len(keys) else perm, np.bincount(group)[group] if len(keys) else perm


def by_place(perm: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns in sorted order, put back in the order of places: neighbours then compress well."""
    out = []
    for column in columns:
        back = np.empty_like(column)
        back[perm] = column
        out.append(back)
    return out


def _scatter(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of rows that are settled already: spread evenly, equal to no other by more than chance."""
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def marks(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Half-length windows that repeat: (doc_id, pos); a text that an earlier document equals word by word: pos -1 and its text_hash.

    The second table is what the first one reads.
    """

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                c = Chunk(part.column(1), length)
                ids, hashes = part.column(0).to_numpy(), part.column(2).to_numpy()
                at = np.unique(c.anchor)
                pos = c.place(at)
                doc = ids[c.doc[at]]
                perm, first, count = firsts(c.halves[at], doc, pos)
                lead = first == np.arange(len(perm))
                lead, count = by_place(perm, lead, count)
                keys = np.where(lead, c.halves[at], _scatter(doc, pos + 7))
                out = [keys, doc, pos, np.where(count > 1, 2, 1)]
                # whole documents
                long = np.flatnonzero(c.sizes >= length)
                sums = np.array([int(window_hashes_of(c.words[c.starts[k] : c.starts[k + 1]])) for k in long], np.uint64)
                perm, first, _ = firsts(sums, ids[long])
                own, lead_id = ids[long][perm], ids[long][perm][first] if len(long) else ids[:0]
                lead = first == np.arange(len(perm))
                copy = own != lead_id
                use = lead | copy
                tail = [np.where(copy, _scatter(own, own), sums[perm])[use], own[use], np.where(copy, -2, -1)[use], np.ones(int(use.sum()), np.int64)]
                text_hash = pa.chunked_array([pa.nulls(len(pos), pa.int64()), pa.array(hashes[long][perm][use], pa.int64())]).combine_chunks()
                keys, doc, pos, n = (np.concatenate([x, y]) for x, y in zip(out, tail))
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(doc, pa.int64()), pa.array(pos.astype(np.int32), pa.int32()), pa.array(n.astype(np.int32), pa.int32()), text_hash], names=["key", "doc_id", "pos", "n", "text_hash"])

    raw = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "text_hash")
    found = materialize(raw.mapInArrow(lean(run), MARKS), "halves")
    # What repeats within its chunk is settled; of the others those whose key comes again. Keys are counted before they are joined back.
    often = found.where("pos >= 0").groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    alone = found.where("pos >= 0 AND n = 1").join(splittable(often, "key"), "key")
    earliest = found.where("pos = -1").groupBy("key").agg(F.min("doc_id").alias("first"))
    copies = found.where("pos = -1").join(splittable(earliest, "key"), "key").where("first < doc_id")
    names = ["doc_id", "pos", "text_hash"]
    marked = found.where("pos >= 0 AND n > 1").select(names).union(alone.select(names)).union(copies.select(names)).union(found.where("pos = -2").select("doc_id", F.lit(-1), "text_hash"))
    return marked, found


def window_hashes_of(words: np.ndarray) -> np.uint64:
    """One hash of a whole sequence of words."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    return mix(np.array([np.sum(mix(words + place * MIX), dtype=np.uint64)], np.uint64) + np.uint64(len(words)))[0]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans of words, [start, stop) of (doc_id, text_hash), that windows cover whose words start earlier too."""

    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), batch.column(3), batch.column(4).to_pylist()))
            rows = [(d, h, t, None if copy else np.asarray(p.values)) for d, h, t, p, copy in rows if copy or (p.is_valid and len(p))]
            for group in chunks(rows, lambda r: len(r[2])):
                yield from one(group)

    def one(group):
        out: list[list[np.ndarray]] = [[], [], [], [], []]

        def add(keys, ids, hashes, pos, stop):
            for column, x in zip(out, (keys, ids, hashes, pos, stop)):
                column.append(np.asarray(x))

        whole = [(d, h, t) for d, h, t, p in group if p is None]
        if whole:
            ids, hashes = np.array([d for d, _, _ in whole]), np.array([h for _, h, _ in whole])
            n = split_words(pa.array([t for _, _, t in whole], pa.string()))[1]
            add(_scatter(ids, hashes), ids, hashes, np.zeros(len(ids), np.int64), n)
        rest = [r for r in group if r[3] is not None]
        if rest:
            c = Chunk(pa.array([t for _, _, t, _ in rest], pa.string()), length)
            good = np.zeros(len(c.words) + 1, bool)
            good[np.concatenate([c.starts[k] + p[p <= c.sizes[k]] for k, (_, _, _, p) in enumerate(rest)])] = True
            live = good[c.anchor]
            at, keys = c.at[live], c.whole[live]
            ids, hashes = np.array([r[0] for r in rest])[c.doc[at]], np.array([r[1] for r in rest])[c.doc[at]]
            pos = c.place(at)
            perm, first, _ = firsts(keys, ids, pos)
            own, where = ids[perm], pos[perm]
            later = (own != own[first]) | (where != where[first]) if len(perm) else np.zeros(0, bool)
            lead = ~later & ((first == np.arange(len(perm))) | (hashes[perm] != hashes[perm][first]))
            (lead,) = by_place(perm, lead)
            add(keys[lead], ids[lead], hashes[lead], pos[lead], np.full(int(lead.sum()), -1))
            # windows settled here, as spans
            mark = np.sort(at[perm[later]])
            if len(mark):
                cuts = np.flatnonzero((np.diff(mark) > length) | (np.diff(c.doc[mark]) > 0)) + 1
                a, b = mark[np.concatenate([[0], cuts])], mark[np.concatenate([cuts - 1, [len(mark) - 1]])]
                d, h = np.array([r[0] for r in rest])[c.doc[a]], np.array([r[1] for r in rest])[c.doc[a]]
                add(_scatter(d, h.view(np.uint64) + a.astype(np.uint64)), d, h, c.place(a), c.place(b) + length)
        if out[0]:
            keys, ids, hashes, pos, stop = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(pos.astype(np.int32), pa.int32()), pa.array(stop.astype(np.int32), pa.int32())], names=["key", "doc_id", "text_hash", "pos", "stop"])

    # Each step is written, so that the shuffles of one are gone when the next one's begin.
    marked, halves = marks(docs, length)
    marked = materialize(marked, "marks")
    discard(halves)
    windows = F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.col("pos")))).alias("marks")
    by_doc = marked.groupBy("doc_id").agg(windows, F.collect_set(F.when(F.col("pos") < 0, F.col("text_hash"))).alias("copies"))
    joined = docs.join(by_doc, "doc_id").select("doc_id", "text_hash", "text", "marks", F.array_contains("copies", F.col("text_hash")).alias("copy"))
    found = materialize(joined.mapInArrow(lean(run), WINDOWS), "windows")
    discard(marked)
    earliest = found.where("stop < 0").groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    later = found.where("stop < 0").join(splittable(earliest, "key"), "key").where(F.struct("doc_id", "pos") > F.col("first"))
    judged = found.where("stop >= 0").select("doc_id", "text_hash", F.col("pos").alias("start"), "stop")
    spans = materialize(judged.union(later.select("doc_id", "text_hash", "pos", F.col("pos") + length)), "spans")
    discard(found)
    return spans


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window that also starts earlier; doc_id, n_words, n_removed, kept_sha256.

    `with_text` adds the kept words. Null text has no words. A row with a null doc_id has no place in the
    order and stays whole. Repeated rows share their places, so neither is earlier and both stay alike;
    of different texts under one doc_id, the earlier place wins. Windows are judged on the input. An empty table gives no rows.
    """
    if length < 2 or length % 2:
        raise ValueError("length must be even, 2 or more")
    ship_code(docs.sparkSession)
    rows = _rows(docs)
    spans = repeats(rows, length).groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("start", "stop", "text_hash")])
    joined = rows.join(spans.withColumnRenamed("text_hash", "of"), "doc_id", "left").select("doc_id", F.col("text").cast("binary").alias("raw"), "text_hash", "start", "stop", "of")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, text_hash, starts, stops, of in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), *batch.columns[3:]):
                words = text.split()
                kept = words
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    own = np.asarray(of.values) == text_hash
                    np.add.at(edge, np.asarray(starts.values)[own], 1)
                    np.add.at(edge, np.asarray(stops.values)[own], -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                joined = b" ".join(kept)
                for column, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None)):
                    column.append(x)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[3], pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return joined.mapInArrow(lean(run), RESULT + ", kept string" * with_text)


def levels(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """How far repeats go: length, 2 * length, ... until none survive: length, windows, places.

    At each level only windows both halves of which repeated at the level before are compared.
    """
    ship_code(docs.sparkSession)
    spark = docs.sparkSession
    rows = _rows(docs).where("doc_id IS NOT NULL").select("doc_id", "text_hash", F.col("text").cast("binary").alias("raw"))

    def run(batches):
        for batch in batches:
            for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = doubled(window_hashes(word_hashes(text.split()), length // 2), length // 2)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array([doc] * len(h), pa.int64()), pa.array([text_hash] * len(h), pa.int64()), pa.array(np.arange(len(h), dtype=np.int32))], names=["key", "doc_id", "text_hash", "pos"])

    live, out, size = rows.mapInArrow(lean(run), "key long, doc_id long, text_hash long, pos int"), [], length
    while True:
        many = live.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        live = materialize(live.join(many.select("key"), "key"), "level")
        windows, places = live.agg(F.count_distinct("key"), F.count("*")).first()
        if not places:
            break
        out.append((size, windows, places))
        after = live.select("doc_id", "text_hash", (F.col("pos") - size).alias("pos"), F.col("key").alias("next"))
        live = live.join(after, ["doc_id", "text_hash", "pos"]).select(F.xxhash64("key", "next").alias("key"), "doc_id", "text_hash", "pos")
        size *= 2
    return spark.createDataFrame(out, "length int, windows long, places long")
