"""All vectors of a group against each other, block by block, without a row for each pair.

Vectors lie in the shared folder in blocks of up to BLOCK rows of one group. A task takes one block and reads the others of
its group, one at a time. Distances come from a matrix product first, whose rounding error is bounded; only those that may
be among the nearest (or the furthest) are computed again as sums in order of the elements, the value SQL gives.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import lean, scratch

BLOCK = 1024
#: Queries that meet a block in one step of `against_gallery`, those whose rows go out together, and vectors by which its tasks are counted.
STEP, SENT, DEALT = 128, 16, 512
#: Quotients by one divisor are equal only for values as near as this.
ULPS = 1 + 2.0**-50
SLICE = 128  # rows whose distances to a block are looked at together, small enough for a cache
LARGEST = 1e100  # of an element; beyond it squares may overflow


def regular(vectors: DataFrame) -> bool:
    """Whether (group, id, vec) can go by blocks: ids once, vectors of one length with finite elements only."""
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    n, ids, good, least, most = vectors.agg(F.count("*"), F.count_distinct("id"), F.count(F.when(fine, 1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    return n > 0 and n == ids == good and 0 < least == most


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _load(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, whether each is a query, and the vectors by column."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        data = io.BytesIO(f.read())
    return np.load(data), np.load(data), np.ascontiguousarray(np.load(data).T, np.float64)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


class Blocks:
    """(group, id, vec, query) in the shared folder; `listed` has the blocks of each group."""

    def __init__(self, vectors: DataFrame):
        self.spark: SparkSession = vectors.sparkSession
        folder = scratch(self.spark, "vectors")

        def store(batches):
            from pyspark import TaskContext

            fs, path = _open(folder)
            fs.create_dir(path, recursive=True)
            prefix, made = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", []

            def save(group, ids, query, x):
                name = f"{prefix}-{len(made):06d}"
                data = io.BytesIO()
                for part in (ids, query, x):
                    np.save(data, part)
                with fs.open_output_stream(f"{path}/{name}") as f:
                    f.write(data.getvalue())
                made.append((group, f"{folder}/{name}", len(ids)))

            group, held = None, None
            for batch in batches:
                names = batch.column(0).to_numpy(zero_copy_only=False)
                columns = (batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), _matrix(batch.column(3)))
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    part = [c[a:b] for c in columns]
                    if held is not None and names[a] == group:
                        part = [np.concatenate(c) for c in zip(held, part)]
                    elif held is not None:
                        save(group, *held)
                    group, held = names[a], part
                    while len(held[0]) > BLOCK:
                        save(group, *(c[:BLOCK] for c in held))
                        held = [c[BLOCK:] for c in held]
            if held is not None:
                save(group, *held)
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["group", "uri", "n"])

        dealt = vectors.select("group", F.col("id").cast("long").alias("id"), "query", "vec").repartitionByRange("group", "id").sortWithinPartitions("group", "id")
        self.found = [tuple(r) for r in dealt.mapInArrow(lean(store), "group string, uri string, n long").collect()]  # a row for each block
        self.count = sum(n for *_, n in self.found)
        self.listed: dict[str, list[str]] = {}
        for group, uri, _ in self.found:
            self.listed.setdefault(group, []).append(uri)

    def nearest(self, k: int) -> DataFrame:
        """(i, j, d, rank, top): the k nearest j of each i, itself included, of equals the lowest; d is the distance over the row's largest, `top`."""
        found, listed = self.found, self.listed

        def run(batches):
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    group, uri, _ = found[at]
                    ids, _, x = _load(uri)
                    near = Nearest(x, k)
                    for other in listed[group]:
                        j, _, y = _load(other)
                        near.meet(j, y)
                    yield near.rows(ids)

        # a partition for each block
        return self.spark.range(0, len(found), 1, max(1, len(found))).mapInArrow(lean(run), "i long, j long, d double, rank int, top double")

    def against_gallery(self, queries: DataFrame, weight: float) -> DataFrame:
        """(i, j, dist) of each row (group, i, vec, top, near: [(j, m)]) and every vector of its group that is no query.

        m is the overlap of the expanded lists of i and j, 0 where it is missing.
        """
        listed = self.listed

        def run(batches):
            for batch in batches:
                names = batch.column(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for start, stop in zip(cuts, cuts[1:]):
                    for a in range(start, stop, STEP):
                        yield from one(batch.slice(a, min(STEP, stop - a)), listed[names[a]])

        def one(part, uris):
            i, top = part.column(1).to_numpy(), part.column(3).to_numpy()
            x = np.ascontiguousarray(_matrix(part.column(2)).T, np.float64)
            lists = part.column(4)
            row = np.repeat(np.arange(len(i)), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            near, overlap = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for uri in uris:
                j, is_query, y = _load(uri)
                j, y = j[~is_query], y[:, ~is_query]
                if not len(j):
                    continue
                d = np.zeros((len(i), len(j)))
                for p, q in zip(x, y):
                    t = p[:, None] - q[None, :]
                    t *= t
                    d += t
                with np.errstate(invalid="ignore"):
                    d /= top[:, None]  # 0 / 0 where all vectors are equal: NaN, as in the SQL
                m = np.zeros(d.shape)
                at = np.minimum(np.searchsorted(j, near), len(j) - 1)
                hit = j[at] == near
                m[row[hit], at[hit]] = overlap[hit]
                out = (1 - m / (2 - m)) * (1 - weight) + d * weight
                for a in range(0, len(i), SENT):
                    some = i[a : a + SENT]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(j))), pa.array(np.tile(j, len(some))), pa.array(out[a : a + SENT].ravel())], names=["i", "j", "dist"])

        dealt = queries.select("group", "i", "vec", "top", "near").repartition(max(1, self.count // DEALT), "i").sortWithinPartitions("group")
        return dealt.mapInArrow(lean(run), "i long, j long, dist double")


class Nearest:
    """The k nearest and the furthest of the rows x (by column), of all blocks met so far."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k, n = x, k, x.shape[1]
        self.norm = (x * x).sum(axis=0)
        self.left = np.vstack([-2 * x, np.ones(n), self.norm]).T.copy()  # with the other side's: |x|^2 - 2 xy + |y|^2 in one product
        self.top, self.limit = np.zeros(n), np.full(n, np.inf)
        self.row, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        norm = (y * y).sum(axis=0)
        slack = 8 * (len(y) + 8) * 2.0**-53 * (self.norm + norm.max())  # more than rounding can take or add, either way of summing
        right = np.vstack([y, norm, np.ones(len(ids))])
        rows, places = [], []
        for a in range(0, len(self.norm), SLICE):
            part = slice(a, a + SLICE)
            about, most = self.left[part] @ right, slack[part]
            at_least = np.maximum(about.max(axis=1) - 2 * most, self.top[part] - most)
            row, at = np.divmod(np.flatnonzero(about >= at_least[:, None]), len(ids))
            np.maximum.at(self.top, a + row, self._exact(y, a + row, at))
            limit = self.limit[part] + most
            if len(ids) >= self.k and np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(about, self.k - 1, axis=1)[:, self.k - 1] + 3 * most)
            row, at = np.divmod(np.flatnonzero(about <= limit[:, None]), len(ids))
            rows.append(a + row)
            places.append(at)
        row, at = np.concatenate(rows), np.concatenate(places)
        if len(row):
            self._keep(np.concatenate([self.row, row]), np.concatenate([self.j, ids[at]]), np.concatenate([self.d, self._exact(y, row, at)]))

    def _exact(self, y: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(row))
        for p, q in zip(self.x, y):
            t = p[row] - q[at]
            t *= t
            total += t
        return total

    def _keep(self, row: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Of each row the first k by (d, j), and those that division may make equal to the last of them: k of each value."""
        by = np.lexsort((j, d, row))
        row, j, d = row[by], j[by], d[by]
        place = _places(row[1:] != row[:-1])
        last = np.flatnonzero(place == self.k - 1)
        self.limit[row[last]] = d[last] * ULPS
        keep = (place < self.k) | ((d <= self.limit[row]) & (_places((row[1:] != row[:-1]) | (d[1:] != d[:-1])) < self.k))
        self.row, self.j, self.d = row[keep], j[keep], d[keep]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        with np.errstate(invalid="ignore"):
            scaled = self.d / self.top[self.row]
        by = np.lexsort((self.j, scaled, self.row))
        row, place = self.row[by], _places(self.row[by][1:] != self.row[by][:-1])
        first = place < self.k
        by, row = by[first], row[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(self.j[by]), pa.array(scaled[by]), pa.array((place[first] + 1).astype(np.int32)), pa.array(self.top[row])], names=["i", "j", "d", "rank", "top"])


def _places(change: np.ndarray) -> np.ndarray:
    """The place of each element in its run; `change` tells where a run ends, for all elements but the last."""
    at = np.arange(len(change) + 1)
    start = np.concatenate([[True], change])
    return at - np.maximum.accumulate(np.where(start, at, 0))
