"""N-gram Jaccard join: documents link when their sets of word shingles overlap enough.

A blocked sparse matrix product of document by shingle incidence: overlap counts accumulate over columns
and pairs below size-derived bounds are discarded. Equal sets are one row of the matrix (a node).

The columns have an order: those common in a sample of documents come last, the rest go by hash. A row
takes part with its prefix, its first n - rest(n) columns. Linked sets of n and m shingles have most of
both in common, so their prefixes share `need(n, m)` columns at least, and each row `row_need(n)` with
any partner. Any order of the columns keeps this exact; the sample only makes it cheap.

1. Product of the prefixes. Rows that have fewer columns in common with others than row_need(n) can't
   link and go. A column's rows are multiplied with up to PIVOTS rows of it, so the work
   follows the rows of a column, not their square. Counts add up by pair; pairs whose sizes differ too
   much or whose count, with all that columns not multiplied in full could add, stays below need(n, m)
   are discarded. Of the others the whole overlap is counted, and links make components.
2. Rest. A column is settled if every pair of its rows was multiplied, or if all its rows are in one
   component by now. What is left goes into blocks of rows of like sizes; compatible blocks are multiplied
   in full, column slice by column slice, and of the links found those that join components are returned.

So every pair that could still change a component is computed in step 2, none is written out before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, file_system, lean, materialize, scratch, ship_code, splittable
from tessera.llm.components import connected_components
from tessera.llm.hashing import mix, slices, split_words, window_hashes

SHINGLE = 5
PERCENT = 75
EXTRA = 20
PIVOTS = 4
SAMPLE_DOCS = 20_000  # expected number of documents by which columns are ordered
COMMON = 1 << 18  # shingles that the order knows as common, at most
BLOCK_NODES, BLOCK_SHINGLES = 1024, 600_000
SLICE = 4096

ROWS = "doc_id long, n_shingles long, node long, text_hash long, prefix array<long>"


def floor_div(x, k: int):
    """For columns and arrays of whole numbers alike."""
    return (x - x % k) / k


def least(n):
    """The least number of shingles that a set of n shares with a linked one: PERCENT of it."""
    return floor_div(PERCENT * n + 99, 100)


def rest(n):
    """How many columns of a set of n are beyond its prefix. Each EXTRA shingles lengthen the prefix by one column, which all counts then must reach."""
    return least(n) - 1 - floor_div(n, EXTRA)


def need(n, m, more):
    """The least number of prefix columns that linked sets of n and m share; `more` is the greater of rest(n) and rest(m).

    The overlap is at least PERCENT / (100 + PERCENT) * (n + m). All of it that is beyond what the prefixes
    share is beyond the prefix of that set whose prefix ends first.
    """
    return floor_div(PERCENT * (n + m) + 99 + PERCENT, 100 + PERCENT) - more


def row_need(n):
    """The least number of prefix columns that a set of n shares with any linked set, which has least(n) shingles or more."""
    return 1 + floor_div(least(n), EXTRA)


def sets_of(texts: pa.Array, length: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of one with fewer words, one hash of the whole sequence."""
    words, counts = split_words(texts, lower=True)
    found, out, at = window_hashes(words, length), [], 0
    for k in counts.tolist():
        if k >= length:
            one = np.sort(found[at : at + k - length + 1])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif k:
            one = mix(words[at : at + 1] + np.uint64(1000 + k))
            for w in words[at + 1 : at + k]:
                one = mix(one + w)
            out.append(one)
        else:
            out.append(words[:0])
        at += k
    return out


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """One hash of each set."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(17)), dtype=np.uint64)])
    stop = np.cumsum(size)
    return mix(total[stop] - total[stop - size] + size.astype(np.uint64)).view(np.int64)


class Order:
    """The order of columns: shingles common in a sample last, by their number there; then by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.counts = shingles[by], counts[by]
        self.seen = np.zeros(1 << 20, bool)  # what the first 20 bits rule out
        self.seen[(self.shingles >> np.uint64(44)).astype(np.int64)] = True

    def prefix(self, found: np.ndarray) -> np.ndarray:
        """The prefix of a sorted set."""
        size = len(found) - int(rest(len(found))) if len(found) else 0
        maybe = np.flatnonzero(self.seen[(found >> np.uint64(44)).astype(np.int64)]) if len(self.shingles) else found[:0]
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingles, found[maybe]), len(self.shingles) - 1)
            hit = self.shingles[at] == found[maybe]
            if hit.any():
                weight = np.zeros(len(found), np.int64)
                weight[maybe[hit]] = self.counts[at[hit]]
                return found[np.argsort(weight, kind="stable")[:size]]
        return found[:size]


def order_of(docs: DataFrame, length: int, sample_docs: int = SAMPLE_DOCS) -> Order:
    """Counts the shingles of about `sample_docs` documents, chosen by hash; the COMMON most frequent ones come to the driver."""
    total = docs.count()
    chosen = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).where(F.pmod("h", F.lit(1 << 31)) < int((1 << 31) * min(1.0, sample_docs / max(total, 1))))

    def count(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                sets = sets_of(batch.column(0).slice(a, b - a), length)
                found, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"])

    counted = chosen.select("text").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    return Order(top["token"].to_numpy().view(np.uint64), top["n"].to_numpy())


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)))


def prefixes(docs: DataFrame, order: Order, length: int = SHINGLE) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(order)  # at most COMMON shingles

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = sets_of(batch.column(1).slice(a, b - a), length)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes_of(sets)), part.column(2), _lists([spread.value.prefix(s) for s in sets])],
                    names=["doc_id", "n_shingles", "node", "text_hash", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", text_hash("text")).mapInArrow(lean(run), ROWS)


def text_hash(text: str):
    return F.xxhash64(F.col(text).cast("string").cast("binary"))


def full_sets(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(node, n, shingles) of the wanted (node, doc): only their documents are read again.

    `doc` is the hash of the text where a row has no id; one that equals an id costs a row more, no result. Of
    repeated rows each task keeps one; what is left of them gives links twice, which changes no component.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for a, b in slices(batch.column(1)):
                sets = sets_of(batch.column(1).slice(a, b - a), length)
                good = [k for k in np.flatnonzero(nodes_of(sets) == nodes[a:b]).tolist() if nodes[a + k] not in seen and not seen.add(nodes[a + k])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a:b][good]), pa.array([len(sets[k]) for k in good], pa.int64()), _lists([sets[k] for k in good])], names=["node", "n", "shingles"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    rows = raw.withColumn("doc", F.coalesce("doc", text_hash("text"))).join(wanted, "doc").select("node", "text")
    return rows.mapInArrow(lean(run), "node long, n long, shingles array<long>")


def linked(overlap, n, m):
    """100 * intersection >= PERCENT * union, for columns and arrays alike."""
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks (columns of all rows, number by row), added up over slices of their common columns."""
    common = np.intersect1d(np.unique(a[0]), np.unique(b[0]), assume_unique=True)
    counts = np.zeros((len(a[1]), len(b[1])), np.float32)

    def entries(block):
        at = np.searchsorted(common, block[0])
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == block[0]) if len(common) else np.zeros(len(at), bool)
        rows, at = np.repeat(np.arange(len(block[1])), block[1])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return rows[order], at[order]

    left, right = entries(a), entries(b)
    for start in range(0, len(common), SLICE):
        dense = []
        for (rows, at), block in ((left, a), (right, b)):
            lo, hi = np.searchsorted(at, (start, start + SLICE))
            one = np.zeros((len(block[1]), min(SLICE, len(common) - start)), np.float32)
            one[rows[lo:hi], at[lo:hi] - start] = 1
            dense.append(one)
        counts += dense[0] @ dense[1].T
    return counts


class Block:
    """Nodes of a block, from its file: sizes, roots and open columns at once, shingles where they are needed."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        n, columns = self._read(0, 2)
        head = self._read(2, 3 * n + columns)
        self.sizes, self.roots, self.counts, self.columns = head[:n], head[n : 2 * n], head[2 * n : 3 * n], head[3 * n :]
        self.start, self.found = 2 + 3 * n + columns, None

    def _read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(8 * at)
        return np.frombuffer(self.file.read(8 * int(n)), np.int64)

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the chosen rows, and their number by row."""
        if self.found is None:
            self.found = self._read(self.start, int(self.sizes.sum()))
        return self.found[np.repeat(chosen, self.sizes)], self.sizes[chosen]

    @staticmethod
    def save(rows: list[tuple], sink) -> None:
        """rows: (size, root, columns, shingles)."""
        columns, found = [r[2] for r in rows], [r[3] for r in rows]
        head = [[len(rows), sum(map(len, columns))], [r[0] for r in rows], [r[1] for r in rows], [len(c) for c in columns]]
        for part in (*head, *columns, *found):
            sink.write(np.asarray(part, np.int64).tobytes())


def _joins(a: Block, b: Block) -> list[tuple[int, int]]:
    """Links between two blocks that join components; those that follow from others are left out.

    Pairs whose sizes differ too much or that share too few columns are discarded; only their rows that
    are left take part in the product of full sets.
    """
    n, m = a.sizes[:, None], b.sizes[None, :]
    fits = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (a.roots[:, None] != b.roots[None, :])
    if fits.any():
        fits &= _product((a.columns, a.counts), (b.columns, b.counts)) >= need(n, m, np.maximum(rest(n), rest(m)))
    rows, columns = fits.any(axis=1), fits.any(axis=0)
    if not rows.any():
        return []
    overlap = _product(a.rows(rows), b.rows(columns))
    found = fits[np.ix_(rows, columns)] & linked(overlap, n[rows], m[:, columns])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right, out = a.roots[rows], b.roots[columns], []
    for i, j in zip(*np.nonzero(found)):
        x, y = top(int(left[i])), top(int(right[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(left[i]), int(right[j])))
    return out


def block_links(rest: DataFrame, folder: str) -> DataFrame:
    """Links that join components among rows (node, n, root, part, columns, shingles), by blocks of compatible sizes.

    `part` tells nodes apart that share no column even by way of others; only blocks whose parts meet are
    multiplied. Blocks are files in the shared folder; a task holds two of them and their product.
    """

    def store(batches):
        from pyspark import TaskContext

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        prefix = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        made: list[tuple] = []

        def save(rows):
            name = f"{prefix}-{len(made):06d}"
            with fs.open_output_stream(f"{path}/{name}") as f:
                Block.save([(len(r[4]), r[2], r[3], r[4]) for r in rows], f)
            parts, roots = [r[1] for r in rows], [r[2] for r in rows]
            made.append((rows[0][0], f"{folder}/{name}", min(parts), max(parts), min(roots), max(roots)))

        group, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, part, root = (batch.column(c)[k].as_py() for c in range(3))
                columns, found = (np.asarray(batch.column(c)[k].values) for c in (3, 4))
                if group and (group[0][0] != bucket or len(group) >= BLOCK_NODES or size + len(found) > BLOCK_SHINGLES):
                    save(group)
                    group, size = [], 0
                group.append((bucket, part, root, columns, found))
                size += len(found)
        if group:
            save(group)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)], names=["bucket", "block", "part_low", "part_high", "root_low", "root_high"])

    def multiply(batches):
        kept: dict[str, Block] = {}
        for batch in batches:
            for left, right in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                kept = {k: v for k, v in kept.items() if k in (left, right)}
                for uri in (left, right):
                    if uri not in kept:
                        kept[uri] = Block(uri)
                found = _joins(kept[left], kept[right])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # Sizes within a bucket, or in neighbouring ones, are all that the bound allows.
    bucket = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) + 1e-9)
    dealt = rest.select(bucket.alias("bucket"), "part", "root", "columns", "shingles", "node").repartitionByRange("bucket", "part", "root", "node").sortWithinPartitions("bucket", "part", "root", "node")
    made = dealt.drop("node").mapInArrow(lean(store), "bucket long, block string, part_low long, part_high long, root_low long, root_high long")
    blocks = materialize(made, "block-names")
    names = [c for c in blocks.columns if c != "bucket"]
    left = blocks.select(*[F.col(c).alias(f"x_{c}") for c in names], F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("bucket").alias("own"))
    meet = "x_part_low <= part_high AND part_low <= x_part_high AND NOT (x_root_low = x_root_high AND root_low = root_high AND x_root_low = root_low)"
    pairs = left.join(blocks, "bucket").where((F.col("own") < F.col("bucket")) | (F.col("x_block") <= F.col("block"))).where(meet)
    pairs = materialize(pairs.select(F.col("x_block").alias("x"), F.col("block").alias("y")), "block-pairs")
    return pairs.repartition(max(1, min(pairs.count(), 100_000)), "x", "y").mapInArrow(lean(multiply), "a long, b long")


def product(shared: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multiplies the columns (token, node) with their pivots: pairs (a, b) that may link; rows (token, node) of columns not multiplied in full.

    A column's rows fall into PIVOTS classes by hash; the smallest node of each class is a pivot.
    """
    kind = F.pmod(F.xxhash64("token", "node"), F.lit(PIVOTS))
    pivots = [F.min(F.when(kind == k, F.col("node"))).alias(f"p{k}") for k in range(PIVOTS)]
    columns = shared.groupBy("token").agg(F.count("*").alias("rows"), *pivots)
    names = F.array_compact(F.array(*[f"p{k}" for k in range(PIVOTS)]))
    columns = columns.select("token", names.alias("pivots"), (F.col("rows") - F.size(names) > 1).alias("open"))
    met = materialize(shared.join(splittable(columns, "token"), "token"), "met")
    open_ = met.where("open").select("token", "node")
    # Of two pivots of a column only one is the other's row.
    partner = met.select("node", F.explode("pivots").alias("pivot"), F.array_contains("pivots", F.col("node")).alias("own")).where((F.col("pivot") < F.col("node")) | ((F.col("pivot") > F.col("node")) & ~F.col("own")))
    counts = partner.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(F.count("*").alias("c"))
    more = open_.groupBy("node").agg(F.count("*").alias("more"))
    sizes = nodes.select("node", "n").join(more, "node", "left").select("node", "n", F.coalesce("more", F.lit(0)).alias("more"))
    for side in ("a", "b"):
        counts = counts.join(splittable(sizes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("more").alias(f"more_{side}")), side), side)
    n, m = F.col("n_a"), F.col("n_b")
    fits = (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (F.col("c") + F.least("more_a", "more_b") >= need(n, m, F.greatest(rest(n), rest(m))))
    pairs, rest_ = materialize(counts.where(fits).select("a", "b"), "pairs"), materialize(enough(open_, nodes), "open")
    discard(met)
    return pairs, rest_


def enough(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (token, node) of nodes that have row_need(n) of them or more."""
    held = rows.groupBy("node").agg(F.count("*").alias("k")).join(nodes.select("node", "n"), "node").where(F.col("k") >= row_need(F.col("n"))).select("node")
    return rows.join(held, "node", "left_semi")


def _labelled(docs: DataFrame, length: int) -> DataFrame:
    """A row for each document: doc_id, n_shingles, text_hash, root and component; no root without shingles."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = materialize(prefixes(docs, order_of(docs, length), length).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    having = rows.where("n_shingles > 0")
    named = having.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc"), F.min("text_hash").alias("hash"), F.max("n_shingles").alias("n"))
    nodes = materialize(named.select("node", "row", F.coalesce("doc", "hash").alias("place"), "doc", "n"), "nodes")
    # The columns that two or more nodes have in their prefixes
    tokens = having.join(nodes.select("row"), "row", "left_semi").select("node", F.explode("prefix").alias("token"))
    # Written first, so that its shuffle is gone when the columns are shuffled with their nodes.
    often = materialize(tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token"), "often")
    repeated = materialize(tokens.join(splittable(often, "token"), "token").select("token", "node"), "repeated")
    shared = materialize(enough(repeated, nodes), "columns")
    discard(repeated, often)
    pairs, open_ = product(shared, nodes)
    discard(shared)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(open_.select("node")).distinct()
    sets = materialize(full_sets(docs, wanted.join(nodes, "node").select("node", F.col("place").alias("doc")), length), "sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in ("a", "b"))
    overlap = pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("o"))
    links = materialize(overlap.where(linked(F.col("o"), F.col("n_a"), F.col("n_b"))).select("a", "b"), "links")
    discard(pairs)
    roots = connected_components(links)
    # The rest
    live = open_.join(nodes.select("node", "n"), "node").join(roots, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
    for _ in range(2):
        unsettled = live.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        before, live = live, materialize(enough(live.join(splittable(unsettled, "token"), "token"), nodes), "unsettled")
        discard(before)
    # Nodes that share no column, not even by way of others, are parts of their own.
    least_node = live.groupBy("token").agg(F.min("node").alias("least"))
    ties = live.join(splittable(least_node, "token"), "token").select(F.col("node").alias("a"), F.col("least").alias("b"))
    parts = connected_components(ties).select("node", F.col("root").alias("part"))
    open_nodes = live.groupBy("node", "root").agg(F.collect_list("token").alias("columns"))  # at most a quarter of the node's own set
    rest = open_nodes.join(parts, "node").join(sets, "node").select("node", "n", "root", "part", "columns", "shingles")
    store = scratch(spark, "blocks")
    final = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(block_links(rest, store)))
    discard(store, open_, live, sets, links)
    labelled = nodes.join(final, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc").alias("component"))
    labels = labelled.join(splittable(smallest, "root"), "root").select("node", "root", "component")
    return rows.select("doc_id", "n_shingles", "text_hash", "node").join(labels, "node", "left").drop("node")


def components(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Repeated rows
    all stay, in one component. Rows with a null doc_id are nodes like others but never name a component
    unless it has no other id.
    """
    return _labelled(docs, length).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """One document of each component, that of the smallest id, with all columns.

    A document is its doc_id and its text: different texts under one id, or without an id, are judged by their
    own components. A row without an id stays only where its component has no id. Texts without shingles
    are components of their own; of repeated rows one stays.
    """
    alone = [F.when(F.col("root").isNull(), F.col(c)).alias(f"own_{c}") for c in ("doc_id", "text_hash")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    picked = _labelled(docs, length).groupBy("root", *alone).agg(first)
    kept = picked.select(F.col("first.doc_id").alias("_kept_doc_id"), F.col("first.text_hash").alias("_kept_text_hash"))
    rows = docs.withColumn("_text_hash", text_hash("text"))
    same = rows["doc_id"].cast("long").eqNullSafe(kept["_kept_doc_id"]) & (rows["_text_hash"] == kept["_kept_text_hash"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
