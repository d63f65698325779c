"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference (ALERGIA): the labelled credentials of a kind make a prefix tree with counts; states
whose outgoing and ending frequencies agree within a Hoeffding bound, and whose successors do so too,
merge; the outcome is a probabilistic automaton. Every candidate token is scored by the likelihood of
its format: bits a character by which the best automaton beats a model of ordinary tokens.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, lean, ship_code

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the format score: whole tokens of these characters, of 6 or more, as labelled assignments are.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}(?![A-Za-z0-9+/_=-])")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

#: Training documents have one of these, in either case, or a long run of hex digits; scanning itself looks at all documents.
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia")
LONG_HEX = "[0-9a-f]{24}"
TRAIN_DOCS = 4_000  # rows whose tokens are looked at for training
TRAIN_EACH = 2_000  # credentials or ordinary tokens of a kind, at most
ALPHA = 0.05
THRESHOLD = 1.0  # bits a character
KNOWN = 20_000  # scores a task remembers; words repeat
SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"


def shape(token: str) -> str:
    """A token as symbols: digits, a-f, other letters, upper case; other characters stand for themselves."""
    return token.translate(_SHAPE)


_SHAPE = {c: "d" if chr(c).isdigit() else "h" if chr(c) in "abcdef" else "l" if chr(c).islower() else "U" for c in map(ord, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}


class Automaton:
    """A probabilistic automaton of symbol strings, inferred by merging states of their prefix tree."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA, alphabet: int = 16):
        self.alphabet = alphabet
        self.after: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        for s in strings:
            state = 0
            for c in s:
                self.count[state][c] += 1
                if c not in self.after[state]:
                    self.after[state][c] = len(self.after)
                    self.after.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                state = self.after[state][c]
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.after[a] and c in self.after[b]:
                    stack.append((self.after[a][c], self.after[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
                if c in self.after[a]:
                    stack.append((self.after[a][c], self.after[b][c]))
                else:
                    self.after[a][c] = self.after[b][c]

    def _infer(self) -> None:
        red = [0]
        while True:
            blue = next(((r, c, t) for r in red for c, t in sorted(self.after[r].items()) if t not in red), None)
            if blue is None:
                break
            parent, symbol, state = blue
            for r in red:
                if self._compatible(r, state):
                    self.after[parent][symbol] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
        number = {s: k for k, s in enumerate(red)}
        self.after = [{c: number[t] for c, t in self.after[s].items()} for s in red]
        counts, ends = [self.count[s] for s in red], [self.ends[s] for s in red]
        #: Bits of each symbol and of the end, by state; unseen symbols have half a count.
        self.bits = [{c: -math.log2((n + 0.5) / (sum(k.values()) + e + 0.5 * self.alphabet)) for c, n in k.items()} for k, e in zip(counts, ends)]
        self.end_bits = [-math.log2((e + 0.5) / (sum(k.values()) + e + 0.5 * self.alphabet)) for k, e in zip(counts, ends)]
        self.miss = [-math.log2(0.5 / (sum(k.values()) + e + 0.5 * self.alphabet)) for k, e in zip(counts, ends)]
        del self.count, self.ends

    def cost(self, s: str) -> float:
        """Bits of a whole string; after a symbol that no state expects, each further one costs as much."""
        state, bits = 0, 0.0
        for k, c in enumerate(s):
            if c not in self.bits[state]:
                return bits + self.miss[state] * (len(s) - k)
            bits += self.bits[state][c]
            state = self.after[state][c]
        return bits + self.end_bits[state]


class Scanner:
    """Base spans and format spans of a text."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.automata = {kind: Automaton(map(shape, rows)) for kind, rows in sorted(labelled.items()) if rows}
        self.ordinary = Automaton(map(shape, ordinary)) if ordinary else None
        self.common = set(ordinary)
        self.known: dict[str, float] = {}

    def score(self, token: str) -> float:
        """Bits a character by which the best automaton beats the ordinary tokens' one."""
        if not self.automata or self.ordinary is None:
            return -math.inf
        s = shape(token)
        return (self.ordinary.cost(s) - min(a.cost(s) for a in self.automata.values())) / len(s)

    def spans(self, text: str | None) -> list[tuple[str, int, int, float | None]]:
        if not text:
            return []
        out = base_spans(text)
        covered, k = merged(out), 0
        if self.automata and self.ordinary is not None:
            known = self.known
            for m in CANDIDATE.finditer(text):
                if (score := known.get(m[0])) is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    score = known[m[0]] = self.score(m[0])
                if score < self.threshold:
                    continue
                while k < len(covered) and covered[k][1] <= m.start():
                    k += 1
                if k == len(covered) or m.end() <= covered[k][0]:
                    out.append(("format", m.start(), m.end(), score))
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def merged(spans: Iterable[tuple]) -> list[tuple[int, int]]:
    """The ranges that spans (kind, start, end, ...) cover, apart and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s[1], s[2]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(tokens: Iterable[re.Match], covered: list[tuple[int, int]]) -> Iterable[str]:
    """The tokens, which come in order, that meet no covered range."""
    k = 0
    for m in tokens:
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or m.end() <= covered[k][0]:
            yield m[0]


def base_spans(text: str) -> list[tuple[str, int, int, None]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]


def credentials(text: str) -> list[tuple[str, str]]:
    """Labelled credentials of a text, by the base patterns; an assignment's value without what names it."""
    found = [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", m[0]) for m in HEX.finditer(text)]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_each: int = TRAIN_EACH, threshold: float = THRESHOLD) -> Scanner:
    """Learns from a bounded sample: `train_docs` documents in order of a hash, of those that hold one of the
    HINTS, and `train_each` tokens of a kind.

    Labels come from the base patterns; ordinary tokens are those outside of any base span. Without a
    labelled credential the scanner keeps to the base patterns.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hinted = reduce(or_, [F.lower("text").contains(h) for h in HINTS]) | F.col("text").rlike(LONG_HEX)
    chosen = bounded_sample(rows.where(hinted & F.col("doc_id").isNotNull()).select("doc_id").distinct(), train_docs, "doc_id")

    def tokens(batches):
        for batch in batches:
            out = []
            for text in filter(None, batch.column(0).to_pylist()):
                out += credentials(text)
                out += {("", t) for t in outside(ORDINARY.finditer(text), merged(base_spans(text)))}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], names=["kind", "token"])

    found = rows.join(chosen, "doc_id", "left_semi").select("text").mapInArrow(lean(tokens), "kind string, token string")
    counted = found.distinct()
    rank = F.row_number().over(_window())
    gathered = counted.withColumn("k", rank).where(F.col("k") <= train_each).orderBy("kind", "k").collect()
    labelled, ordinary = defaultdict(list), []
    for r in gathered:
        (labelled[r.kind] if r.kind else ordinary).append(r.token)
    return Scanner(labelled, ordinary, threshold)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("kind").orderBy(F.xxhash64("token"), "token")


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """All spans of every whole text, in code points, by start, then kind as listed.

    Null and empty texts have none; repeated rows all stay; an empty table gives no rows; of the other columns
    only doc_id is carried.
    """
    spark = docs.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(scanner)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        find = model.value.spans
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SPANS)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `scan`."""
    base = F.filter("spans", lambda s: s["kind"] != "format")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scanner: Scanner, mark: str = "[SECRET]") -> DataFrame:
    """Texts with every span replaced by `mark`; all rows and columns stay, n_chars of changed texts is counted anew.

    Null texts stay null; repeated rows all stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(scanner)
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        find = model.value.spans
        for batch in batches:
            texts, changed = batch.column(text_at).to_pylist(), {}
            for k, text in enumerate(texts):
                out, at = [], 0
                for _, a, b, _ in find(text):
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                if out:
                    changed[k] = "".join([*out, text[at:]])
            columns = list(batch.columns)
            if changed:
                columns[text_at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], columns[text_at].type)
                if chars_at is not None:
                    columns[chars_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(columns[chars_at].to_pylist())], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
