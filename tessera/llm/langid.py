"""Language identification by a byte convolutional network, trained in numpy.

Bytes (A-Z lower-cased) are embedded; filters of several widths slide over them; the largest answer of
each filter in a window of fixed length goes through a rectifier into a softmax over the languages.
A document's answer is the mean over all of its windows, weighted by their bytes.

For inference, embedding and filters fold into tables: the answer of a filter is a sum of table rows
looked up by pairs of bytes, so no matrix product is left but the small softmax layer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, lean, ship_code

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: At most so many labelled rows are gathered for training, each with two windows.
TRAIN_ROWS = 6_000
EPOCHS, MIN_STEPS = 4, 300  # small samples are gone through more often
CHUNK = 32  # windows at a time

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, padded with spaces: bytes [n, WINDOW], the text of each, its bytes of text."""
    parts, owner, size = [], [], []
    for k, t in enumerate(texts):
        n = max(1, -(-len(t) // WINDOW))
        parts.append(t.translate(LOWER).ljust(n * WINDOW))
        owner.append(np.full(n, k))
        sizes = np.full(n, WINDOW)
        sizes[-1] = len(t) - (n - 1) * WINDOW
        size.append(sizes)
    if not parts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), np.zeros(0, int)
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.concatenate(owner), np.concatenate(size)


@dataclass
class ByteNet:
    langs: list[str]
    embedding: np.ndarray  # [256, EMBEDDING]
    filters: list[np.ndarray]  # by width: [width, EMBEDDING, FILTERS]
    bias: np.ndarray  # [len(widths) * FILTERS]
    out: np.ndarray  # [len(widths) * FILTERS, languages]
    out_bias: np.ndarray

    def __post_init__(self):
        self._first = self._rest = None

    def __getstate__(self):
        return self.__dict__ | {"_first": None, "_rest": None}

    def _tables(self) -> None:
        """_first: [65536, all filters], what the first two bytes add; _rest: (place, table) pairs by width."""
        one = [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        self._first = np.concatenate([pair(t[0], t[1]) for t in one], axis=1)
        self._rest = []
        for t in one:
            more, j = [], 2
            while j < len(t):
                if j + 1 < len(t):
                    more.append((j, True, pair(t[j], t[j + 1])))
                    j += 2
                else:
                    more.append((j, False, t[j].astype(np.float32)))
                    j += 1
            self._rest.append(more)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each window."""
        if self._first is None:
            self._tables()
        wide = x.astype(np.int32)
        pairs = wide[:, :-1] * 256 + wide[:, 1:]
        n, f = len(x), self.out.shape[0] // len(self.filters)
        first = self._first[pairs]  # [n, WINDOW - 1, all filters]
        tops = np.empty((n, self.out.shape[0]), np.float32)
        for k, (weights, more) in enumerate(zip(self.filters, self._rest)):
            t = WINDOW - len(weights) + 1
            answer = first[:, :t, k * f : (k + 1) * f]
            for j, double, table in more:
                answer = answer + table[(pairs if double else wide)[:, j : j + t]]
            tops[:, k * f : (k + 1) * f] = answer.max(axis=1)
        return tops

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)))
        for at in range(0, len(x), CHUNK):
            h = np.maximum(self.pooled(x[at : at + CHUNK]) + self.bias, 0)
            z = h.astype(np.float64) @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + CHUNK] = e / e.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        x, owner, size = windows(texts)
        weight = np.maximum(size, 1)[:, None]
        total = np.zeros((len(texts), len(self.langs)))
        np.add.at(total, owner, self.probabilities(x) * weight)
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        return [self.langs[b] for b in best], [round(float(p), 6) for p in total[np.arange(len(texts)), best]]


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 0) -> ByteNet:
    """Fits the network by Adam on one window a text (the first WINDOW bytes of each given text)."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    x, owner, _ = windows([t[:WINDOW] for t in texts])
    y = np.array([langs.index(v) for v in labels])[owner]
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y]
    params = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(len(WIDTHS) * FILTERS), "c": np.zeros(len(langs))}
    for k, w in enumerate(WIDTHS):
        params[f"f{k}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
    params["u"] = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs)))
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(max(epochs, -(-MIN_STEPS * 64 // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            grads = _gradients(params, x[rows], y[rows], weight[rows])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(langs, params["e"], [params[f"f{k}"] for k in range(len(WIDTHS))], params["b"], params["u"], params["c"])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    n, embedded = len(x), p["e"][x]
    tops, places = [], []
    for k, w in enumerate(WIDTHS):
        t = WINDOW - w + 1
        answer = sum(embedded[:, j : j + t] @ p[f"f{k}"][j] for j in range(w))
        where = answer.argmax(axis=1)
        places.append(where)
        tops.append(np.take_along_axis(answer, where[:, None, :], axis=1)[:, 0])
    pooled = np.concatenate(tops, axis=1) + p["b"]
    h = np.maximum(pooled, 0)
    z = h @ p["u"] + p["c"]
    q = np.exp(z - z.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(n), y] -= 1
    q *= weight[:, None] / n
    back = (q @ p["u"].T) * (pooled > 0)
    grads = {"u": h.T @ q, "c": q.sum(axis=0), "b": back.sum(axis=0), "e": np.zeros_like(p["e"])}
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(p[f"f{k}"])
        for j in range(w):
            seen = np.take_along_axis(x, places[k] + j, axis=1)  # [n, FILTERS]
            grad[j] = np.einsum("nfd,nf->df", p["e"][seen], g)
            np.add.at(grads["e"], seen.ravel(), (g[:, :, None] * p[f"f{k}"][j].T[None]).reshape(-1, EMBEDDING))
        grads[f"f{k}"] = grad
    return grads


def held_out(doc_id="doc_id"):
    """Whether the remainder of crc32(doc_id as text) by 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> ByteNet | None:
    """Trains on at most `train_rows` labelled rows outside of the held-out fold, two windows of each.

    Rows are taken in order of a hash of id, label and first window; only their windows come to the driver (1 KB a row).
    None where no row has a label and text.
    """
    raw = F.col("text").cast("string").cast("binary")
    middle = F.greatest(F.lit(1), F.floor(F.octet_length("text") / 2) - WINDOW // 2).cast("int")
    rows = docs.where(~held_out()).where("text IS NOT NULL AND lang IS NOT NULL AND octet_length(text) > 0").select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.substring(raw, 1, WINDOW).alias("a"), raw.substr(middle, F.lit(WINDOW)).alias("b")
    )
    found = bounded_sample(rows, train_rows, "doc_id", "lang", "a").collect()
    texts, labels = [], []
    for r in found:
        for t in {bytes(r.a), bytes(r.b)}:
            texts.append(t)
            labels.append(r.lang)
    pairs = sorted(zip(texts, labels))
    return train([t for t, _ in pairs], [v for _, v in pairs], epochs) if pairs else None


def answers(net: ByteNet | None, texts: list[str | None]):
    """(place, language, score) of each text that has a letter; some MB of text go through the net at a time."""
    chunk, size = [], 0
    for k, t in enumerate([*texts, None]):
        if net and t and has_letter(t):
            chunk.append((k, t.encode()))
            size += len(t)
        if chunk and (size > 2_000_000 or k == len(texts)):
            yield from zip([at for at, _ in chunk], *net.predict([b for _, b in chunk]))
            chunk, size = [], 0


def predict(docs: DataFrame, model: ByteNet | None) -> DataFrame:
    """The language of every whole text: `und` and 0 for null, for a text without a letter, without a model.

    Repeated rows all stay, each with the same answer; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    spread = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for k, lang, score in answers(spread.value, batch.column(1).to_pylist()):
                langs[k], scores[k] = lang, score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), PREDICTED)


def keep(docs: DataFrame, model: ByteNet | None, min_score: float = 0.3) -> DataFrame:
    """The documents, all columns, whose language is told: not `und`, with a score of at least `min_score`.

    So null texts and those without a letter go. Repeated rows all stay or all go; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    spread = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            good = []
            for k, lang, score in answers(spread.value, texts):
                if lang != UNKNOWN and score >= min_score:
                    good.append(k)
            yield batch.take(pa.array(sorted(good), pa.int64()))

    return docs.mapInArrow(lean(run), docs.schema)
