"""Document quality by attention-based multiple-instance learning.

Every passage of a text (64 words) is encoded from its surface: shares of character kinds, word lengths, repetition,
hashed letter pairs. A gated attention network, taught by document labels alone, weighs the passages; the weighted
sum of their codes gives the document's score.

The model is fitted on a bounded sample: at most `most` labelled documents, the first by a hash of their id. Scoring
reads every passage of every text.

Defined results: a null or empty text has one passage without words and gets a score like any other; a document with
several labels counts with their mean; null labels teach nothing; without labels every score is 0.5; rows are answered
one by one, so repeated rows, null keys and extra columns do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import held_out, kept, mapped, text_slices

PASSAGE_WORDS = 64
MOST = 2000
PAIRS = 32
THRESHOLD = 0.3

_KINDS = ["upper", "lower", "digit", "blank", "line", "stop", "mark", "other"]
_KIND = np.array(
    [
        0 if 65 <= b < 91 else 1 if 97 <= b < 123 else 2 if 48 <= b < 58 else 4 if b == 10 else 3 if b in b" \t\r\v\f"
        else 5 if b in b".,;:?'-" else 7 if b >= 128 else 6
        for b in range(256)
    ]
)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
FEATURES = len(_KINDS) + 5 + PAIRS


def passages(texts: list[str], words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order, and the row of the text that each belongs to (each text has one at least)."""
    raw = [t.encode() + b"\n" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum(size) - size
    kind = _KIND[data]
    space = (kind == 3) | (kind == 4)
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[first] = True
    word_at = np.flatnonzero(before & ~space)
    word_row = np.searchsorted(first, word_at, "right") - 1
    rank = np.arange(len(word_at)) - np.searchsorted(word_row, word_row)
    begins = np.unique(np.concatenate([first, word_at[(rank % words == 0) & (rank > 0)]]))
    row = np.searchsorted(first, begins, "right") - 1
    n = np.diff(np.append(begins, len(data)))
    of_byte = np.repeat(np.arange(len(begins)), n)
    shares = np.bincount(of_byte * 8 + kind, minlength=len(begins) * 8).reshape(-1, 8) / n[:, None]
    code = (kind[:-1] == 1) & (kind[1:] == 1)
    pair = ((data[:-1].astype(np.uint32) * 31 + data[1:]) * np.uint32(2654435761) >> np.uint32(16)) % PAIRS
    pairs = np.bincount((of_byte[:-1] * PAIRS + pair)[code], minlength=len(begins) * PAIRS).reshape(-1, PAIRS)
    pairs = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    of_word = of_byte[word_at]
    n_words = np.bincount(of_word, minlength=len(begins))
    # a word's code: a sum over its bytes, each times an odd power, so that equal words have equal codes
    if len(word_at):
        at = np.arange(len(data))
        place = at - np.maximum.accumulate(np.where(before & ~space, at, 0))
        codes = np.add.reduceat(np.where(space, 0, data).astype(np.uint64) * _POWERS[place % 64], word_at)
        keys = codes * np.uint64(0x100000001B3) + of_word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, at = np.unique(keys, return_index=True)
        distinct = np.bincount(of_word[at], minlength=len(begins))
        again = np.bincount(of_word[1:], weights=codes[1:] == codes[:-1], minlength=len(begins))
    else:
        distinct = again = np.zeros(len(begins))
    some = np.maximum(n_words, 1)
    rest = np.stack([np.log1p(n_words), distinct / some, again / some, np.log1p(n / some), (n_words == 0) * 1.0], axis=1)
    return np.concatenate([shares, rest, pairs], axis=1).astype(np.float32), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """h = tanh(xW + b); attention softmax over a text's passages of (tanh(hV) * sigmoid(hU)) w; score of the sum."""

    SHAPES = {"W": (FEATURES, 24), "b": (24,), "V": (24, 12), "U": (24, 12), "w": (12,), "c": (24,), "d": (1,)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        start = {k: rng.normal(0, 0.3 if len(s) > 1 else 0.1, s).astype(np.float32) for k, s in cls.SHAPES.items()}
        return cls(start | {"mean": np.float32(0), "spread": np.float32(1)})

    def forward(self, x: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
        """row: ascending, every text has a passage."""
        p = self.p
        at = np.flatnonzero(np.diff(row, prepend=-1))
        x = (x - p["mean"]) / p["spread"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, at)[row])
        a /= np.add.reduceat(a, at)[row]
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"]), "at": at}

    def gradient(self, x: np.ndarray, row: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, row)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        dy = (f["y"] - label) / len(label)
        dz = (dy[:, None] * p["c"])[row]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["at"])[row])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
            "w": (t * g).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
        }

    def train(self, x: np.ndarray, row: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 200) -> None:
        """Adam over batches of texts, dealt out once, with a little weight decay."""
        self.p |= {"mean": x.mean(axis=0), "spread": x.std(axis=0) + np.float32(0.02)}
        m = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        v = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        deal = np.random.default_rng(3).permutation(len(label)) // batch
        parts = []
        for k in range(deal.max() + 1):
            own = deal[row] == k
            parts.append((x[own], np.unique(row[own], return_inverse=True)[1], label[deal == k].astype(np.float32)))
        for i in range(1, epochs * len(parts) + 1):
            rate = np.float32(0.01)
            for k, grad in self.gradient(*parts[i % len(parts)]).items():
                grad = grad + np.float32(1e-4) * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST) -> Network | None:
    """The network, from the bounded sample in one task; None if nothing is labelled."""
    taught = labels.filter(labels[label].isNotNull() & ~held_out(labels[key]))
    taught = taught.select(labels[key].alias("key"), labels[label].cast("double").alias("label"))
    taught = taught.groupBy("key").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most)
    rows = docs.filter(~held_out(docs[key])).select(docs[key].alias("key"), docs[text].alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, label, xs, ns = [], [], [], []
        for part in text_slices(batches):
            x, row = passages(part.column("text").to_pylist())
            xs += np.split(x, np.flatnonzero(np.diff(row)) + 1)
            label += part.column("label").to_pylist()
            keys += part.column("key").to_pylist()
        if not xs:
            return
        order = sorted(range(len(xs)), key=lambda k: (keys[k], xs[k].tobytes()))  # the same model however rows come
        xs = [xs[k] for k in order]
        ns = [len(x) for x in xs]
        net = Network.new()
        net.train(np.concatenate(xs), np.repeat(np.arange(len(xs)), ns), np.array(label)[order])
        names = list(net.p)
        weights = [np.asarray(net.p[k], np.float32).tobytes() for k in names]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(weights, pa.binary())], ["name", "weights"])

    found = mapped(rows.join(F.broadcast(taught), "key").repartition(1), train, "name string, weights binary").collect()
    if not found:
        return None
    shapes = Network.SHAPES
    read = {r.name: np.frombuffer(r.weights, np.float32).reshape(shapes.get(r.name, (FEATURES,))) for r in found}
    return Network(read)


def score(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, weights): the score of each whole text, and the attention of its passages in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for part in text_slices(batches):
            x, row = passages(part.column("text").to_pylist())
            found = network.forward(x, row) if network else {"y": np.full(part.num_rows, 0.5), "a": np.ones(len(x))}
            ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
            weights = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found["a"], pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found["y"], pa.float64()), weights], ["key", "score", "weights"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return mapped(chosen, run, f"key {kind}, score double, weights array<float>").withColumnRenamed("key", key)
