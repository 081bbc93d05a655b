"""Language identification: nearest centroid by cosine over normalised TF-IDF n-gram vectors.

A text's vector counts its byte bigrams and trigrams (letters lower-cased, everything that is no letter one blank) in
hashed buckets, as log(1 + count) times the bucket's inverse document frequency, scaled to length one. Each language
has several centroids, found by spherical k-means. A text goes to the language of its nearest centroid, and is
rejected if it is less similar than a part of what nearly all labelled texts of the language and of its length reach.

The centroids are fitted on a bounded sample: at most `per_language` labelled texts of each language, the first by a
hash of their id, so that they do not depend on partitions or order. Document frequencies and floors come from all
learnable labelled texts.
Prediction reads every whole text.

Defined results: a null text, an empty one or one without a letter is `und`, score 0, rejected; without any labelled
text every text is `und`; of equally near centroids the first counts, in the order of their languages' names; a very
long text is a slice of its own and is counted whole; rows are answered one by one, so repeated rows, null keys and extra columns do not matter;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import fresh, held_out, kept, mapped, text_slices

BUCKETS = 4096
PER_LANGUAGE = 200
CLUSTERS = 4
#: A text is rejected below this part of the QUANTILE of the similarities of its language's texts of its length: clean
#: texts of another kind than the labelled ones lie far from all centroids too, and must stay. Random text comes nearer
#: the longer it is, so each doubling beyond 2 ** LONG n-grams adds MORE.
MARGIN = 0.25
LONG, MORE = 8, 0.05
QUANTILE = 0.01
#: Lengths are counted in doublings of the number of different n-grams; a length of fewer rows than LEAST has half the
#: floor of the next longer one.
LENGTHS = 14
LEAST = 20
STEPS = 1000
UNKNOWN = "und"

_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Hashed bigram and trigram counts, one row a text. A text's n-grams never reach into its neighbour."""
    raw = [b" %b " % t.lower().encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), size)
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of several blanks the first stays
    keep[np.cumsum(size) - size] = True
    data, row = np.where(letter, data, 32)[keep].astype(np.uint32), row[keep]
    out = np.zeros(len(raw) * buckets, np.int64)
    for n in (2, 3):
        code = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            code = (code << 8) | data[k : len(data) - n + 1 + k]
        own = row[: len(code)] == row[n - 1 :]
        hashed = (code * np.uint32(2654435761) ^ np.uint32(n)) >> np.uint32(32 - (buckets.bit_length() - 1))
        out += np.bincount((row[: len(code)] * buckets + hashed)[own], minlength=len(out))
    return out.reshape(len(raw), buckets)


def unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size > 0, size, 1)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    floors: np.ndarray  # the least similarity that each centroid's language accepts, by length

    def similar(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The similarities with all centroids, and the length of each text."""
        tf = np.log1p(counts(texts, len(self.idf))).astype(np.float32)
        grams = np.maximum((tf > 0).sum(axis=1), 1)
        return unit(tf * self.idf) @ self.centroids.T, np.minimum(np.log2(grams).astype(int), LENGTHS - 1)

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each text, its similarity, and whether that is below the floor."""
        similar, length = self.similar(texts)
        best = similar.argmax(axis=1)
        near = np.clip(similar[np.arange(len(texts)), best], 0, 1)
        return best, near, near < self.floors[best, length]


def k_means(vectors: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from the mean's nearest vector and then the farthest ones, so it has no chance in it."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = [vectors[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))]
        centroids = unit(np.stack(sums))
    return centroids


def learnable_rows(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return docs.filter(docs[lang].isNotNull() & docs[text].isNotNull() & ~held_out(docs[key]))


def sample(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(lang, text) of at most per_language learnable rows of each language. Ids are chosen before texts are read."""
    learnable = learnable_rows(docs, key, text, lang)
    ids = learnable.select(docs[key].alias("key"), docs[lang].alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    rows = learnable.select(docs[key].alias("key"), docs[lang].alias("lang"), docs[text].alias("text"))
    return rows.join(F.broadcast(ids.select("key", "lang")), ["key", "lang"], "left_semi").select("lang", "text")


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    clusters: int = CLUSTERS,
    buckets: int = BUCKETS,
    margin: float = MARGIN,
) -> Model | None:
    """The model, its centroids from the bounded sample in one task; None if nothing is labelled."""
    learnable = learnable_rows(docs, key, text, lang)
    idf = inverse_frequencies(learnable.select(docs[text].alias("text")), buckets)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        parts = []
        for rows in text_slices(batches):
            langs += rows.column("lang").to_pylist()
            parts.append(np.log1p(counts(rows.column("text").to_pylist(), buckets)).astype(np.float32))
        if not parts:
            return
        tf, langs = np.concatenate(parts), np.array(langs)
        order = np.lexsort([*tf[:, :8].T, langs])  # by content: the model is the same however rows come
        tf, langs = tf[order], langs[order]
        vectors = unit(tf * idf)
        for name in np.unique(langs):
            own = vectors[langs == name]
            centroids = k_means(own, clusters)
            for c in centroids:
                yield pa.RecordBatch.from_pylist(
                    [{"lang": str(name), "centroid": c.tobytes()}],
                    pa.schema([("lang", pa.string()), ("centroid", pa.binary())]),
                )

    chosen = sample(docs, key, text, lang, per_language).repartition(1)  # only the sampled rows move
    found = mapped(chosen, train, "lang string, centroid binary").collect()
    if not found:
        return None
    array = lambda raw: np.frombuffer(raw, np.float32)
    langs = [r.lang for r in found]
    model = Model(idf, np.stack([array(r.centroid) for r in found]), langs, np.zeros((len(langs), LENGTHS)))
    model.floors = floors(learnable, model, text, lang, margin)
    return model


def inverse_frequencies(texts: DataFrame, buckets: int) -> np.ndarray:
    """Inverse document frequency of each bucket over all texts: a row a bucket and task is summed, then collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        n = np.zeros(buckets + 1, np.int64)  # the last counts the texts
        for rows in text_slices(batches):
            found = counts(rows.column("text").to_pylist(), buckets)
            n += np.append((found > 0).sum(axis=0), len(found))
        yield pa.RecordBatch.from_arrays([pa.array(range(buckets + 1), pa.int32()), pa.array(n)], ["bucket", "n"])

    n = np.zeros(buckets + 1)
    for r in mapped(texts, run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        n[r.bucket] = r.n
    return np.log((1 + n[-1]) / (1 + n[:-1])).astype(np.float32) + 1


def floors(learnable: DataFrame, model: Model, text: str, lang: str, margin: float) -> np.ndarray:
    """The floors of each centroid's language by length, from how similar all its learnable texts are to it."""
    langs = np.array(model.langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        found: Counter[tuple[str, int, int]] = Counter()
        for rows in text_slices(batches):
            texts, names = rows.column("text").to_pylist(), np.array(rows.column("lang").to_pylist(), object)
            similar, length = model.similar(texts)
            own = np.where(names[:, None] == langs[None, :], similar, 0).max(axis=1)
            step = (np.clip(own, 0, 1) * STEPS).astype(int)
            found.update((n, int(k), int(s)) for n, k, s, t in zip(names, length, step, texts, strict=True) if has_letter(t))
        lists = [[k[i] for k in found] for i in range(3)] + [list(found.values())]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], ["lang", "length", "step", "n"])

    chosen = learnable.select(learnable[lang].alias("lang"), learnable[text].alias("text"))
    found = mapped(chosen, run, "lang string, length int, step int, n bigint")
    table = {name: np.zeros((LENGTHS, STEPS + 1), np.int64) for name in model.langs}
    for r in found.groupBy("lang", "length", "step").agg(F.sum("n").alias("n")).collect():
        table[r.lang][r.length, r.step] = r.n
    part = np.minimum(margin + MORE * np.maximum(np.arange(LENGTHS) - LONG, 0), 1)
    by_lang = {name: _floors_of(n) * part for name, n in table.items()}
    return np.stack([by_lang[name] for name in model.langs])


def _floors_of(n: np.ndarray) -> np.ndarray:
    """The quantile for each length, from the numbers of texts by length and similarity step."""
    rows = n.sum(axis=1)
    known = np.flatnonzero(rows >= min(LEAST, max(1, rows.max())))
    out = np.zeros(LENGTHS)
    for k in known:
        out[k] = np.searchsorted(n[k].cumsum(), QUANTILE * rows[k], "right") / STEPS
    out[known[-1] :] = out[known[-1]]
    for k in range(known[-1] - 1, -1, -1):
        out[k] = min(out[k], out[k + 1]) if k in known else out[k + 1] / 2
    return out


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The input's columns with lang_pred, score and rejected (other names if taken; see `added`)."""
    names = added(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for rows in text_slices(batches, text):
            texts = rows.column(text).to_pylist()
            known = np.array([has_letter(t) for t in texts]) & (model is not None)
            lang, score, rejected = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), ~known
            some = np.flatnonzero(known)
            if len(some):
                best, near, far = model.nearest([texts[k] for k in some])
                lang[some], score[some] = np.array(model.langs, object)[best], near
                rejected[some] = far
            kinds = (pa.string(), pa.float64(), pa.bool_())
            for name, values, kind in zip(names, (lang, score, rejected), kinds, strict=True):
                rows = rows.append_column(name, pa.array(values, kind))
            yield rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, f"{kinds}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def added(docs: DataFrame) -> list[str]:
    """The names of the columns that predict adds."""
    return [fresh(docs, name) for name in ("lang_pred", "score", "rejected")]


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, unchanged, but those whose language is rejected."""
    found = predict(docs, fit(docs, key, text, lang), text)
    return found.filter(~F.col(added(docs)[2])).select(*docs.columns)
