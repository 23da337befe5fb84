"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by follow-the-regularised-leader.

A text's features are its runs of one to three characters, lower-cased, hashed into FEATURES numbers. A feature's value is
(1 + log count) times its inverse document frequency, and a text's values have length 1. Document frequencies are counted over all
texts that may be learned from, whole; each task counts in one array.

Weights are learned on at most SAMPLE of these texts, as many of each language as of any other where there are enough, the first by
hash of identifier and text of those whose hash is low enough, and at most CELLS feature values of them: documented bounds. Training (FTRL-proximal) keeps for each weight
the sum of its gradients and of their squares, and makes from them the weight that an absolute and a square penalty leave; most are exactly zero. A fifth of the
sample is not trained on; the temperature that makes its probabilities most likely divides the logits of every prediction.
The sample's order does not depend on partitions, so neither do weights and scores.

Defined results. A text that is null or has no letter (of any script) is ``und`` with a score of 0. Where no text can be learned from all are ``und``;
with one language all others are that one, with a score of 1. Rows without an identifier are not held out; rows that repeat one are
predicted, and learned from, each. An empty text of a known language is not learned from, nor is any without a letter. An empty table gives no rows. Other columns pass
through; held_out, lang_pred and score replace input columns of the same name.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, strings, unlike

FEATURES = 1 << 16
#: Characters of a run at most.
RUN = 3
#: Texts that weights are learned on, and their feature values, at most.
SAMPLE, CELLS = 4_000, 4_000_000
EPOCHS = 3
#: Of the learner: step size, its smoothing, absolute and square penalty.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.1, 0.001
#: The least temperature.
COLDEST = 0.25
#: The label of a text without a letter.
UNKNOWN = "und"
#: Characters that are worked on at once.
PIECE = 1 << 20
_MIX = np.uint32(0x9E3779B1)


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces, so that beginnings and ends of words look alike everywhere."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def numbers(points: np.ndarray) -> list[np.ndarray]:
    """The feature of each run of 1 to RUN characters."""
    out, h = [], np.zeros(len(points), np.uint32)
    for k in range(RUN):
        h = (h[: len(points) - k] ^ (points[k:] + np.uint32(k + 1))) * _MIX
        h ^= h >> np.uint32(15)
        out.append((h * _MIX) >> np.uint32(16))
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features, ascending, and how often it has each. Long texts are counted in pieces that overlap by a run."""
    points = characters(text)
    if len(points) <= FEATURES // 4:
        return np.unique(np.concatenate(numbers(points)), return_counts=True)
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(points), PIECE):
        for k, h in enumerate(numbers(points[at : at + PIECE + RUN - 1])):
            total += np.bincount(h[: min(PIECE, len(points) - k - at)], minlength=FEATURES)
    found = np.flatnonzero(total)
    return found.astype(np.uint32), total[found]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def values(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(counts)) * idf[features]
    return v / np.sqrt(v @ v)


class Model(NamedTuple):
    """Languages, inverse document frequencies, and weights and bias, a column for each language; logits are divided by ``temperature``."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, features: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[features] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its probability."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        features, counts = counted(text)
        p = softmax(self.logits(features, values(features, counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weight_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weight that the penalties leave of the sums of gradients and of their squares."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader over ``rows`` (features, values); the bias is the feature of every row, unpenalised by L1."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))
    bias, bias_z, bias_n = np.zeros(classes), np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            features, v = rows[r]
            w = weight_of(z[features], n[features])
            wrong = softmax(v @ w + bias)
            wrong[labels[r]] -= 1.0
            g = v[:, None] * wrong
            more = n[features] + g * g
            z[features] += g - (np.sqrt(more) - np.sqrt(n[features])) / ALPHA * w
            n[features] = more
            more = bias_n + wrong * wrong
            bias_z += wrong - (np.sqrt(more) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n = more
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
    return weight_of(z, n), bias


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least mean negative log-likelihood, by golden section over its logarithm; rows that are all told apart would have it 0, so it ends at COLDEST."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.mean(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300))))

    a, b, ratio = np.log(COLDEST), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def frequencies(texts: DataFrame) -> DataFrame:
    """(feature, n) of ``texts`` (text): how many texts have each feature, and under -1 how many there are; a row a feature a task before they meet."""

    def count(batches):
        having, seen = np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches):
            for text in strings(batch.column(0)):
                if has_letter(text):
                    having[counted(text)[0]] += 1
                    seen += 1
        found = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(having[found], seen))], ["feature", "n"])

    return texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def sample(learned: DataFrame, most: int = SAMPLE, cells: int = CELLS) -> tuple[list[str], list[tuple]]:
    """Languages, and (language, features, counts) of at most ``most`` texts of ``learned`` (doc_id, text, lang)."""
    sizes = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one for each language
    languages = sorted(sizes)
    if not languages:
        return [], []
    key = F.xxhash64("doc_id", "lang", "text")
    each = max(1, most // len(languages))
    # A hash below this share leaves about twice as many of a language as are taken, or all where there are few: no window holds more.
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit((2 * each + 50) / sizes[lang]))))
    near = learned.select("doc_id", "lang", key.alias("key")).where(F.pmod("key", F.lit(1 << 30)) < F.lit(1 << 30) * share[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    first = near.withColumn("place", place).where(F.col("place") <= each)
    chosen = stored(first.select("key", "place").orderBy("place", "key").limit(most).dropDuplicates(["key"]))  # at most SAMPLE rows, so they are broadcast
    texts = learned.withColumn("key", key).join(F.broadcast(chosen), "key")

    def count(batches):
        for batch in slices(batches):
            told = [counted(t) for t in strings(batch.column(3))]
            arrays = [pa.array([x.tolist() for x in part], kind) for part, kind in zip(zip(*told), (pa.list_(pa.int32()), pa.list_(pa.int32())))] if told else [pa.array([], pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], ["place", "key", "lang", "features", "counts"])

    schema = "place int, key long, lang string, features array<int>, counts array<int>"
    rows = stored(texts.select("place", "key", "lang", "text").mapInArrow(count, schema))
    order = Window.orderBy("place", "key", "lang").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("cells", F.sum(F.size("features")).over(order)).where(F.col("cells") <= cells).orderBy("place", "key", "lang").limit(most)
    told = held.select("lang", "features", "counts").toArrow().combine_chunks()
    if not told.num_rows:
        return languages, []
    features, counts = (told.column(c).chunk(0) for c in ("features", "counts"))
    cut = features.offsets.to_numpy()[1:-1]
    return languages, list(zip(told.column("lang").to_pylist(), np.split(features.values.to_numpy().astype(np.uint32), cut), np.split(counts.values.to_numpy(), cut)))


def fit(docs: DataFrame, most: int = SAMPLE, cells: int = CELLS) -> Model:
    """A model from text and lang of the rows of ``docs`` that are not held out."""
    letters = F.col("text").rlike(r"\p{L}")
    learned = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & letters).select(F.col("doc_id").cast("string"), "text", F.col("lang").cast("string"))
    languages, rows = sample(learned, most, cells)
    having = {r.feature: r.n for r in frequencies(learned.select("text")).collect()} if languages else {}  # at most FEATURES rows
    counts = np.array([having.get(k, 0) for k in range(FEATURES)], np.float64)
    idf = np.log((1.0 + having.get(-1, 0)) / (1.0 + counts)) + 1.0
    known = {x: k for k, x in enumerate(languages)}
    x, y = [(f, values(f, c, idf)) for _, f, c in rows], np.array([known[lang] for lang, _, _ in rows], np.int64)
    test = np.arange(len(x)) % 5 == 4
    weights, bias = follow([r for r, t in zip(x, test) if not t], y[~test], max(1, len(languages)))
    model = Model(languages, idf, weights, bias, 1.0)
    kept = [r for r, t in zip(x, test) if t]
    return model._replace(temperature=calibrated(np.array([model.logits(*r) for r in kept]).reshape(len(kept), weights.shape[1]), y[test]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    at, names = docs.columns.index("text"), docs.columns
    kept = [k for k, c in enumerate(names) if c not in ("lang_pred", "score")]
    used = np.flatnonzero(model.weights.any(axis=1))
    packed = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf.astype(np.float32), used.astype(np.int32), model.weights[used], model.bias, model.temperature))

    def told(batches):
        m = _unpacked(packed)
        for batch in slices(batches):
            found = [m.predict(t) for t in strings(batch.column(at))]
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], [*(names[k] for k in kept), "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(told, ", ".join([*(f"`{names[k]}` {kinds[names[k]]}" for k in kept), "lang_pred string", "score double"]))


@lru_cache(maxsize=1)
def _unpacked(packed) -> Model:
    languages, idf, used, some, bias, temperature = packed.value
    weights = np.zeros((FEATURES, some.shape[1]))
    weights[used] = some
    return Model(languages, idf.astype(np.float64), weights, bias, temperature)


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, by a model learned from its own rows that are not held out."""
    out = predict(docs, fit(docs))
    place = unlike(out, "held")
    return out.withColumn(place, held_out(F.col("doc_id"))).drop("held_out").withColumnRenamed(place, "held_out")
