"""Toxicity by non-negative positive-unlabelled learning.

A numpy linear classifier is trained from confirmed toxic texts and unlabelled texts with the non-negative risk
estimator: pi * R_p+ + max(0, R_u- - pi * R_p-), where pi is the class prior. Both sets are bounded samples (`most_positive`
and `most_unlabelled` rows, by a hash of their ids). A text is judged by its worst window of 2 * HALF words (windows
overlap by half), so toxic words count as much in a long text as in a short one. A window's features are how densely its
words, and the beginnings of its words of 4 to 8 bytes, occur in it; Spark counts in how many sampled texts of either set
each occurs, and the `vocabulary` features that set the samples apart most are used. Training pools in the same way: it
takes each sampled text's worst window under the weights at hand (at first the log odds of the features), fits, and does
so once more. Where the clipped term is negative, the gradient goes up on it instead, as the estimator's authors say.

Defined cases: null and empty texts have no feature and get a score; rows without a label count as unlabelled; with no
confirmed toxic row every score is 0; repeated rows give repeated results, and count once in training; windows of equal
worth are equally good; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, text_of, written
from .perplexity import buffers

#: A-Z to lower case and every other ASCII character that is no letter to a blank.
PLAIN = bytes((ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b) in LOWER or b > 127 else 32) for b in range(256))
BEGINNINGS = range(4, 9)
#: Words in half a window.
HALF = 100
#: Distinct words that a Python worker remembers.
REMEMBERED = 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def features_of(word: bytes) -> list[int]:
    """Hashes of the whole word and of its beginnings."""
    return [xxhash.xxh64_intdigest(word + b"$") >> 1, *(xxhash.xxh64_intdigest(word[:n]) >> 1 for n in BEGINNINGS if n <= len(word))]


class Rows:
    """Sparse rows: for each entry its row, column and value."""

    def __init__(self, n: int, columns: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.n, self.columns, self.row, self.column, self.value = n, columns, row, column, value

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.n)

    def sums(self, s: np.ndarray) -> np.ndarray:
        """The rows weighted by s, added up."""
        return np.bincount(self.column, weights=self.value * s[self.row], minlength=self.columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_gradient(weights: np.ndarray, bias: float, xp: Rows, xu: Rows, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The positive part and the unclipped negative part of the risk with the logistic loss; the gradient to go down by (weights, bias)."""
    sp, su = sigmoid(xp.times(weights) + bias), sigmoid(xu.times(weights) + bias)
    loss = lambda p: float(np.mean(-np.log(np.maximum(p, 1e-12))))
    positive, negative = prior * loss(sp), loss(1 - su) - prior * loss(1 - sp)
    up = prior * xp.sums(sp - 1) / xp.n, prior * float(np.mean(sp - 1))
    down = xu.sums(su) / xu.n - prior * xp.sums(sp) / xp.n, float(np.mean(su)) - prior * float(np.mean(sp))
    grad = (up[0] + down[0], up[1] + down[1]) if negative >= 0 else (-down[0], -down[1])
    return positive, negative, *grad


class PuClassifier:
    """A linear function of feature densities in a window, trained on the non-negative risk with the logistic loss."""

    def __init__(self, features: list[int], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = {f: i for i, f in enumerate(features)}, weights, bias
        self.known: dict[bytes, tuple[int, ...]] = {}

    def hits(self, word: bytes) -> tuple[int, ...]:
        """The used features of a word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = tuple(self.features[f] for f in features_of(word) if f in self.features)
            if len(word) < 100:
                self.known[word] = found
        return found

    def worst(self, text: bytes) -> tuple[np.ndarray, np.ndarray, float]:
        """The worst window of a text: its used features, their densities, and the linear function's value."""
        words = words_of(text)
        n, known = len(words), self.known
        found = [(i, h) for i, w in enumerate(words) if (h := known[w] if w in known else self.hits(w))]
        none = np.zeros(0, dtype=np.int64), np.zeros(0), self.bias
        if not found:
            return none
        half = np.repeat([i // HALF for i, _ in found], [len(h) for _, h in found])
        feature = np.array([f for _, h in found for f in h])
        last = max((n - 1) // HALF - 1, 0)  # a half lies in the window that it begins, and in the one before
        begins, ends = half <= last, half > 0
        size = len(self.features)
        key, count = np.unique(np.concatenate([half[begins] * size + feature[begins], (half[ends] - 1) * size + feature[ends]]), return_counts=True)
        window, feature = key // size, key % size
        x = np.log1p(100 * count / (np.minimum(n, (window + 2) * HALF) - window * HALF + 20))
        at, inverse = np.unique(window, return_inverse=True)
        z = np.bincount(inverse, weights=self.weights[feature] * x) + self.bias
        best = int(z.argmax())
        if len(at) <= last and z[best] < self.bias:  # a window without features is worse
            return none
        mine = inverse == best
        return feature[mine], x[mine], float(z[best])

    def score(self, text: bytes) -> float:
        return float(sigmoid(self.worst(text)[2]))

    def fit(self, xp: Rows, xu: Rows, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 3e-4) -> None:
        """Adam on the risk of positive rows xp and unlabelled rows xu."""
        w = np.append(np.zeros(xp.columns), np.log(prior / (1 - prior)))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            *_, down, bias = risk_gradient(w[:-1], w[-1], xp, xu, prior)
            grad = np.append(down + decay * w[:-1], bias)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = w[:-1], float(w[-1])


def _vocabulary(sample: DataFrame, n_positive: int, n_unlabelled: int, size: int, least_docs: int, least_strength: float) -> list[tuple[int, float]]:
    """The features that set positive and unlabelled texts apart most, with their log odds; sample has toxic, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({f for w in set(words_of(t)) for f in features_of(w)}) for t in buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["toxic", "features"])

    counts = sample.select("toxic", "text").mapInArrow(run, "toxic boolean, features array<long>").select("toxic", F.explode("features").alias("feature"))
    counts = counts.groupBy("feature").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).where(F.col("p") >= least_docs)
    p, u = (F.col("p") + 0.5) / (n_positive + 1), (F.col("u") + 0.5) / (n_unlabelled + 1)
    strength = (p - u) / F.sqrt(F.abs(p * (1 - p)) / n_positive + F.abs(u * (1 - u)) / n_unlabelled)
    best = counts.select("feature", strength.alias("s"), F.log(p / u).alias("odds")).where(F.col("s") >= least_strength).orderBy(F.desc("s"), "feature").limit(size)
    return [(r["feature"], r["odds"]) for r in best.collect()]


def _worst_windows(sample: DataFrame, model: PuClassifier, sizes: dict[bool, int]) -> dict[bool, Rows]:
    """The worst windows of the positive (True) and of the unlabelled texts under a model."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.worst(t) for t in buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["toxic", "at", "x"])

    got = sample.mapInArrow(run, "toxic boolean, at array<int>, x array<double>").toArrow()  # at most most_positive + most_unlabelled windows
    out = {}
    for kind in (True, False):
        rows = got.filter(pa.compute.equal(got["toxic"], kind))
        lengths = pa.compute.list_value_length(rows["at"]).to_numpy()
        out[kind] = Rows(sizes[kind], len(model.features), np.repeat(np.arange(len(lengths)), lengths), pa.compute.list_flatten(rows["at"]).to_numpy(), pa.compute.list_flatten(rows["x"]).to_numpy())
    return out


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", prior: float | None = None, most_positive: int = 3000, most_unlabelled: int = 6000, vocabulary: int = 3072, threshold: float = 0.3, least_strength: float = 3.0, rounds: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Rows for which held_out is true are not learned from.

    prior: the share of toxic texts; by default their share among the labelled rows that may be learned from.
    """
    spark = docs.sparkSession
    known = labels.where(labels[label_column].isNotNull()).groupBy(labels[id_column].alias("label_id")).agg(F.max(label_column).alias("label"))
    rows = docs.where(~held_out).select(docs[id_column].alias("id"), docs[text_column].cast("binary").alias("text"), F.xxhash64(docs[id_column]).alias("dealt"))
    picks = written(rows.select("id", "dealt").distinct().join(known, F.col("id") == F.col("label_id"), "left").drop("label_id"), "picks")
    counted = picks.where("label is not null").agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    take = lambda of, n: [r[0] for r in of.orderBy("dealt", "id").limit(n).select("id").collect()]
    positive, unlabelled = take(picks.where("label = 1"), most_positive), take(picks.where("id is not null"), most_unlabelled)
    model = PuClassifier([], np.zeros(0), -40.0)
    if positive:
        chosen = spark.createDataFrame([(i, True) for i in positive] + [(i, False) for i in unlabelled], "id long, toxic boolean")
        # at most most_positive + most_unlabelled ids; rows that share one count once
        sample = written(rows.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text").repartition(partitions(spark)), "sample")
        sizes = {True: len(positive), False: len(unlabelled)}
        chosen_features = _vocabulary(sample, sizes[True], sizes[False], vocabulary, 4, least_strength)
        model = PuClassifier([f for f, _ in chosen_features], np.array([odds for _, odds in chosen_features]), 0.0)
        share = prior if prior is not None else counted[1] / counted[0]
        for _ in range(rounds):
            windows = _worst_windows(sample, model, sizes)
            model.fit(windows[True], windows[False], min(max(share, 1e-3), 0.9))
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shared.value.score(t) for t in buffers(batch.column(2))], pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(docs, text_column).cast("binary").alias("text")).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
