"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum of their byte n-grams (1 to 3), each counted as present or not, hashed
to `DIM` places and normalised. Every language that a label names is learned, from a bounded sample of its rows
(`per_language` on average, by a hash of their ids; whole texts, of which only the DIM flags leave the tasks). The sample
gives Nystroem landmarks, `landmarks` of each language, and the training rows of a one-versus-rest kernel ridge
regression; the model is a landmark matrix and a weight matrix, whose sizes grow with the number of languages only, and
a batch of texts is scored by two matrix products.

Defined cases: null texts and texts without a letter get `und` and score 0; rows without a label are not learned from;
with no labelled row every text is `und`; repeated rows give repeated results (scores up to the rounding
of a batched product), and count once in training; of languages
that score the same the first by name is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .perplexity import buffers

DIM = 1 << 14
LETTER = regex.compile(r"\p{L}")
BLOCK = 1 << 20


def presence(text: bytes) -> np.ndarray:
    """Which hashed n-grams of 1 to 3 bytes the text holds: DIM flags."""
    flags = np.zeros(DIM, dtype=bool)
    whole = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(whole), BLOCK):
        one = whole[at : at + BLOCK + 2].astype(np.uint32)
        two = one[:-1] << 8 | one[1:]
        for n, packed in enumerate((one, two, two[:-1] << 8 | one[2:])):
            flags[((packed + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(18)] = True
    return flags


def features(texts: list[bytes]) -> np.ndarray:
    """A row per text: presence, scaled to length one."""
    return scaled(np.array([presence(t) for t in texts], dtype=bool).reshape(-1, DIM))


def scaled(flags: np.ndarray) -> np.ndarray:
    return flags.astype(np.float32) / np.sqrt(np.maximum(flags.sum(axis=1, keepdims=True), 1), dtype=np.float32)


class KernelRidge:
    """Nystroem features of the landmarks, then ridge regression of +1 / -1 for each language against the rest."""

    def __init__(self, flags: np.ndarray, langs: list[str], landmarks: int = 48, ridge: float = 1e-2):
        """flags: a row of packed presence flags for each labelled text."""
        self.langs = sorted(set(langs))
        named = np.array(langs)
        order = np.random.default_rng(5).permutation(len(langs))
        own = np.concatenate([order[named[order] == lang][:landmarks] for lang in self.langs])
        self.landmarks = flags[own]
        kernel = np.concatenate([self.kernel(scaled(unpacked(flags[i : i + 512]))) for i in range(0, len(flags), 512)])
        values, vectors = np.linalg.eigh(kernel[own].astype(np.float64))
        keep = values > values[-1] * 1e-6
        map_ = vectors[:, keep] / np.sqrt(values[keep])
        x = np.hstack([kernel @ map_, np.ones((len(kernel), 1))])
        y = np.where(named[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        _, place, count = np.unique(named, return_inverse=True, return_counts=True)
        weight = len(langs) / (len(self.langs) * count[place])
        solved = np.linalg.solve((x * weight[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1]) / len(self.langs), (x * weight[:, None]).T @ y)
        self.weights, self.bias = (map_ @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Of rows of features with the landmarks, which are unpacked once in each process."""
        if not hasattr(self, "_ready"):
            self._ready = np.ascontiguousarray(scaled(unpacked(self.landmarks)).T)
        return rows @ self._ready

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_ready"}

    def decision(self, texts: list[bytes]) -> np.ndarray:
        """A column per language."""
        return self.kernel(features(texts)) @ self.weights + self.bias

    def predict(self, texts: list[bytes], sharpness: float = 4.0) -> tuple[list[str], np.ndarray]:
        raw = self.decision(texts)
        odds = np.exp(sharpness * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        return [self.langs[i] for i in best], odds[np.arange(len(best)), best] / odds.sum(axis=1)


def unpacked(flags: np.ndarray) -> np.ndarray:
    return np.unpackbits(flags, axis=1).astype(bool)


def labelled_sample(docs: DataFrame, allowed: Column, id_column: str, text_column: str, lang_column: str, per_language: int) -> tuple[np.ndarray, list[str]]:
    """Packed presence flags and languages of about per_language documents of each language.

    A language's rows are counted, then a document is taken whose hash falls below per_language / rows. So no language's
    rows meet in a task, ids are chosen before texts are read, and flags (DIM / 8 bytes a document) reach the driver.
    """
    rows = docs.where(allowed & docs[lang_column].isNotNull() & docs[text_column].isNotNull()).select(docs[lang_column].alias("lang"), docs[id_column].alias("id"), docs[text_column].cast("binary").alias("text"))
    dealt = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) / (1 << 40)
    named = rows.select("lang", "id").distinct()
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).collect()  # a row per language
    if not counts:
        return np.zeros((0, DIM // 8), np.uint8), []
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], per_language / r["documents"]) for r in counts], "lang string, share double"))
    # a small language gives what it has; one document each is certain
    first = named.groupBy("lang").agg(F.min_by("id", dealt).alias("first"))
    chosen = named.join(shares, "lang").where(dealt < F.col("share")).select("lang", "id").unionByName(first.select("lang", F.col("first").alias("id"))).distinct()
    chosen = F.broadcast(written(chosen, "chosen"))  # about per_language ids for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [np.packbits(presence(t)).tobytes() for t in buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.binary())], ["lang", "flags"])

    texts = rows.join(chosen, (rows["lang"] == chosen["lang"]) & rows["id"].eqNullSafe(chosen["id"]), "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text"))
    got = texts.select("lang", "text").repartition(partitions(docs.sparkSession)).mapInArrow(run, "lang string, flags binary").toArrow()
    return np.frombuffer(b"".join(got["flags"].to_pylist()), np.uint8).reshape(-1, DIM // 8), got["lang"].to_pylist()


def identify(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = 300) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Rows for which held_out is true are not learned from."""
    flags, langs = labelled_sample(docs, ~held_out, id_column, text_column, lang_column, per_language)
    model = docs.sparkSession.sparkContext.broadcast(KernelRidge(flags, langs) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = buffers(part.column(2))
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if model.value is not None and LETTER.search(t.decode("utf-8", "replace"))]
                if known:
                    found, odds = model.value.predict([texts[i] for i in known])
                    for i, lang, odd in zip(known, found, odds, strict=True):
                        langs[i], scores[i] = lang, float(odd)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), docs[text_column].cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
