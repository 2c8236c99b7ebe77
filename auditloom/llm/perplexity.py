"""Quality rules: base rules and perplexity bands from a modified Kneser-Ney model of byte n-grams.

Spark counts the n-grams of all documents (tasks combine their own counts first) and derives continuation counts,
discounts, probabilities and backoff weights by aggregations and joins. Keys are the n-grams themselves, so none is taken
for another. Every 4-gram of a document is in the highest order's table, so its perplexity per byte is a sum of lookups
there: tasks get the frequent n-grams as a sorted array of bounded size, found by a hash of the key; the others meet the
whole table in a join. Each language gets its own band in log perplexity at every size, [q1 - width * iqr,
q3 + width * iqr] over all its documents that pass the base rules, about its own median; the fewer these documents are,
the more the spread of all languages about their medians counts.

With labels there is a second measure, which gathers as much as the corpus has words: the mean over a document's words
of -log(n / all words). Every distinct word is counted under its 64-bit hash, and looked up in the same way. Decoration
that a few documents put on words makes them rare, layout tokens make them frequent, though the model has seen that junk,
too. The lower and upper widths of this band, by language as above, are those with the fewest errors on labelled rows.

Defined cases: null text is empty and fails the base rules, its perplexity is 1; null lang is a language of its own;
repeated rows count as often as they occur; a value on a band's border is inside; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, written

ORDER = 4
#: Slots of the hash by which a sorted array is entered: 2**SLOT_BITS.
SLOT_BITS, MULTIPLIER = 22, 0x9E3779B97F4A7C15
#: Most keys that are sent to the tasks as a sorted array; most n-grams of one order in a model that is held whole.
MOST_SENT, MOST_HELD = 1 << 20, 1 << 24
SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes handled at once.
BLOCK = 1 << 20
#: Bytes whose words are hashed at once; counts of words that wait to be merged, and distinct words that a task holds before it passes counts on.
WORD_BLOCK, WORDS_WAITING, WORDS_HELD = 1 << 20, 1 << 19, 1 << 20
WORD_BASE = 0x9E3779B97F4A7C15
#: Steps of an interquartile range in which widths are sought, and the largest.
STEPS, MOST_STEPS = 20, 400
IS_BLANK = np.isin(np.arange(256), list(BLANK_BYTES))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    ink = text.translate(None, BLANK_BYTES)
    word_chars = len(ink) if ink.isascii() else len(ink.decode("utf-8", "surrogatepass"))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(BLANK_BYTES))
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        once, twice = set(), set()
        for w in windows:
            (twice if w in once else once).add(w)
        until = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeat += i + 3 - max(until, i)
                until = i + 3
    return len(words), word_chars, n_symbols, dup, repeat


def packed_grams(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte from the order-th on, packed big-endian."""
    out = np.zeros(len(data) - order + 1, dtype=np.uint32)
    for k in range(order):
        out <<= np.uint32(8)
        out |= data[k : len(data) - order + 1 + k]
    return out


def padded(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole texts, each preceded by order - 1 zero bytes; with where texts begin. A long text is a block of its own."""
    pad, held, size = b"\0" * (order - 1), [], 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text) + order - 1
        if size >= BLOCK or k == len(texts) - 1:
            ends = np.cumsum([len(t) + order - 1 for t in held])
            yield np.frombuffer(pad + pad.join(held), dtype=np.uint8), np.concatenate([[0], ends[:-1]])
            held, size = [], 0


def buffers(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most about BLOCK bytes of text (the last column), or one row, so that what a task makes of texts is small, however many rows Spark sends at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
            yield batch.slice(at, until - at)
            at = until


def count_grams(docs: DataFrame, text_column: str = "text", order: int = ORDER) -> DataFrame:
    """gram, n: over all texts, with order - 1 zero bytes before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            for data, begins in padded(buffers(batch.column(0)), order):
                packed = packed_grams(data, order)
                inside = np.ones(len(packed), dtype=bool)
                for k in range(1, order):  # n-grams that end in the next text's padding
                    inside[begins[1:] - k] = False
                found, n = np.unique(packed[inside], return_counts=True)
                merged = np.concatenate([keys, found])
                keys, place = np.unique(merged, return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n])).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["gram", "n"])

    return docs.select(text_of(docs, text_column).cast("binary").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], float]:
    """For each order 1..order: gram, n, p (interpolated), backoff (of the gram as a context; not at the highest order). And the probability of an unseen byte."""
    tables = [written(counts, f"counts{order}")]
    for k in range(order - 1, 0, -1):
        continued = tables[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables.insert(0, written(continued, f"counts{k}"))
    lower, out, unseen = None, [], 1 / 256
    for k, grams_k in enumerate(tables, 1):
        n = [r or 0 for r in grams_k.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i * 0.99) if n[i - 1] and n[i] else 0.5 for i in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        here = grams_k.withColumn("context", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        context = here.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("mass"))
        here = here.join(context, "context")
        if lower is None:
            here = here.withColumn("below", F.lit(1 / 256))
            mass = context.first()
            unseen = mass["mass"] / 256 if mass else unseen
        else:
            here = here.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        here = here.select("gram", "n", ((F.col("n") - cut) / F.col("total") + F.col("mass") * F.col("below")).alias("p"))
        if out:
            out[-1] = out[-1].join(context.select(F.col("context").alias("gram"), F.col("mass").alias("backoff")), "gram", "full")  # texts begin with contexts that follow nothing
        lower = written(here, f"order{k}")
        out.append(lower)
    return out, unseen


class Model:
    """Sorted arrays, for texts outside the corpus: per order the packed n-grams, the log probabilities (nan for a mere context) and the log backoff weights."""

    def __init__(self, arrays: list[tuple[np.ndarray, np.ndarray, np.ndarray]], unseen: float):
        self.arrays, self.order, self.unseen = arrays, len(arrays), np.float32(np.log(unseen))

    @classmethod
    def build(cls, tables: list[DataFrame], unseen: float) -> Model:
        """At most MOST_HELD rows of each order reach the driver; a larger model is an error. (quality_rules() sends less and has no such bound.)"""
        arrays = []
        for t in tables:
            back = F.log(F.greatest(F.coalesce("backoff", F.lit(1.0)), F.lit(1e-30))) if "backoff" in t.columns else F.lit(0.0)
            got = t.select("gram", F.log("p").cast("float").alias("p"), back.cast("float").alias("b")).limit(MOST_HELD + 1).toArrow().sort_by("gram")
            if got.num_rows > MOST_HELD:
                raise ValueError(f"more than {MOST_HELD} n-grams of one order")
            arrays.append((got["gram"].to_numpy().astype(np.uint32), got["p"].to_numpy(), got["b"].to_numpy()))
        return cls(arrays, unseen)

    def find(self, k: int, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order-k arrays by binary search, and whether they hold the n-gram."""
        keys = self.arrays[k - 1][0]
        at = np.minimum(np.searchsorted(keys, packed), max(len(keys) - 1, 0))
        return at, (keys[at] == packed) if len(keys) else np.zeros(len(packed), dtype=bool)

    def log_probabilities(self, packed: np.ndarray, k: int | None = None) -> np.ndarray:
        """Of n-grams of order k, with backoff where one is missing."""
        k = self.order if k is None else k
        if k == 0:
            return np.full(len(packed), self.unseen, dtype=np.float32)
        at, found = self.find(k, packed)
        out = self.arrays[k - 1][1][at] if len(self.arrays[k - 1][1]) else np.zeros(len(packed), dtype=np.float32)
        found &= ~np.isnan(out)
        if not found.all():
            miss = packed[~found]
            back = np.zeros(len(miss), dtype=np.float32)
            if k > 1:
                b_at, b_found = self.find(k - 1, miss >> np.uint32(8))
                if len(self.arrays[k - 2][2]):
                    back = np.where(b_found, self.arrays[k - 2][2][b_at], np.float32(0))
            out = out.copy()
            out[~found] = back + self.log_probabilities(miss & np.uint32((1 << 8 * (k - 1)) - 1), k - 1)
        return out


def train(docs: DataFrame, text_column: str = "text") -> Model:
    return Model.build(*kneser_ney(count_grams(docs, text_column)))


class Sorted:
    """Keys in order with their values. A key's hash gives the place of one key of that hash; if it is another's, binary search finds it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        bits = 8 * keys.dtype.itemsize
        return (keys * keys.dtype.type(MULTIPLIER >> (64 - bits) | 1)) >> keys.dtype.type(bits - SLOT_BITS)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (0 where there is none), and which keys are there."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        if not hasattr(self, "slots"):
            self.slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
            self.slots[self.slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        at = self.slots[self.slot(keys)]
        found = self.keys[at] == keys
        other = np.flatnonzero(~found)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            found[other] = self.keys[at[other]] == keys[other]
        return np.where(found, self.values[at], np.float32(0)), found


class Lookup:
    """A table of keys with n and value: the frequent keys, at most most_sent, as a sorted array for tasks; `rest` has the others, or is None."""

    def __init__(self, table: DataFrame, dtype: type, most_sent: int = MOST_SENT):
        sizes = {r["k"]: (r["keys"], r["n"]) for r in table.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).collect()}
        self.total = sum(n for _, n in sizes.values())
        above, least = 0, 1 << (max(sizes, default=0) + 1)
        for k in sorted(sizes, reverse=True):
            above += sizes[k][0]
            if above > most_sent:
                break
            least = 1 << k
        frequent = table.where(F.col("n") >= least).select("key", F.col("value").cast("float")).toArrow()
        keys = frequent.column(0).to_numpy().astype(np.int64).view(np.uint64).astype(dtype)
        order = np.argsort(keys)
        self.frequent = Sorted(keys[order], frequent.column(1).to_numpy()[order])
        # each has fewer than `least` occurrences, so none is hot in a join
        self.rest = table.where(F.col("n") < least).select("key", "value") if above > most_sent else None


def looked_up(sorted_: Sorted, keys: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose keys lie between begins and ends: the sum of the values, the number of keys that are not there, and these."""
    values, found = sorted_.look(keys)
    inside = np.zeros(len(keys) + 1, dtype=np.int32)  # between two texts there may be keys of neither
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    missing = ~found & (np.cumsum(inside)[:-1] > 0)
    sums, counts = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)]), np.concatenate([[0], np.cumsum(missing)])
    return sums[ends] - sums[begins], counts[ends] - counts[begins], keys[missing]


def word_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of blocks of whole texts: the 64-bit hash of each word, and where the words of each text begin."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size < WORD_BLOCK and k < len(texts) - 1:
            continue
        data = np.frombuffer(b"\n" + b"\n".join(held), dtype=np.uint8)
        blank = IS_BLANK[data]
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        begins = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in held[:-1])]))
        if len(starts):
            place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
            codes = np.where(blank, np.uint64(0), data.astype(np.uint64) + np.uint64(1))[starts[0] :]
            powers = np.cumprod(np.full(int(place.max()) + 1, WORD_BASE, dtype=np.uint64))
            h = np.add.reduceat(codes * powers[place], starts - starts[0])
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        else:
            h = np.zeros(0, dtype=np.uint64)
        yield h.view(np.int64), begins
        held, size = [], 0


def count_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """word (its hash), n: over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found = np.concatenate([keys, *(x for x, _ in waiting)])
            order = np.argsort(found, kind="stable")  # fast on sorted runs
            found, n = found[order], np.concatenate([counts, *(n for _, n in waiting)])[order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else order
            return found[first], np.add.reduceat(n, first) if len(first) else n

        for batch in slices(batches):
            for h, _ in word_hashes(buffers(batch.column(0))):
                waiting.append(np.unique(h, return_counts=True))
                size += len(waiting[-1][0])
                if size >= WORDS_WAITING:
                    keys, counts = merged()
                    waiting, size = [], 0
                    if len(keys) >= WORDS_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["word", "n"])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["word", "n"])

    return docs.select(text_of(docs, text_column).cast("binary").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_lookup(docs: DataFrame, text_column: str = "text", most_sent: int = MOST_SENT) -> Lookup:
    """The log probabilities of all n-grams of the documents."""
    tables, _ = kneser_ney(count_grams(docs, text_column))
    return Lookup(tables[-1].select(F.col("gram").alias("key"), "n", F.log("p").alias("value")), np.uint32, most_sent)


def word_lookup(docs: DataFrame, text_column: str = "text", most_sent: int = MOST_SENT) -> Lookup:
    """The logarithms of the counts of all words."""
    counts = written(count_words(docs, text_column), "words")
    return Lookup(counts.select(F.col("word").alias("key"), "n", F.log("n").alias("value")), np.uint64, most_sent)


MEASURES = ("gram", "word")


def score(docs: DataFrame, grams: Lookup, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", carry: tuple[str, ...] = (), words: Lookup | None = None) -> DataFrame:
    """doc_id, lang, carried columns, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, gram_sum (and word_sum) with the keys that were not sent as gram_rare (word_rare), base_failed.

    The result must be written: row numbers are those of one run.
    """
    used = [grams, *([words] if words else [])]
    shared = docs.sparkSession.sparkContext.broadcast([x.frequent for x in used])
    rest = [x.rest is not None for x in used]
    names = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes"]
    more = [f for m, some in zip(MEASURES, rest, strict=False) for f in ([f"{m}_sum", f"{m}_rare"] if some else [f"{m}_sum"])]
    kept = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[lang_column].cast("string").alias("lang"), *(docs[c].alias(f"carry_{c}") for c in carry), text_of(docs, text_column).cast("binary").alias("bytes"))

    def keys_of(k: int, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if k == 0:
            for data, begins in padded(texts, ORDER):
                yield packed_grams(data, ORDER), begins, np.append(begins[1:], len(data)) - (ORDER - 1)
        else:
            for h, begins in word_hashes(texts):
                yield h.view(np.uint64), begins, np.append(begins[1:], len(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches):
            texts = buffers(batch.column(batch.num_columns - 1))
            row = np.arange(len(texts)) + done + (TaskContext.get().partitionId() << 40)
            done += len(texts)
            counts = np.array([(*base_counts(t), len(t)) for t in texts], dtype=np.int64).reshape(-1, 6)
            columns = [*batch.columns[:-1], pa.array(row), *(pa.array(counts[:, i]) for i in range(6))]
            for k, some in enumerate(rest):
                got = [looked_up(shared.value[k], *x) for x in keys_of(k, texts)]
                columns.append(pa.array(np.concatenate([g[0] for g in got]) if got else np.zeros(0)))
                if some:
                    offsets = np.concatenate([[0], np.cumsum(np.concatenate([g[1] for g in got]))]) if got else np.zeros(1)
                    others = np.concatenate([g[2] for g in got]).astype(np.uint64).view(np.int64) if got else np.zeros(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(others)))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names, *more])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    scored = kept.mapInArrow(run, head + "".join(f", {n} long" for n in names) + "".join(f", {f} {'array<long>' if f.endswith('rare') else 'double'}" for f in more))
    return scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def complete(scored: DataFrame, lookup: Lookup, measure: str) -> DataFrame:
    """Adds the values of the keys that were not sent to the measure's sum. scored must be written."""
    if lookup.rest is None:
        return scored
    found = scored.select("row", F.explode(f"{measure}_rare").alias("key")).join(lookup.rest, "key").groupBy("row").agg(F.sum("value").alias("more"))
    return scored.drop(f"{measure}_rare").join(found, "row", "left").withColumn(f"{measure}_sum", F.col(f"{measure}_sum") + F.coalesce("more", F.lit(0.0))).drop("more")


def bands(scored: DataFrame, measure: str = "log_perplexity", prior: int = 100) -> DataFrame:
    """band_lang, q1, q3 of the measure: a row per language that has documents which pass the base rules.

    A language has its own median. Its distances to the quartiles are drawn towards those of all documents about the
    medians of their languages, as if `prior` such documents were among its own.
    """
    passed = scored.where("not base_failed")
    ends = F.percentile_approx(measure, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q")
    own = written(passed.groupBy("lang").agg(ends, F.count(F.lit(1)).alias("docs")).withColumnRenamed("lang", "band_lang"), "medians")
    about = _with_bands(passed, own).select((F.col(measure) - F.col("q")[1]).alias(measure)).agg(ends).first()[0]
    below, above = (-about[0], about[2]) if about else (0.0, 0.0)
    share = F.col("docs") / (F.col("docs") + prior)
    return written(own.select(
        "band_lang", (F.col("q")[1] - share * (F.col("q")[1] - F.col("q")[0]) - (1 - share) * below).alias("q1"),
        (F.col("q")[1] + share * (F.col("q")[2] - F.col("q")[1]) + (1 - share) * above).alias("q3"),
    ), "bands")


def _with_bands(scored: DataFrame, own: DataFrame) -> DataFrame:
    if own.count() <= 10_000:  # else Spark joins by shuffling
        own = F.broadcast(own)
    return scored.join(own, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")


def banded(scored: DataFrame, measure: str, width: tuple[float, float], low: str, high: str, prior: int = 100) -> DataFrame:
    """Adds low and high: q1 and q3 of the language, widened by so many of its interquartile ranges. A language without documents that pass the base rules has an empty band, which decides nothing."""
    iqr = F.col("q3") - F.col("q1")
    joined = _with_bands(scored, bands(scored, measure, prior))
    return joined.withColumn(low, F.coalesce(F.col("q1") - width[0] * iqr, F.lit(0.0))).withColumn(high, F.coalesce(F.col("q3") + width[1] * iqr, F.lit(0.0))).drop("q1", "q3")


def labelled_widths(scored: DataFrame, measure: str, labels: DataFrame, width: float = 4.0, prior: int = 100) -> tuple[float, float]:
    """The lower and the upper width, in interquartile ranges of the language, with the fewest errors (clean documents lost, junk kept) on labelled rows.

    Distances are counted in steps of 1 / STEPS, so a few hundred counts reach the driver. Of widths that err equally the
    middle is taken; without junk to reject on a side, `width` or the furthest clean document if that lies further.
    """
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = _with_bands(scored.where("not base_failed").join(quality, "doc_id"), bands(scored, measure, prior)).where("q3 > q1")
    iqr = F.col("q3") - F.col("q1")
    step = lambda x: F.least(F.floor(x / iqr * STEPS), F.lit(MOST_STEPS)).cast("int")
    side = F.when(F.col(measure) < F.col("q1"), F.struct(F.lit(0).alias("side"), step(F.col("q1") - F.col(measure)).alias("step"))).when(F.col(measure) > F.col("q3"), F.struct(F.lit(1).alias("side"), step(F.col(measure) - F.col("q3")).alias("step")))
    found = known.select(side.alias("s"), (F.col("quality") == 0).cast("int").alias("junk")).where("s is not null").groupBy("s.side", "s.step", "junk").count().collect()
    counts = np.zeros((2, 2, MOST_STEPS + 1), dtype=np.int64)
    for r in found:
        counts[r["side"], r["junk"], r["step"]] = r["count"]
    out = []
    for clean, junk in counts:
        errors = (clean[::-1].cumsum()[::-1] + junk.cumsum() - junk)  # with all from each step on rejected
        errors = np.append(errors, junk.sum())
        first = int(errors.argmin())
        last = first + int((np.append(errors[first:], -1) != errors[first]).argmax()) - 1
        out.append(max(width, first / STEPS) if last == MOST_STEPS + 1 else (first + last) / 2 / STEPS)
    return out[0], out[1]


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", width: float = 4.0, prior: int = 100, carry: tuple[str, ...] = (), labels: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """score() with perplexity, low and high (the band in log perplexity) and kept.

    With labels (doc_id, quality) of training rows: also word_log_perplexity (0 without a word), word_low and word_high, and kept documents lie in both bands.
    """
    with small_batches(docs.sparkSession):
        grams = gram_lookup(docs, text_column, most_sent)
        words = word_lookup(docs, text_column, most_sent) if labels is not None else None
        scored = written(score(docs, grams, id_column, text_column, lang_column, carry, words), "scored")
    scored = complete(scored, grams, "gram").withColumn("log_perplexity", -F.col("gram_sum") / F.greatest("n_bytes", F.lit(1)))
    if words:
        mean = F.col("word_sum") / F.greatest("n_words", F.lit(1))
        scored = complete(scored, words, "word").withColumn("word_log_perplexity", F.when(F.col("n_words") > 0, float(np.log(max(words.total, 1))) - mean).otherwise(0.0)).drop("word_sum")
    scored = scored.drop("row", "n_bytes", "gram_sum")
    if grams.rest is not None or words and words.rest is not None:
        scored = written(scored, "measured")
    judged = banded(scored, "log_perplexity", (width, width), "low", "high", prior)
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("low"), F.col("high"))
    if words:
        judged = banded(judged, "word_log_perplexity", labelled_widths(scored, "word_log_perplexity", labels, width, prior), "word_low", "word_high", prior)
        kept &= F.col("word_log_perplexity").between(F.col("word_low"), F.col("word_high"))
    return judged.withColumn("perplexity", F.exp("log_perplexity")).withColumn("kept", kept)
