"""Removal of repeated substrings: every byte covered by a `length`-byte string that also starts earlier.

1. Each window of `length` bytes is assigned its minimiser, the smallest hash of its k-grams; neighbouring windows with
   one minimiser form a run. Equal windows have equal minimisers, so only runs of one minimiser can share a window. Runs
   leave the tasks as fixed-width records (hashes, document, place), without text, in a row per batch and bucket. Runs
   of equal bytes in one batch are settled there, so copies that fill a third of all rows cost a record per batch.
2. Per bucket of minimisers: runs with a minimiser of their own are done. Runs of equal bytes collapse to the earliest;
   all windows of the others start earlier elsewhere. A window reaches over at least half of what a window holds besides
   its minimiser on one side of that, so distinct runs can share one only if they share the bytes of that half; those
   that do need their text.
3. The texts of those runs, a few per document, are dealt by minimiser. In each task a suffix order and its
   Burrows-Wheeler transform are built over bounded groups of them; breadth-first backward extension finds interval
   borders by increasing common prefix and stops at `length`. Suffixes between borders share at least `length` bytes;
   all but the earliest of each class are marked.

A passage in very many contexts gives one minimiser very many distinct runs. If a batch has over `local_hot` of them, it
deals its records by content and tells step 2 that the minimiser is hot; step 2 also calls one hot that has over
`hot_runs`. Hot runs are cut at every eighth window from the minimiser on, and the pieces are dealt by the bytes that
their windows have in common, equal pieces of a batch combined first. So no task gets all records or text of a minimiser.
The pieces at a passage's ends reach into each document's own context but share a key. Keys with over `key_bytes` of text
are split once more: their single windows are dealt by all their bytes, equal ones combined first, so under one key there
are only equal windows, at most one text per batch.
4. The marks return to the documents, where covered bytes are cut.

No two equal windows lie in one run (the leftmost smallest k-gram would lie at two places of it), so step 3 sees every
equal pair that step 2 has not settled. Step 2 takes runs for equal whose minimiser and whose 64-bit hash are equal; the
hash mixes all k-grams of the run under a random key of the job, so nobody can write texts that collide. Step 3 compares
byte by byte.

Defined cases: null text is empty; a null id ranks below every other, with the least long; documents of one id and
different texts rank by a hash of the text; repeated rows of one id and text count as one document and get one result
each; matches never cross documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_of, written
from .perplexity import buffers

NO_ID = -(1 << 63)
GRAM = 24
#: Bytes of text hashed at once; places in a block fit PLACE_BITS.
BLOCK, PLACE_BITS = 1 << 20, 22
#: Bytes of run text under one suffix order.
GROUP = 1 << 20
#: Distinct runs of one minimiser that are compared in one task, and that one batch sends to one task.
HOT_RUNS, LOCAL_HOT = 10_000, 64
#: Bytes of text under one key, beyond which its windows are dealt singly; more than HOT_RUNS runs have.
KEY_BYTES = 1 << 22
#: Records of runs in a bucket, which a task holds at a time. A byte of text has about 5/4 bytes of records (48 for every 39), so the number of buckets follows from the bytes of all texts.
BUCKET_BYTES = 1 << 25
#: Windows in a piece of a hot run.
PIECE = 8
#: Flags in the count of windows, which is below SPREAD: the run is settled; its minimiser is hot. A count of 0 says that a minimiser is hot.
SETTLED, SPREAD, HOT = 1 << 15, 1 << 14, 1 << 31
BASE = 0x9E3779B97F4A7C15 | 1
RUN = np.dtype([("h", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("content", "<i8"), ("start", "<u4"), ("n", "<u2"), ("at", "<u2"), ("left", "<u4"), ("right", "<u4")])
MARK = np.dtype([("start", "<u4"), ("n", "<u4")])
WANT = np.dtype([("start", "<u4"), ("n", "<u4"), ("h", "<u8"), ("at", "<u4")])


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, for hashes of any stretch of a block."""

    up: np.ndarray | None = None
    down: np.ndarray

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            cls.up = np.cumprod(np.full(n, BASE, dtype=np.uint64))
            cls.down = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def minimiser_runs(data: np.ndarray, begins: np.ndarray, length: int, key: int = 1) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end in data: place, number of windows, minimiser hash, content hash and distance to the minimiser of each run, and hashes of the halves to the left and right of the minimiser (0 where the run does not reach so far)."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) + (np.zeros(0, np.uint32),) * 2
    power = lambda e: np.uint64(pow(BASE, e, 1 << 64))
    one = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    h = (eight[:-8] * power(8) + eight[8:])[: n - GRAM + 1] * power(8) + eight[16 : n - GRAM + 17]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - length + 1], low[span - width : span - width + n - length + 1])
    ends = np.append(begins[1:], n)
    new = np.ones(n + 1, dtype=bool)
    new[1 : n - length + 1] = low[1:] != low[:-1]
    new[n - length + 1 : n] = False
    valid = np.zeros(n + 2, dtype=np.int32)
    long = ends - begins >= length
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    new[begins] = True
    new[ends[long] - length + 1] = True
    places = np.flatnonzero(new)
    count = np.diff(places)
    places = places[:-1]
    inside = np.cumsum(valid)[places] > 0
    places, count = places[inside], count[inside]
    up, down = Powers.get(n)
    mixed = h * np.uint64(key | 1)
    mixed ^= mixed >> np.uint64(29)
    mixed *= up[: len(h)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
    stretch = lambda first, last: (sums[last + 1] - sums[first]) * down[first]  # noqa: E731  hash of the k-grams first..last
    content = stretch(places, places + count + length - 1 - GRAM) + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    content ^= content >> np.uint64(31)
    at = (low[places] & mask).astype(np.int64)
    half = (length - GRAM) // 2
    left, right = (np.zeros(len(places), np.uint32) for _ in range(2))
    for out, use, first in ((left, at - places >= half, at - half), (right, places + count + length - 1 - at >= half + GRAM, at)):
        found = stretch(first[use], first[use] + half)
        out[use] = (found ^ found >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return places, count, h[at], content, at - places, left, right


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, begins, which text, offset in it: texts end to end; a text longer than BLOCK in pieces that overlap by length - 1 bytes."""
    held, which, offset, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            piece = text[at : at + BLOCK + length - 1]
            if size and size + len(piece) > BLOCK:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([0, *map(len, held[:-1])]), np.array(which), np.array(offset)
                held, which, offset, size = [], [], [], 0
            held.append(piece)
            which.append(k)
            offset.append(at)
            size += len(piece)
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([0, *map(len, held[:-1])]), np.array(which), np.array(offset)


def suffix_order(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The suffixes of all strings in data (each followed by a byte that only ends it), sorted; equal ones in the order of their strings. data holds codes 1.. and 0 at the ends."""
    n = len(data)
    ends = np.append(begins[1:], n)
    left = np.repeat(ends, np.diff(np.append(begins, n))) - np.arange(n) - 1  # codes before the end
    key = np.zeros(n, dtype=np.int64)
    at = np.arange(n)
    for j in range(7):
        key = key * 257 + np.where(j < left, data[np.minimum(at + j, n - 1)], 0)
    width, longest = 7, int(left.max())
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        if width >= longest or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1) + np.where(width < left, rank[np.minimum(at + width, n - 1)] + 1, 0)
        width *= 2


def prefix_classes(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and where a suffix shares fewer than `length` codes with the one before it.

    Breadth-first backward extension over the Burrows-Wheeler transform: level l holds the intervals of strings of l
    codes whose right border was new; borders found at level l + 1 have a common prefix of l codes.
    """
    order = suffix_order(data, begins)
    n, m = len(data), len(begins)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    before = order - 1
    bwt = data[before]  # 0 where a string begins (before[0] of the first string is the last end)
    to = rank[before]
    by = np.argsort(bwt, kind="stable")
    same = bwt[by][1:] == bwt[by][:-1]
    earlier, later = np.full(n, -1), np.full(n, n)
    earlier[by[1:][same]], later[by[:-1][same]] = by[:-1][same], by[1:][same]
    border = np.zeros(n + 1, dtype=bool)
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for level in range(length):
        sizes = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        solid = bwt[at] > 0
        at, lows, highs = at[solid], np.repeat(low, sizes)[solid], np.repeat(high, sizes)[solid]
        low, high = np.sort(to[at[earlier[at] < lows]]), np.sort(to[at[later[at] >= highs]]) + 1
        if level == 0:  # the ends are strings of one code each
            low, high = np.concatenate([np.arange(m), low]), np.concatenate([np.arange(1, m + 1), high])
        fresh = ~border[high]
        low, high = low[fresh], high[fresh]
        border[high] = True
        if not len(low):
            break
    return order, border[:n]


def repeated(texts: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """Of runs with their fields (doc, content, start): index of the run and offset in it of each window that starts earlier too, as pairs."""
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.zeros(int(sizes.sum()), dtype=np.int64)
    text_codes = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1
    is_end = np.zeros(len(data), dtype=bool)
    is_end[begins + sizes - 1] = True
    data[~is_end] = text_codes
    order, border = prefix_classes(data, begins, length)
    shares = ~border
    member = shares | np.append(shares[1:], False)
    places, klass = order[member], np.cumsum(border)[member]
    which = np.searchsorted(begins, places, side="right") - 1
    offset = places - begins[which]
    rank = np.lexsort((docs["start"][which] + offset, docs["content"][which], docs["doc"][which], klass))
    first = np.ones(len(rank), dtype=bool)
    first[1:] = klass[rank][1:] != klass[rank][:-1]
    marked = rank[~first]
    return np.stack([which[marked], offset[marked]], axis=1)


def per_document(doc: np.ndarray, content: np.ndarray, *fields: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    order = np.lexsort((content, doc))
    doc, content, fields = doc[order], content[order], [f[order] for f in fields]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (content[1:] != content[:-1])) + 1
    for a, b in zip([0, *cut], [*cut, len(doc)], strict=True):
        if b > a:
            yield int(doc[a]), int(content[a]), [f[a:b] for f in fields]


def later_copies(runs: np.ndarray) -> np.ndarray:
    """Which runs have the bytes of an earlier run of another document or place."""
    if not len(runs):
        return np.zeros(0, dtype=bool)
    both = runs["h"] ^ (runs["s"] << np.uint64(1))
    order = np.argsort(both, kind="stable")
    alike = both[order][1:] == both[order][:-1]
    some = order[np.append(alike, False) | np.append(False, alike)]
    some = some[np.lexsort((runs["start"][some], runs["content"][some], runs["doc"][some], runs["s"][some], runs["h"][some]))]
    out = np.zeros(len(runs), dtype=bool)
    if len(some):
        r = runs[some]
        new = np.append(True, (r["h"][1:] != r["h"][:-1]) | (r["s"][1:] != r["s"][:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        out[some] = (r["doc"] != r["doc"][first]) | (r["content"] != r["content"][first]) | (r["start"] != r["start"][first])
    return out


def _runs(rows: DataFrame, length: int, buckets: int, local_hot: int) -> DataFrame:
    job = secrets.randbits(64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, contents = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for data, begins, which, offset in blocks(buffers(batch.column(2)), length):
                places, count, h, s, at, left, right = minimiser_runs(data, begins, length, job)
                k = np.searchsorted(begins, places, side="right") - 1
                part = np.empty(len(places), dtype=RUN)
                part["h"], part["s"], part["doc"], part["content"], part["start"], part["n"], part["at"] = h, s, docs[which[k]], contents[which[k]], places - begins[k] + offset[k], count, at
                part["left"], part["right"] = left, right
                found.append(part)
            if found:
                runs = np.concatenate(found)
                runs["n"][later_copies(runs)] |= SETTLED
                seen, count = np.unique(runs["h"][runs["n"] < SETTLED], return_counts=True)
                hot = seen[count > local_hot]
                runs["n"][(runs["n"] < SETTLED) & np.isin(runs["h"], hot)] |= SPREAD
                notes = np.zeros(len(hot), dtype=RUN)
                notes["h"] = hot
                runs = np.concatenate([runs, notes])
                spread = np.select([runs["n"] >= SETTLED, runs["n"] >= SPREAD], [runs["doc"].astype(np.uint64), runs["h"] ^ runs["s"]], runs["h"])
                bucket = (spread % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                runs, bucket = runs[order], bucket[order]
                cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
                if len(runs):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[np.append(0, cut)]), pa.array([x.tobytes() for x in np.split(runs, cut)], pa.binary())], ["bucket", "runs"])

    return rows.mapInArrow(run, "bucket int, runs binary")


def _share_a_half(runs: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Which runs share the left or the right half with another of the distinct runs of their minimiser."""
    out = np.zeros(len(runs), dtype=bool)
    for side in ("left", "right"):
        key = lambda x, side=side: x["h"] + x[side].astype(np.uint64) * np.uint64(BASE)
        known, n = np.unique(key(distinct[distinct[side] > 0]), return_counts=True)
        if len(known):
            at = np.minimum(np.searchsorted(known, key(runs)), len(known) - 1)
            out |= (runs[side] > 0) & (known[at] == key(runs)) & (n[at] > 1)
    return out


def _settled(runs: DataFrame, hot_runs: int) -> DataFrame:
    """doc, content, marks (settled runs), wants (runs whose text is needed). Rows come sorted by bucket; a task holds one bucket's records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((bucket, x) for batch in batches for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, same in groupby(rows, key=itemgetter(0)):
            yield from settle(np.concatenate([np.frombuffer(x.as_buffer(), dtype=RUN) for _, x in same]))

    def settle(got: np.ndarray) -> Iterator[pa.RecordBatch]:
        done, spread = got[got["n"] >= SETTLED], got[(got["n"] >= SPREAD) & (got["n"] < SETTLED)]
        done["n"] -= SETTLED
        spread["n"] -= SPREAD
        told = got["h"][got["n"] == 0]
        got = got[(got["n"] > 0) & (got["n"] < SPREAD)]
        got = got[np.argsort(got["h"], kind="stable")]
        hot = np.isin(got["h"], told)
        if len(got):
            alike = got["h"][1:] == got["h"][:-1]
            use = hot | np.append(alike, False) | np.append(False, alike)
            got, hot = got[use], hot[use]
        later = later_copies(got)
        distinct = np.unique(got[~later][["h", "s", "left", "right"]]) if len(got) else got  # records that repeat one place count once
        h, kinds = np.unique(distinct["h"], return_counts=True)
        kinds = kinds[np.searchsorted(h, got["h"])] if len(h) else np.zeros(len(got), dtype=np.int64)
        want = ~later & (hot | (kinds > 1) & _share_a_half(got, distinct))
        hot |= kinds > hot_runs
        again = later_copies(spread)
        got = np.concatenate([got, spread, done])
        later = np.concatenate([later, again, np.ones(len(done), dtype=bool)])
        want = np.concatenate([want, ~again, np.zeros(len(done), dtype=bool)])
        hot = np.concatenate([hot, np.ones(len(spread), dtype=bool), np.zeros(len(done), dtype=bool)])
        use = later | want
        if not use.any():
            return
        marks, wants = np.zeros(len(got), MARK), np.zeros(len(got), WANT)
        for out in (marks, wants):
            out["start"], out["n"] = got["start"], got["n"]
        wants["h"], wants["at"] = got["h"], got["at"]
        wants["n"][hot] |= HOT
        rows = [(d, c, m[k].tobytes(), w[v].tobytes()) for d, c, (m, w, k, v) in per_document(got["doc"][use], got["content"][use], marks[use], wants[use], later[use], want[use])]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 10_000], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc", "content", "marks", "wants"])

    return runs.mapInArrow(run, "doc long, content long, marks binary, wants binary")


def pieces(text: bytes, start: int, n: int, at: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Of a hot run: key, first window and number of windows of each piece. Equal windows lie in pieces of equal key: pieces end at fixed distances from the minimiser, and the key hashes the bytes that all windows of a whole piece share."""
    middle = start + at
    for block in range((start - middle) // PIECE, (start + n - 1 - middle) // PIECE + 1):
        low = middle + PIECE * block
        first, end = max(start, low), min(start + n, low + PIECE)
        yield xxhash.xxh64_intdigest(text[low + PIECE - 1 : low + length]), first, end - first


TEXT_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
TEXT_SCHEMA = "bucket int, h long, doc long, content long, start long, n int, text binary"


def batch_of(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TEXT_TYPES, strict=True)], ["bucket", "h", "doc", "content", "start", "n", "text"])


def combined(found: list[tuple], buckets: int) -> list[tuple]:
    """Of equal pieces all but the earliest lose their text."""
    out, last = [], None
    for text, doc, content, start, n, key in sorted(set(found)):
        out.append((key % buckets if text != last else doc % buckets, key - (1 << 63), doc, content, start, n, text if text != last else None))
        last = text
    return out


def _texts_of_runs(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, h, doc, content, start, n, text of the wanted runs, and of the pieces of hot ones. Null text: all n windows start earlier, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for doc, content, text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), buffers(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for start, n, h, at in np.frombuffer(b"".join(wants), dtype=WANT).tolist():
                    if n >= HOT:
                        hot += [(text[w : w + k + length - 1], doc, content, w, k, key) for key, w, k in pieces(text, start, n - HOT, at, length)]
                    else:
                        out.append((h % buckets, h - (1 << 63), doc, content, start, n, text[start : start + n + length - 1]))
                if len(hot) >= 200_000:
                    yield batch_of(combined(hot, buckets))
                    hot = []
            for at in range(0, len(out), 20_000):
                yield batch_of(out[at : at + 20_000])
        if hot:
            yield batch_of(combined(hot, buckets))

    return rows.mapInArrow(run, TEXT_SCHEMA)


def _bounded(texts: DataFrame, length: int, buckets: int, key_bytes: int) -> DataFrame:
    """The texts, those of keys with more than key_bytes as single windows, dealt by all bytes. texts must be written."""
    large = texts.where("text is not null").groupBy("h").agg(F.sum(F.length("text")).alias("bytes")).where(F.col("bytes") > key_bytes).select("h")
    large = F.broadcast(written(large, "large"))  # at most a key per key_bytes of all text
    split = texts.where("text is not null").join(large, "h", "left_semi").select("doc", "content", "start", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: list[tuple] = []
        for batch in batches:
            for doc, content, start, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(n):
                    window = text[k : k + length]
                    windows.append((window, doc, content, start + k, 1, xxhash.xxh64_intdigest(window)))
                if len(windows) >= 200_000:
                    yield batch_of(combined(windows, buckets))
                    windows = []
        if windows:
            yield batch_of(combined(windows, buckets))

    whole = texts.where("text is null").unionByName(texts.where("text is not null").join(large, "h", "left_anti").select(texts.columns))
    return whole.unionByName(split.mapInArrow(run, TEXT_SCHEMA))


def _compared(texts: DataFrame, length: int) -> DataFrame:
    """doc, content, marks: windows that start earlier in another run. Rows come sorted by h; groups hold whole minimisers."""
    field = np.dtype([("doc", "<i8"), ("content", "<i8"), ("start", "<i8")])

    def marks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = np.array([(x[1], x[2], x[3] + k) for x in held if x[5] is None for k in range(x[4])], dtype=field)
        held = [x for x in held if x[5] is not None]
        info = np.array([x[1:4] for x in held], dtype=field)
        found = repeated([x[5] for x in held], info, length) if held else np.zeros((0, 2), dtype=np.int64)
        info, offset = np.concatenate([info[found[:, 0]], known]), np.append(found[:, 1], np.zeros(len(known), dtype=np.int64))
        if not len(info):
            return
        rows = []
        for doc, content, (start,) in per_document(info["doc"], info["content"], info["start"] + offset):
            start = np.sort(start)
            cut = np.flatnonzero(np.diff(start) != 1) + 1
            out = np.zeros(len(cut) + 1, MARK)
            out["start"], out["n"] = start[np.append(0, cut)], np.diff(np.concatenate([[0], cut, [len(start)]]))
            rows.append((doc, content, out.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "content", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= GROUP and row[0] != held[-1][0]:
                    yield from marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5] or b"")
        if held:
            yield from marks(held)

    return texts.select("h", "doc", "content", "start", "n", "text").mapInArrow(run, "doc long, content long, marks binary")


def covered(marks: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal covered stretches, from marks of windows."""
    got = np.frombuffer(b"".join(marks), dtype=MARK)
    got = got[np.argsort(got["start"], kind="stable")]
    start, end = got["start"].astype(np.int64), np.maximum.accumulate(got["start"].astype(np.int64) + got["n"] + length - 1)
    new = np.append(True, start[1:] > end[:-1]) if len(start) else np.zeros(0, bool)
    return list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist() if len(end) else [], strict=True))


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 100, carry: tuple[str, ...] = (), as_text: bool = False, hot_runs: int = HOT_RUNS, local_hot: int = LOCAL_HOT, key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per input row: doc_id, carried columns, n_bytes, n_removed, n_spans, spans (array of start, end), kept (the remaining bytes).

    as_text: kept is a string, without the rest of a character that a cut has broken.
    """
    if not 2 * GRAM <= length < SPREAD:
        raise ValueError(f"length must be at least {2 * GRAM} and below {SPREAD}")
    n = partitions(docs.sparkSession)
    text = text_of(docs, text_column)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(8 * n, -(-size * 5 // (4 * BUCKET_BYTES)))
    key = [F.coalesce(docs[id_column].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("content")]
    plain = docs.select(*key, text.cast("binary").alias("bytes"))
    settled = written(_settled(_runs(plain, length, buckets, local_hot).repartition(n, "bucket").sortWithinPartitions("bucket"), hot_runs), "runs")

    keyed = docs.select(*key, docs[id_column].isNull().alias("null_id"), text.cast("binary").alias("bytes"), *(docs[c].alias(f"carry_{c}") for c in carry)).repartition(n, "doc", "content")
    wants = settled.where(F.length("wants") > 0).groupBy("doc", "content").agg(F.collect_list("wants").alias("wants"))
    wanted = keyed.join(wants, ["doc", "content"]).select("doc", "content", "bytes", "wants")
    texts = _bounded(written(_texts_of_runs(wanted, length, buckets), "texts"), length, buckets, key_bytes).dropDuplicates(["h", "doc", "content", "start"]).repartition(n, "bucket").sortWithinPartitions("h", "doc", "content", "start")
    marks = settled.where(F.length("marks") > 0).select("doc", "content", "marks").unionByName(_compared(texts, length)).groupBy("doc", "content").agg(F.collect_list("marks").alias("marks"))
    rows = keyed.join(marks, ["doc", "content"], "left").select("doc", "null_id", *(f"carry_{c}" for c in carry), "bytes", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, kept = [], [], [], []
            for text, marks in zip(buffers(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                found = covered(marks, length) if marks else []
                size.append(len(text))
                gone.append(sum(b - a for a, b in found))
                spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(text)], strict=True)) if found else text)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            columns = [*batch.columns[:-2], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "n_bytes", "n_removed", "spans", "kept"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    out = rows.mapInArrow(cut, head + ", n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary"))
    return out.select(F.when(~F.col("null_id"), F.col("doc")).alias("doc_id"), *(F.col(f"carry_{c}").alias(c) for c in carry), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
