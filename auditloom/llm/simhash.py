"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints of their word shingles. Equal fingerprints are collapsed first, so copies cost one row.
Two fingerprints within `most_bits` = 2 bits agree on at least two of four 16-bit blocks; each distinct fingerprint is
dealt by its six pairs of blocks. In each group, a table of Hamming distances to reference fingerprints (pivots) is
computed once; by the triangle inequality a pair whose distances to any pivot differ by more than most_bits is
discarded, and the survivors are verified. The group's links are folded to one link per member as they are found.
Groups above `group_limit` are dealt again, by pairs of the four quarters of the 32 bits that they do not share, and once
more by the quarters of the 16 bits left then: after that at most 8 bits differ, so no group has over
max(group_limit, 256) members, and every close pair still meets. Links become components.

Defined cases: null, empty and blank texts have fingerprint 0; a text of fewer words than a shingle is one shingle; rows
that share an id each get a row; a null id ranks above every other and is kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, text_of, written
from .components import connected_components

BLOCK_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def pivots(n: int) -> np.ndarray:
    """n pseudo-random reference fingerprints, the same for every run."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit by bit the majority of the XXH64 of all word shingles."""
    words = text.translate(TO_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(digests[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(digests), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(batch.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    kept = docs.select(docs[id_column].cast("long").alias("doc_id"), *(docs[c].alias(f"carry_{c}") for c in carry), text_of(docs, text_column).cast("binary").alias("text"))
    return kept.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1]) + "fp long")


def close_pairs(fps: np.ndarray, table: np.ndarray, most_bits: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within most_bits: candidates by the first pivot's order, then pivot by pivot, then verified."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    for at in range(0, len(fps), block):
        rows = order[at : at + block]
        until = int(np.searchsorted(first, first[min(at + block, len(fps)) - 1] + most_bits, side="right"))
        for lo in range(at, until, 4 * block):
            others = order[lo : min(lo + 4 * block, until)]
            near = np.abs(table[rows, 0][:, None] - table[others, 0][None, :]) <= most_bits
            i, j = np.nonzero(near)
            i, j = rows[i], others[j]
            keep = i != j
            i, j = i[keep], j[keep]
            for p in range(1, table.shape[1]):
                keep = np.abs(table[i, p] - table[j, p]) <= most_bits
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(fps[i] ^ fps[j]) <= most_bits
            yield i[keep], j[keep]


def fold(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each member's smallest known one, itself a root) after the links i-j."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def group_links(fps: np.ndarray, refs: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The group's links, folded: each member to the smallest member that it reaches inside the group."""
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    label = np.arange(len(fps))
    for i, j in close_pairs(fps, table, most_bits):
        label = fold(label, i, j)
    far = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[far], fps[label[far]]


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """fp, key, rest -> a row for each pair of the four blocks of `width` bits in rest: fp, the key with the pair's bits, and the other two blocks as rest."""
    block = lambda i: F.shiftright("rest", width * i).bitwiseAND((1 << width) - 1)
    both = lambda a, b: block(a) * (1 << width) + block(b)
    cells = (F.struct(F.xxhash64("key", F.lit(n), both(*pair)).alias("key"), both(*(i for i in range(4) if i not in pair)).alias("rest")) for n, pair in enumerate(BLOCK_PAIRS))
    return rows.select("fp", F.explode(F.array(*cells)).alias("k")).select("fp", "k.*")


def cells(distinct: DataFrame, group_limit: int) -> DataFrame:
    """fp, key: groups of two or more in which all close pairs meet (keys that collide join groups, which loses nothing)."""
    rows, out = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), None
    for width in (16, 8, 4):
        rows = dealt(rows, width)
        sizes = written(rows.groupBy("key").count().where("count > 1"), "sizes")  # two plain shuffles below the join, which AQE can split
        rows = rows.join(sizes, "key")
        done = (rows if width == 4 else rows.where(F.col("count") <= group_limit)).select("fp", "key")
        out = done if out is None else out.unionByName(done)
        if width == 4 or sizes.where(F.col("count") > group_limit).isEmpty():
            return out
        rows = written(rows.where(F.col("count") > group_limit).select("fp", "key", "rest"), "large")
    raise AssertionError


def near_links(distinct: DataFrame, most_bits: int = 2, n_pivots: int = 24, group_limit: int = 4096) -> DataFrame:
    """distinct (fp) -> links (a, b) that connect all fingerprints within most_bits of each other."""
    if most_bits > 2:
        raise ValueError("four blocks find at most two differing bits")
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by group; what of a group a batch leaves open is carried over."""
        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(2)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            yield from links(columns, rest := [x[ends(columns)[-1] :] for x in columns] if len(columns[0]) else None)
        if rest is not None:
            yield from links(rest, None)

    def ends(columns: list[np.ndarray]) -> np.ndarray:
        """Where groups begin."""
        new = np.ones(len(columns[0]), dtype=bool)
        new[1:] = columns[0][1:] != columns[0][:-1]
        return np.nonzero(new)[0]

    def links(columns: list[np.ndarray], rest: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        size = len(columns[0]) - (len(rest[0]) if rest is not None else 0)
        if not size:
            return
        columns = [x[:size] for x in columns]
        bounds = np.append(ends(columns), size)
        fps = columns[1].view(np.uint64)
        found = [group_links(np.unique(fps[a:b]), refs, most_bits) for a, b in zip(bounds, bounds[1:], strict=False) if b > a + 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    rows = cells(distinct, group_limit).select("key", "fp").repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, most_bits: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable); with carry also the carried columns and root, which tells components apart."""
    rows = written(fingerprints(docs, id_column, text_column, width, carry), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(distinct.select("fp"), most_bits))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *((*(f"carry_{c}" for c in carry), "root") if carry else ()))
