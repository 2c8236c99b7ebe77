"""Groups of clustered fingerprints stay bounded and lose no link."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import least_reachable

from auditloom.llm import simhash

CENTER = 0x123456789ABCDEF0


def clustered(spark, fps):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)], "fp long")


@pytest.mark.parametrize("kind", ["half", "ball"])
def test_cells_of_50000_clustered_fingerprints(spark, kind):
    """Fingerprints that share 32 bits, and all those that lie within three bits of one."""
    rnd = random.Random(2)
    if kind == "half":
        fps = {CENTER & ~0xFFFFFFFF | rnd.getrandbits(32) for _ in range(50_000)}
    else:
        fps = {CENTER ^ sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(64), n)}
    sizes = simhash.cells(clustered(spark, fps), 1024).groupBy("key").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 1024 and (sizes[1] or 0) <= 60 * len(fps)


@pytest.mark.parametrize("limit", [4096, 1])
def test_links_of_a_ball(spark, limit):
    """With a limit of one every group is dealt three times; the smallest groups have 256 members at most."""
    rnd = random.Random(3)
    fps = {CENTER} | {CENTER ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(500)} | {rnd.getrandbits(64) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [(r.a, r.b) for r in simhash.near_links(clustered(spark, fps), group_limit=limit).collect()]
    true = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert least_reachable(signed, links) == least_reachable(signed, true)
    assert simhash.cells(clustered(spark, fps), limit).groupBy("key").count().where(f"count > {max(limit, 256)}").isEmpty()


def test_fold_reaches_the_least():
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)]
    label = np.arange(300)
    for at in range(0, 250, 40):
        i, j = (np.array(x) for x in zip(*links[at : at + 40], strict=True))
        label = simhash.fold(label, i, j)
    assert dict(enumerate(label.tolist())) == least_reachable(range(300), links)
