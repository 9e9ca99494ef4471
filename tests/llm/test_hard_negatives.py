"""Hard negatives against a loop over all pairs."""

import math
import random

from pyspark.sql import functions as F

from tmweave.llm.hard_negatives import mine, pack_keys, unpack_keys

SCHEMA = "vec_id long, embedding array<double>, label int"


def good(r):
    return r[0] is not None and r[1] is not None and r[2] is not None and all(
        x is not None and math.isfinite(x) for x in r[1])


def plain(data, anchor, positives=5, negatives=5, percent=80, scale=256):
    rows = {}
    for r in data:
        if good(r) and (r[0] not in rows or (r[2], r[1]) < (rows[r[0]][2], rows[r[0]][1])):
            rows[r[0]] = r
    rows = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows.values()]
    out = []
    for a, va, la in rows:
        if not anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, v, lab in rows)
        tops = [(i, -s) for s, i, lab in scores if lab == la and i != a][:positives]
        for p, top in tops:
            fit = [(i, -s) for s, i, lab in scores
                   if lab != la and percent * top <= -100 * s <= 100 * top][:negatives]
            out += [(a, p, rank, i, top, s) for rank, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                          "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, dim=4, step=0.25):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-4, 5) * step for _ in range(dim)], rng.randrange(3)) for i in range(n)]


def test_equals_all_pairs(spark):
    data = vectors(1, 400)          # coarse components: many equal scores
    df = spark.createDataFrame(data, SCHEMA)
    want = plain(data, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert got(mine(df, F.col("vec_id") % 10 == 0)) == want
    assert got(mine(df, F.col("vec_id") % 10 == 0, block_rows=37)) == want


def test_group_of_copies(spark):
    data = [(i, [1.0, 1.0], i % 2) for i in range(300)] + vectors(2, 0)
    df = spark.createDataFrame(data, SCHEMA)
    assert got(mine(df, F.col("vec_id") < 3, block_rows=50)) == plain(data, lambda i: i < 3)


def test_scores_beyond_doubles_are_exact(spark):
    data = [(i, [2.0 ** 21 + i, 2.0 ** 20 + 3 * i], i % 2) for i in range(20)]
    df = spark.createDataFrame(data, SCHEMA)
    assert got(mine(df, F.col("vec_id") < 4)) == plain(data, lambda i: i < 4)
    assert max(r[4] for r in plain(data, lambda i: i < 4)) > 2 ** 53


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    schema = SCHEMA + ", id long, block int, sheet int, vec string, tops string, key string, asks boolean"
    more = (7, 7, 7, "v", "t", "k", True)
    data = [(None, [1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [1.0, inf], 0),
            (5, [1.0, 1.0], None), (6, [1.0, 1.0], 1), (7, [1.0, 0.9], 1), (8, [1.0, 1.0], 0),
            (8, [1.0, 1.0], 0), (8, [9.0, 1.0], 1), (9, [1.0], 0), (10, [], 0), (10, [], 0),
            (-11, [0.9, 0.9], 2), (0, [0.0, 0.0], 1)]
    df = spark.createDataFrame([r + more for r in data], schema)
    assert got(mine(df, F.lit(True))) == plain(data, lambda i: True)
    assert got(mine(df.limit(0), F.lit(True))) == []
    assert got(mine(df, F.lit(False))) == []


def test_keys_sort_as_rows():
    rng = random.Random(3)
    big = 2 ** 63 - 1
    rows = [(rng.choice([-big, -1, 0, 5, big]), rng.choice([-big, -2, 0, 9, big]), rng.randrange(2),
             rng.choice([-3, 0, 4, big])) for _ in range(300)]
    keys = pack_keys(*zip(*rows))
    assert list(zip(*unpack_keys(keys))) == rows
    in_bytes = [r for _, r in sorted(zip(keys, rows))]
    assert in_bytes == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
