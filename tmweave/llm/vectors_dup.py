"""Near-duplicate embeddings: random-hyperplane tables, exact cosines, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import components, saved, table

COSINE = 0.95
MISS = 1e-4                  # a pair at the threshold shares no table with this probability
BUCKET = 16                  # unrelated vectors in a bucket, on average
BLOCK = 1024                 # vectors of a bucket that are compared at once
SEED = 11


def plan_tables(rows: int, threshold: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits so that unrelated vectors fall ``BUCKET`` to a bucket, tables so that
    a pair at the threshold is missed with probability ``miss``."""
    bits = max(4, min(40, round(math.log2(max(rows, 1) / BUCKET)) if rows > BUCKET else 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def sign_vectors(vectors: DataFrame, vec_id: str, embedding: str, bits: int, tables: int) -> DataFrame:
    """``vec_id``, ``digest`` (of the components, null if the vector can't be linked), ``vec`` (doubles)
    and ``sigs`` (a sign hash per table), one row per row; no shuffle."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"))
    planes: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = (1 << np.arange(bits, dtype=np.int64))
        for b in batches:
            out = []
            for e in b["e"]:
                x = None if e is None else np.array([np.nan if v is None else v for v in e], float)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    out.append((None, None, None))
                    continue
                x = x + 0.0                                   # one zero
                h = planes.get(len(x))
                if h is None:
                    h = planes[len(x)] = np.random.default_rng([SEED, len(x)]).normal(
                        size=(tables * bits, len(x)))
                signs = (h @ (x / np.abs(x).max()) > 0).reshape(tables, bits)
                out.append((hashlib.md5(x.tobytes()).digest(), x.tobytes(), signs @ powers))
            yield pd.DataFrame({"vec_id": b["vec_id"], "digest": [o[0] for o in out],
                                "vec": [o[1] for o in out], "sigs": [o[2] for o in out]})

    return rows.mapInPandas(run, f"vec_id {dict(rows.dtypes)['vec_id']}, digest binary, vec binary, "
                                 "sigs array<bigint>")


def _unit(vecs) -> np.ndarray:
    x = np.stack([np.frombuffer(v, float) for v in vecs])
    x = x / np.abs(x).max(axis=1, keepdims=True)              # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(group: pd.DataFrame, table_no: int, two: bool, threshold: float) -> pd.DataFrame:
    """Links of one block (or between two) of a bucket: per node the weight of its partners, and
    edges that connect what is connected.  A pair that an earlier table has is left to it for
    counting, and connected there."""
    x = _unit(group["vec"])
    side = group["side"].to_numpy()
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    if two:
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    if not len(i):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    sigs = np.stack(group["sigs"].to_numpy())[:, :table_no]
    new = ~(sigs[i] == sigs[j]).any(axis=1)
    node, mult = group["node"].to_numpy(), group["mult"].to_numpy()
    n = np.bincount(i[new], weights=mult[j[new]], minlength=len(group)).astype(np.int64)
    label = np.arange(len(group))
    while True:                                               # least label of the neighbours
        nxt = label.copy()
        np.minimum.at(nxt, i, label[j])
        if (nxt == label).all():
            break
        label = nxt
    some = (n > 0) | (label != np.arange(len(group)))
    return pd.DataFrame({"a": node[some], "b": node[label[some]], "n": n[some]})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 threshold: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Links between vectors of cosine ``threshold`` or more: ``vec_id``, ``n_links`` (other rows
    linked directly), ``component_id`` (least vec_id reachable) and ``kept``, one row per row.

    Vectors that are null, empty or zero, or that hold null or non-finite components, are linked
    with nothing; vectors of different lengths are not compared.  Equal vectors are one node
    with a weight.  Repeated rows are copies that link with each other; null vec_ids take
    part, and are never the least if another id is there; an empty table gives an empty
    result; other columns are ignored.

    Nodes of a bucket are compared in blocks of at most ``block``; a larger bucket is dealt to
    blocks by hash and every two blocks meet in a task of their own, so no task holds more than
    two blocks and no pair is a row.  A pair is counted by the first table that has it.  The cosine
    is computed in doubles.  Work within a group of true near copies is the square of its distinct
    vectors, for each one's number of links is asked for.
    """
    bits, tables = plan_tables(vectors.count(), threshold, miss)
    signed = saved(sign_vectors(vectors, vec_id, embedding, bits, tables), "vec-signed")
    nodes = saved(signed.where("digest is not null").groupBy("digest")
                  .agg(F.first("vec").alias("vec"), F.first("sigs").alias("sigs"),
                       F.count("*").alias("mult"))
                  .withColumn("node", F.monotonically_increasing_id()), "vec-nodes")
    filed = nodes.select("node", F.octet_length("vec").alias("dim"), F.posexplode("sigs").alias("t", "s"))
    sizes = saved(filed.groupBy("t", "s", "dim").agg(F.count("*").alias("size")).where("size > 1"),
                  "vec-sizes")
    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("node"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    dealt = (filed.join(sizes, ["t", "s", "dim"])
             .withColumn("own", mine).withColumn("other", other)
             .select("node", "t", "s", "dim", F.least("own", "other").alias("p"),
                     F.greatest("own", "other").alias("q"),
                     (F.col("own") > F.col("other")).alias("side")))
    dealt = saved(dealt, "vec-dealt")
    keys = ["t", "s", "dim", "p", "q"]
    rows = (dealt.join(nodes.select("node", "vec", "sigs", "mult"), "node")
            .repartition(*keys).sortWithinPartitions(*keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None                                           # the group that may go on
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            k = b[keys].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            starts = [0, *cuts]
            out = [compare(b.iloc[s:e], int(k[s, 0]), k[s, 3] != k[s, 4], threshold)
                   for s, e in zip(starts, starts[1:])]
            held = b.iloc[starts[-1]:]
            if out:
                yield pd.concat(out)
        if held is not None and len(held):
            yield compare(held, int(held["t"].iloc[0]), held["p"].iloc[0] != held["q"].iloc[0],
                          threshold)

    found = saved(rows.mapInPandas(run, "a bigint, b bigint, n bigint"), "vec-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(found.select("a", "b"), "vec")
    whole = saved(nodes.select("node", "digest", "mult").join(counts, "node", "left")
                  .join(parts, "node", "left")
                  .select("digest", F.coalesce("component", "node").alias("part"),
                          (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "vec-whole")
    rows = saved(signed.select("vec_id", "digest").join(whole, "digest", "left"), "vec-rows")
    least = saved(rows.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("least")),
                  "vec-least")
    own = F.when(F.col("part").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rows.join(least, "part", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op7_embedding_duplicates(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
        AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings
      UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY ALL)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept FROM c
"""
