"""Hard-negative mining by a secondary-sort shuffle of packed pair scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import saved, table
from tmweave.session import parallelism

SCALE = 256               # components become floor(SCALE * x)
POSITIVES = NEGATIVES = 5
FLOOR_PERCENT = 80        # of the positive's score, for a negative
BLOCK_ROWS = 50_000       # rows, and anchors, that meet in one task
CELLS = 1 << 22           # scores that a task holds at once
ANCHORS_EVERY = 100

_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
_POSITIVE, _NEGATIVE = 0, 1


def pack_keys(anchor, score, kind, ident) -> list[bytes]:
    """Keys whose byte order is (anchor, descending score, positives first, id)."""
    out = np.empty(len(score), _KEY)
    out["anchor"] = np.asarray(anchor, np.int64).view(np.uint64) ^ _SIGN
    out["score"] = ~(np.asarray(score, np.int64).view(np.uint64) ^ _SIGN)
    out["kind"], out["id"] = kind, np.asarray(ident, np.int64).view(np.uint64) ^ _SIGN
    raw, size = out.tobytes(), _KEY.itemsize
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def unpack_keys(keys: list[bytes]) -> tuple[list, list, list, list]:
    a = np.frombuffer(b"".join(keys), _KEY)
    number = lambda c: (c.astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    return number(a["anchor"]), number(~a["score"].astype(np.uint64)), a["kind"].tolist(), number(a["id"])


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows, as longs."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2.0 ** 53:           # every partial sum is a whole double, in any order
        return (a @ b.T).astype(np.int64)
    to_int = np.frompyfunc(int, 1, 1)
    return (to_int(a) @ to_int(b).T).astype(np.int64)


def _scored(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of some anchors against all rows of the block, a slice of anchors at a time."""
    width = max(anchors["vec"].map(len).max(), rows["vec"].map(len).max())
    right = _matrix(rows["vec"], width)
    step = max(1, CELLS // len(rows))
    for at in range(0, len(anchors), step):
        part = slice(at, at + step)
        yield part, _products(_matrix(anchors["vec"].iloc[part], width), right)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k by descending score, then id."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _positives_in(k: int):
    """Of one label, in a block: each anchor's first k others."""
    def run(_key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            ids, names = rows["id"].to_numpy(), anchors["id"].to_numpy()
            for part, scores in _scored(anchors, rows):
                for anchor, line in zip(names[part], scores):
                    others = np.flatnonzero(ids != anchor)
                    best = others[_first(line[others], ids[others], k)]
                    out.append(pd.DataFrame({"anchor": anchor, "id": ids[best], "score": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "id": [], "score": []})
    return run


def _negatives_in(k: int, percent: int):
    """In a block, of other labels: each window's first k, as packed keys.  A window only ever
    takes its first k, so no block need send more of it, whatever the ties."""
    def run(_key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        keys: list[bytes] = []
        if len(anchors) and len(rows):
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            for part, scores in _scored(anchors, rows):
                some = anchors.iloc[part]
                for anchor, label, windows, line in zip(some["id"], some["label"], some["tops"], scores):
                    other = labels != label
                    sent: set = set()
                    for top in {int(t) for t in windows}:
                        if top < 0:                      # 80 % of it lies above it
                            continue
                        least = -(-percent * top // 100)
                        within = np.flatnonzero(other & (line >= least) & (line <= top))
                        sent.update(within[_first(line[within], ids[within], k)].tolist())
                    chosen = np.array(sorted(sent), np.int64)
                    keys += pack_keys(np.full(len(chosen), anchor), line[chosen], _NEGATIVE, ids[chosen])
        return pd.DataFrame({"key": keys})
    return run


def _windows(k: int, percent: int):
    """Sorted keys to rows: a positive opens a window, a negative goes to the open ones.  Only the
    windows of the present anchor are held."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, last, open_ = None, None, []
        for b in batches:
            keys = b.column("key").to_pylist()
            out = []
            for key, anchor, score, kind, ident in zip(keys, *unpack_keys(keys)):
                if key == last:                          # a negative of several windows
                    continue
                last = key
                if anchor != present:
                    present, open_ = anchor, []
                if kind == _POSITIVE:
                    open_.append([ident, score, 0])
                    continue
                open_ = [w for w in open_ if w[2] < k and percent * w[1] <= 100 * score]
                for w in open_:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], ident, w[1], score))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    return run


def mine(rows: DataFrame, is_anchor, vec: str = "embedding", label: str = "label",
         vec_id: str = "vec_id", scale: int = SCALE, positives: int = POSITIVES,
         negatives: int = NEGATIVES, percent: int = FLOOR_PERCENT,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``.

    Each component becomes floor(scale * x); scores are exact integer inner products, higher ones
    first, equal ones by id.  ``is_anchor`` is a condition on the columns of ``rows``.  An anchor's
    positives are the first other rows of its label; its negatives for one of them are the first
    rows of other labels that score at least ``percent`` and at most 100 per cent of it.  A
    positive with a negative score has none.

    1. Rows and anchors meet in blocks of at most about ``block_rows``, first within labels for
       the positives: a block sends each anchor's first few, and Spark ranks those.
    2. Then over all rows: a block sends, for each window of an anchor, its first few.
    3. Positives and these pairs, packed into (anchor, descending score, id) keys, are
       repartitioned by anchor and sorted within partitions; an iterator over the sorted keys opens
       a window at each positive and emits the negatives behind it.  It holds one anchor's
       windows, never its pairs.

    Blocks are dealt by id, so neither a hot label nor a hot vector gathers in one task, and no
    block's output grows with the number of equal scores.  Rows without id, label or vector, or
    with a null or non-finite component, take no part; of repeated ids the row with the least
    label, then vector, counts; shorter vectors count as ending in zeros; an empty vector scores 0;
    an empty table gives an empty result; other columns are ignored.  A score beyond 64 bits fails
    the job.
    """
    spark = rows.sparkSession
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = (rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"),
                        F.col(vec).cast("array<double>").alias("v"),
                        F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole.alias("whole"))
            .where("id is not null and label is not null and whole")
            .groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r"))
            .select("id", "r.label", F.col("r.asks").alias("asks"),
                    F.transform("r.v", lambda x: F.floor(x * scale).cast("double")).alias("vec")))
    good = saved(good, "negatives-rows")
    asking = good.where("asks").select("id", "label", "vec")
    n, a = good.count(), asking.count()
    blocks = max(math.ceil(n / block_rows), min(parallelism(spark), math.ceil(n / 1000)), 1)
    sheets = max(math.ceil(a / block_rows), 1)

    def part(name: str, count: int):
        return F.pmod(F.xxhash64("id", F.lit(name)), F.lit(count)).cast("int")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    base = good.select("id", "label", "vec").withColumn("block", part("block", blocks)) \
        .withColumn("sheet", each(sheets))

    def asked(df: DataFrame) -> DataFrame:
        df = df.toDF(*df.columns)                        # other columns than those of the rows
        return df.withColumn("sheet", part("sheet", sheets)).withColumn("block", each(blocks))

    kind = dict(good.dtypes)["label"]
    local = (asked(asking).groupBy("label", "block", "sheet")
             .cogroup(base.groupBy("label", "block", "sheet"))
             .applyInPandas(_positives_in(positives), "anchor long, id long, score long"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id")))
    best = saved(local.groupBy("anchor").agg(F.slice(order, 1, positives).alias("best")),
                 "negatives-positives")
    windows = asking.join(best.select(F.col("anchor").alias("id"),
                                      F.transform("best", lambda b: -b["down"]).alias("tops")), "id")
    pairs = (asked(windows).groupBy("block", "sheet").cogroup(base.groupBy("block", "sheet"))
             .applyInPandas(_negatives_in(negatives, percent), "key binary"))

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, down, i = (b.column(c).to_numpy() for c in ("anchor", "down", "id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pack_keys(a, -down, _POSITIVE, i), pa.binary())], ["key"])

    openers = best.select("anchor", F.inline("best")).mapInArrow(opening, "key binary")
    # Spark's DataFrame form of repartitionAndSortWithinPartitions.
    keys = pairs.union(openers)
    return (keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")
            .mapInArrow(_windows(negatives, percent),
                        "anchor_id long, positive_id long, rank int, negative_id long, "
                        "positive_score long, negative_score long"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % ANCHORS_EVERY == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
w AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, p.score AS positive_score,
         s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score
FROM w WHERE rank <= 5
"""
