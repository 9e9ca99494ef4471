"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.llm.common import located, saved, table

WEIGHTS = (1, 2, 3)          # by code point order of the source, repeating, null last
SHARE = 1.0                  # budget as a part of all words
MAX_REPEATS = 3
SLOT_ROWS = 10_000           # rows that one ordered slot of a source holds on average
SEED = "mix-1"
RESULT = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words per source.

    ``sources``: ``source`` and ``source_size`` (words), one row per source.  Returns
    both with ``target``: ``share`` of all words, split by weight; a target stops at
    ``repeats`` times the source's size and the excess goes to the others by weight.
    With sources in order of size by weight, those before the first that keeps below
    its stop at the common level are stopped, and the level fills the rest.  The
    windows run over one row per source, not over documents.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = F.when(F.col("_open") > 0, (F.col("_budget") - F.col("_full")) / F.col("_open"))
    return (sources
            .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                               (F.row_number().over(order) - 1) % n + 1))
            .withColumn("_stop", repeats * F.col("source_size"))
            .withColumn("_budget", share * F.sum("source_size").over(every))
            .withColumn("_full", F.coalesce(F.sum("_stop").over(before), F.lit(0)))
            .withColumn("_open", F.sum("weight").over(every)
                        - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("_level", level)
            # The level rises while stopped sources leave the split and falls after.
            .withColumn("_level", F.max("_level").over(every))
            .withColumn("target", F.coalesce(
                F.least(F.col("_stop").cast("double"), F.col("_level") * F.col("weight")),
                F.col("_stop").cast("double")))
            .select("source", "source_size", "target"))


def mix(docs: DataFrame, size: Column, weights=WEIGHTS, share: float = SHARE,
        repeats: int = MAX_REPEATS, seed: str = SEED, slot_rows: int = SLOT_ROWS,
        keep=("doc_id",)) -> DataFrame:
    """Mix documents so that each source gives its target number of words.

    ``docs`` needs ``doc_id`` and ``source``; ``size`` is a document's size.  Each
    source is shuffled by the md5 of seed and doc_id.  A document's virtual finish
    time is the words of its source up to and with it, divided by the source's
    target; a source whose target is above its size starts over (up to ``repeats``
    times).  The copies in order of finish time are taken until the next one would
    exceed the total budget.

    Returns the ``keep`` columns, ``size``, ``source_size``, ``target``, ``taken`` (size times
    the copies taken), one row per input row; a ``keep`` column of these four names is left out.  Null sources form one source, the
    last.  Documents of size 0 are returned with ``taken`` 0.  Equal doc_ids (or null
    ones) keep their rows; ties order by doc_id, size, then row key.  Empty tables
    give an empty result; other columns are ignored.

    The running sums are split: slots of about ``slot_rows`` documents by hash range,
    sums per slot, offsets over the small slot table, an ordered window in each slot.
    A source with a third of all rows is thus many slots.  The truncation is split
    the same way, by ranges of finish time.
    """
    keep = [c for c in keep if c not in RESULT]
    extra = [c for c in keep if c not in ("doc_id", "source")]
    keyed, at = located(docs, "mix-docs") if extra else (docs, [])
    sized = saved(keyed.select("doc_id", "source", size.alias("size"),
                               *[F.col(c).alias(f"at_{i}") for i, c in enumerate(at)])
                  .withColumn("_h", F.md5(F.concat(F.lit(seed + ":"),
                                                   F.coalesce(F.col("doc_id").cast("string"),
                                                              F.lit("")))))
                  .withColumn("_row", F.monotonically_increasing_id()), "mix-sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                            F.count("*").alias("_n"))
    targets = saved(source_targets(by_source.select("source", "source_size"), weights, share,
                                   repeats)
                    .join(by_source.select(F.col("source").alias("_s"), "_n"),
                          F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-targets")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target",
                       F.ceil(F.col("_n") / slot_rows).alias("_slots"))
    # The first 15 hex digits as a number below 2^60, cut into equal ranges.
    slot = F.floor(F.conv(F.substring("_h", 1, 15), 16, 10).cast("decimal(20,0)")
                   * F.col("_slots") / F.lit(1 << 60)).cast("long")
    rows = saved(sized.drop(*[f"at_{i}" for i in range(len(at))]).join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                 .withColumn("_slot", slot).drop("_slots"), "mix-slots")
    # Offsets: words of the slots before, per source (a few rows per 10,000 documents).
    slots = (rows.groupBy("source", "_slot").agg(F.sum("size").alias("_w"))
             .withColumn("_from", F.sum("_w").over(
                 Window.partitionBy("source").orderBy("_slot")) - F.col("_w")))
    slots = saved(slots.select(F.col("source").alias("_s"), F.col("_slot").alias("_t"), "_from"),
                  "mix-offsets")
    inside = (Window.partitionBy("source", "_slot")
              .orderBy("_h", F.col("doc_id").asc_nulls_last(), "size", "_row")
              .rowsBetween(Window.unboundedPreceding, 0))
    pos = (rows.withColumn("_in", F.sum("size").over(inside))
           .join(slots, F.col("source").eqNullSafe(F.col("_s"))
                 & (F.col("_slot") == F.col("_t")))
           .select("_row", "doc_id", "_h", "source", "size", "source_size", "target",
                   (F.col("_from") + F.col("_in")).alias("_cum")))
    pos = saved(pos, "mix-positions")

    def finish(copy):
        return (F.col("_cum") + copy * F.col("source_size")) / F.col("target")

    some = F.col("size") > 0 if repeats else F.lit(False)
    epochs = F.sequence(F.lit(0), F.lit(max(repeats, 1) - 1))
    # Copies that finish by 1 fit together, for each source's are within its target.
    pos = pos.withColumn("_taken", F.when(some & (F.col("target") > 0), F.col("size") * F.size(
        F.filter(epochs, lambda e: finish(e) <= 1))).otherwise(F.lit(0)).cast("long"))
    total = F.sum("source_size")
    # Two sums reach the driver: the budget that is left, and the number of rows.
    spent = pos.agg(F.coalesce(F.sum("_taken"), F.lit(0)).alias("s")).first()["s"]
    sums = targets.agg(F.least(share * total, repeats * total).cast("double").alias("all"),
                       F.sum("_n").alias("rows")).first()
    left = F.lit((sums["all"] or 0.0) - spent)
    late = (pos.where(some & (F.col("target") > 0)).withColumn("_copy", F.explode(epochs))
            .withColumn("_finish", finish(F.col("_copy"))).where("_finish > 1")
            .withColumn("_bin", F.floor((F.col("_finish") - 1)
                                        * F.lit(max(1.0, (sums["rows"] or 0) / slot_rows)))
                        .cast("long")))
    bins = late.groupBy("_bin").agg(F.sum("size").alias("_w"))
    bins = (bins.withColumn("_before", F.sum("_w").over(Window.orderBy("_bin")) - F.col("_w"))
            .where(F.col("_before") <= left)
            .select(F.col("_bin").alias("_b"), "_before"))
    bins = saved(bins, "mix-bins")
    order = (Window.partitionBy("_bin")
             .orderBy("_finish", F.col("source").asc_nulls_last(), "_h",
                      F.col("doc_id").asc_nulls_last(), "size", "_row", "_copy")
             .rowsBetween(Window.unboundedPreceding, 0))
    rest = (late.join(bins, F.col("_bin") == F.col("_b"))
            .withColumn("_upto", F.col("_before") + F.sum("size").over(order))
            .where(F.col("_upto") <= left).groupBy("_row").agg(F.sum("size").alias("_more")))
    out = pos.join(rest, "_row", "left").select(
        "_row", "doc_id", "source", "size", "source_size", "target",
        (F.col("_taken") + F.coalesce("_more", F.lit(0))).cast("long").alias("taken"))
    if not extra:
        return out.select(*keep, *RESULT)
    # Each row back to its place; a text moves once, with its row, and is never copied to disk.
    out = saved(out.join(sized.select("_row", *[f"at_{i}" for i in range(len(at))]), "_row"), "mix-taken")
    other = keyed.select(*at, *extra).toDF(*[f"at_{i}" for i in range(len(at))],
                                           *[f"k_{i}" for i in range(len(extra))])
    back = other.join(out, [f"at_{i}" for i in range(len(at))])
    return back.select(*[F.col(f"k_{extra.index(c)}").alias(c) if c in extra else F.col(c) for c in keep],
                       *RESULT)


def op9_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS stop, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
             CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
f AS (SELECT *, coalesce(sum(stop) OVER p, 0) AS fulls,
             sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS opens
      FROM w WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CAST(budget - fulls AS DOUBLE) / CAST(opens AS DOUBLE)) OVER () AS level FROM f),
t AS (SELECT source, source_size, budget, least(CAST(stop AS DOUBLE), level * weight) AS target FROM l),
c AS (SELECT d.doc_id, d.source, d.h, d.size, t.source_size, t.budget, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id
                                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT c.*, k.copy, CAST(cum + copy * source_size AS DOUBLE) / target AS finish
      FROM c, (VALUES (0), (1), (2)) AS k(copy) WHERE size > 0 AND target > 0),
r AS (SELECT *, CAST(sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, size, copy
                                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e),
k AS (SELECT doc_id, source, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE total <= budget GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0) AS taken
FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.source IS NOT DISTINCT FROM k.source
"""
