"""Benchmark decontamination by size-partitioned MinHash containment (DataFrame
functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.llm.common import free, SHINGLE_WORDS, SIMILARITY, saved, shingle_hashes, table, word_hashes

BROADCAST_ROWS = 2_000_000   # item shingles that may be sent to every executor (8 bytes each)
HOT_ITEMS = 100              # a shingle of more items comes last in the MinHash order


def item_shingles(items: DataFrame, item_id: str, text: str, k: int) -> DataFrame:
    """``item``, ``h``, ``n``, ``width``: the distinct shingles of every class of items with equal
    shingle sets, under the class's least id, their number and their words.  An item of fewer
    than ``k`` words is one shingle of that width."""
    words = word_hashes(F.col(text))
    sets = (items.select(F.col(item_id).alias("item"), F.least(F.size(words), F.lit(k)).alias("width"),
                         F.array_sort(F.array_distinct(shingle_hashes(F.col(text), k))).alias("s"))
            .where(F.size("s") > 0)
            .groupBy("s").agg(F.min("item").alias("item"), F.min("width").alias("width")))
    return sets.select("item", F.size("s").alias("n"), "width", F.explode("s").alias("h"))


def probes(text: Column, k: int, widths: list[int]) -> Column:
    """Distinct shingles of a document: of ``k`` words, and of each shorter width in ``widths``."""
    def short(h: Column, w: int) -> Column:
        # The hash that ``shingle_hashes`` gives a whole text of w words.
        return F.when(F.size(h) < w, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(h) - w + 1),
                        lambda i: F.xxhash64(F.slice(h, i, w), F.lit(w))))
    long = shingle_hashes(text, k)
    if not widths:
        return F.array_distinct(long)
    more = F.transform(F.array(word_hashes(text)), lambda h: F.concat(*[short(h, w) for w in widths]))[0]
    return F.array_distinct(F.concat(long, more))


def sketches(shingles: DataFrame, threshold: float, hot_items: int = HOT_ITEMS) -> DataFrame:
    """Bottom-k MinHash of every item, k by its size partition.

    A document that holds at least ``threshold`` of an item's n shingles lacks at most
    floor((1 - threshold) n) of them, so it holds one of any floor((1 - threshold) n) + 1.
    A partition takes the sizes from 2^c to 2^(c+1) - 1 and k for the largest of them:
    no containment is missed.  Shingles of more than ``hot_items`` items come behind all
    others of an item, so a phrase that very many share makes candidates only of items that
    hold little else.
    """
    hot = (shingles.groupBy("h").agg(F.count("*").alias("_items"))
           .select("h", (F.col("_items") > hot_items).alias("_hot")))
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = F.floor((1 - threshold) * top + 1e-9) + 1
    order = Window.partitionBy("item").orderBy("_hot", "h")
    return (shingles.join(hot, "h").withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= k).select("item", "h"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY,
                 k: int = SHINGLE_WORDS, doc_id: str = "doc_id", item_id: str = "item_id",
                 text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
                 hot_items: int = HOT_ITEMS) -> DataFrame:
    """Documents that contain test items: ``doc_id``, ``item_id``, ``shared``, ``n_shingles``,
    ``containment`` (shared distinct shingles by those of the item, at least ``threshold``).

    Items with equal shingles are one class, shown by its least id.  Null, empty and
    wordless texts match nothing; an item of fewer than ``k`` words is one shingle of its
    width and is found inside longer texts too.  Rows with equal doc_ids are judged
    one by one and give one row per (doc_id, item_id), with the greatest containment; a
    null doc_id is kept as null.  Empty tables give an empty result; other columns
    are ignored.

    Each text is shingled once and its shingles meet the item shingles before any
    shuffle, if those are at most ``broadcast_rows`` (counted first); else by a shuffled
    semi-join.  What is shuffled after are hits alone.
    """
    own = saved(item_shingles(items, item_id, text, k), "bench-shingles")
    keys = own.select("h").distinct()
    if own.count() <= broadcast_rows:
        keys = F.broadcast(keys)
    # At most k - 1 numbers reach the driver: the widths of items shorter than a shingle.
    widths = [r["width"] for r in own.where(F.col("width") < k).select("width").distinct().collect()]
    rows = docs.select(F.col(doc_id).alias("doc"), F.monotonically_increasing_id().alias("row"),
                       F.col(text).alias("t"))
    hits = saved(rows.select("doc", "row",
                             F.explode(probes(F.col("t"), k, sorted(widths))).alias("h"))
                 .join(keys, "h", "left_semi"), "bench-hits")
    sketch = saved(sketches(own, threshold, hot_items), "bench-sketch")
    pairs = hits.join(sketch, "h").select("row", "item").distinct()
    shared = (pairs.join(own.drop("width"), "item").join(hits, ["row", "h"])
              .groupBy("doc", "row", "item", "n").agg(F.count("*").alias("shared"))
              .where(F.col("shared") >= threshold * F.col("n") - 1e-9))
    return (shared.groupBy("doc", "item").agg(F.max(F.struct("shared", "n")).alias("m"))
            .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"),
                    F.col("m.shared").alias("shared"), F.col("m.n").cast("long").alias("n_shingles"),
                    (F.col("m.shared") / F.col("m.n")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a test item.  Documents are told apart by the md5
    of their text, so null and repeated doc_ids do no harm."""
    key, name = F.md5(F.col(text).cast("binary")), free("_bad", docs.columns)
    bad = contaminated(docs.select(key.alias("doc_id"), F.col(text).alias("text")), items, text="text", **options)
    bad = saved(bad.select(F.col("doc_id").alias(name)).distinct(), "bench-bad")
    return docs.join(bad, F.md5(docs[text].cast("binary")) == bad[name], "left_anti")


def op3_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                                      lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                                  lambda w: w <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2),
                                      lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, k),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5
         THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         ELSE [array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
cls AS (SELECT min(item_id) AS item_id FROM (SELECT item_id, string_agg(s, '|' ORDER BY s) AS k FROM bs GROUP BY item_id) GROUP BY k),
it AS (SELECT bs.item_id, bs.s, count(*) OVER (PARTITION BY bs.item_id) AS n FROM bs JOIN cls USING (item_id))
SELECT ds.doc_id, it.item_id, count(*) AS shared, any_value(it.n) AS n_shingles,
       CAST(count(*) AS DOUBLE) / CAST(any_value(it.n) AS DOUBLE) AS containment
FROM ds JOIN it USING (s) GROUP BY ds.doc_id, it.item_id
HAVING count(*) >= 0.8 * any_value(it.n) - 1e-9
"""
