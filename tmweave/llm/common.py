"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tmweave.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: later stages start
    from files that outlive any executor, and generated row keys stay fixed."""
    return materialize(df, f"llm-{name}")


def free(name: str, *taken) -> str:
    """``name``, made longer until no column in ``taken`` has it (in any case)."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name += "_"
    return name


def located(docs: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that tell its rows apart, the same whenever it is read: file and place in
    the file.  Where ``docs`` isn't read from files directly, it is written first."""
    keys = [free("_file", docs.columns), free("_place", docs.columns)]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias(keys[0]),
                         F.col("_metadata.row_index").alias(keys[1]))
    if "_metadata" not in docs.columns:
        try:
            return keyed(docs), keys
        except AnalysisException:
            pass                                   # not a table of files
    return keyed(saved(docs, name)), keys


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words (runs of letters and digits)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"),
                     lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Hashes of the k-word shingles, in order and with repeats.  A text of 1 to
    k-1 words has one shingle, all its words; a null or wordless text has none."""
    def shingles(h: Column) -> Column:
        whole = F.when(F.size(h) == 0, F.array().cast("array<bigint>")) \
            .otherwise(F.array(F.xxhash64(h, F.size(h))))
        return F.when(F.size(h) < k, whole).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - k),
                        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))

    # A one-element array binds the word hashes to a lambda variable, so they are
    # computed once per text and not once per shingle.
    return F.transform(F.array(word_hashes(text)), shingles)[0]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Distributed connected components.

    ``edges``: columns ``a`` and ``b`` (bigint, undirected, repeats and loops allowed).  Returns
    ``node``, ``component`` (the smallest node reachable) for every node that is not itself
    the smallest of its component; all others are their own component.

    Every node links its larger neighbours to its least neighbour, then its smaller ones,
    until each component is a star around its least node.  Both steps are an aggregate and an
    equi-join of two written tables, so a node with very many edges is split by the adaptive
    skew join.  Only the answer whether all are stars reaches the driver.
    """
    def stars(df: DataFrame) -> bool:
        one, none = F.lit(1), F.lit(0)
        ends = df.select(F.col("a").alias("x"), one.alias("out"), none.alias("into")).union(
            df.select("b", none, one))
        return not ends.groupBy("x").agg(F.sum("out").alias("o"), F.sum("into").alias("i")) \
            .where("o > 1 or (o = 1 and i > 0)").limit(1).count()

    cur = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                             F.least("a", "b").alias("b")).distinct(),
                f"{name}-edges")
    while not stars(cur):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m"))
                      .select("a", F.least("a", "m").alias("m")), f"{name}-least")
        large = saved(both.where("b > a").join(least, "a")
                      .select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .where("a <> b").distinct(), f"{name}-large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        cur = saved(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-edges")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
