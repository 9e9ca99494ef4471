"""Translation units to TM records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmweave.sources.tmx import CORRUPT, MALFORMED_ERROR, parse_units  # noqa: F401

# Fixed value: error text of a unit without two variants.
SHORT_UNIT_ERROR = "Translation unit needs a source and a target variant"
DEFAULT_TM_SCORE = 1.0  # ours: stored score of a curated TMX pair


def _seg(i: int) -> Column:
    return F.get(F.col("tuv"), i).getField("seg")


def _lang(i: int) -> Column:
    return F.get(F.col("tuv"), i).getField("_xml:lang")


def unit_error() -> Column:
    """G5 per unit: NULL when the unit is usable."""
    return (F.when(F.col(CORRUPT).isNotNull(), F.lit(MALFORMED_ERROR))
            .when(F.col("tuv").isNull() | (F.size("tuv") < 2), F.lit(SHORT_UNIT_ERROR))
            .when(_seg(0).isNull() | _seg(1).isNull(), F.lit(SHORT_UNIT_ERROR)))


def pair_segments(units: DataFrame) -> DataFrame:
    """source = first variant's segment, target = second's, by position, with
    their language tags.  Adds ``error`` (G5) instead of dropping bad units."""
    keep = [c for c in units.columns if c not in ("tuv", CORRUPT)]
    return units.select(
        *keep,
        _lang(0).alias("source_lang"), _lang(1).alias("target_lang"),
        _seg(0).alias("source_text"), _seg(1).alias("target_text"),
        unit_error().alias("error"))


def tmx_errors(pairs: DataFrame, *files: DataFrame) -> DataFrame:
    """(file_path, error, units) for every file and kind of error: units that are malformed
    or lack a variant, with their number, and the file errors given as ``files``
    (file_path, error)."""
    bad = (pairs.filter(F.col("error").isNotNull())
           .select("file_path", "error", F.lit(1).cast("bigint").alias("units")))
    for f in files:
        bad = bad.unionByName(f.select("file_path", "error", F.lit(0).cast("bigint").alias("units")))
    return bad.groupBy("file_path", "error").agg(F.sum("units").alias("units"))


def tm_id(*cols) -> Column:
    """Stable id of a TM pair from its languages and texts (64-bit xxhash).

    NULL and empty text give different ids.  Two different pairs share an id with
    probability about n^2 / 2^65 (about 1e-4 for 1e8 entries); the TM sink compares
    whole pairs, so it keeps both."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in cols],
                      F.when(nulls.contains("1"), nulls))


def tm_records(pairs: DataFrame, *, embed_target: bool = False, embedder=None,
               score: float = DEFAULT_TM_SCORE, **embed_opts) -> DataFrame:
    """C2 without the sink: valid pairs with id, stored score and embedding.

    The source text is embedded (``embed_target`` embeds the target instead);
    the embedding runs once per distinct text.  ``embed_opts`` go to
    ``embed_text`` (batch size, retry attempts and backoff of a model embedder);
    an embedder that keeps failing fails the job, as the single-file handler
    passes the error on.
    """
    from tmweave.operators.vectors import embed_text

    ok = pairs.filter(F.col("error").isNull())
    key = ["source_lang", "target_lang", "source_text", "target_text"]
    rec = ok.select(
        *[c for c in ok.columns if c != "error"],
        tm_id(*key).alias("tm_id"),
        F.col("target_text").alias("translation"),
        F.lit(score).alias("score"))
    text_col = "target_text" if embed_target else "source_text"
    vec = embed_text(rec.select(text_col).distinct(), text_col, embedder, **embed_opts)
    return rec.join(vec, text_col, "left")


def tu_xml(source_lang, target_lang, source_text, target_text) -> Column:
    """One ``<tu>`` element, text escaped for XML: two variants, or only the
    source variant when the target text is NULL."""
    def esc(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                                   F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def tuv(lang, text):
        return F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg>'), esc(text),
                        F.lit("</seg></tuv>"))

    tgt = F.col(target_text) if isinstance(target_text, str) else target_text
    second = F.when(tgt.isNotNull(), tuv(target_lang, tgt)).otherwise(F.lit(""))
    return F.concat(F.lit("<tu>"), tuv(source_lang, source_text), second, F.lit("</tu>"))
