"""Secret scanning with multipart credential linking (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import free, located, saved, table

# The base patterns.  The length rules of access and hex are part of
# their patterns (a run is taken whole or not at all); that of assign is a filter,
# because a short value still uses up its characters.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts: they are reported only next to a complementary part.  ACCESS_KEY behind
# "secret" names a secret, not an id.
WEAK_ACCESS = (r"""(?i:access_?key_?id|access(?<!secret[a-z0-9_.-]{0,64}access)_?key|client_?id|user_?name|login)"""
               r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""")
# A value under a *secret*key name, or a bare base64 run with its padding, taken whole: 40
# characters of any kind, or at least 32 that are not all lower case, upper case or digits.
WEAK_SECRET = (r"""(?i:secret[a-z0-9_.-]{0,64}key)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*["']?[A-Za-z0-9+/_.=~-]{6,}"""
               r"""|(?<![A-Za-z0-9+/_-])(?!AKIA[A-Z0-9]{16})(?:[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"""
               r"""|(?![a-z+/]{32,}+(?![A-Z0-9]))(?![A-Z+/]{32,}+(?![a-z0-9]))(?![0-9+/]{32,}+(?![A-Za-z]))"""
               r"""[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-]))""")
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
SCOPE = 200                  # code points between complementary parts; None: the whole text

SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"
BLOCK = 64                   # items folded at a time: arrays that grow stay short
CUT_BLOCK = 512              # pieces cut from one region of a text


def _bind(value: Column, use) -> Column:
    """``use(value)``; a one-element array binds it to a variable, so it is computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column, size: int) -> Column:
    last = F.greatest(F.floor((F.size(items) - 1) / size), F.lit(0).cast("bigint")).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, size))


def _with_prefix(items: Column, value, plus) -> Column:
    """Every item as (before, item): ``before`` is the value of all earlier ones by ``plus`` from 0.
    Blocks are folded first, then the items of each block from there: linear but for the blocks' own
    number, whose array alone grows."""
    zero = F.lit(0).cast("bigint")

    def before(start: Column, part: Column, of) -> Column:
        return F.aggregate(
            part, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct(plus(acc["at"], of(x)).cast("bigint").alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(
            b, zero, lambda acc, x: plus(acc, value(x)).cast("bigint")))
        return F.flatten(F.zip_with(blocks, before(zero, totals, lambda x: x), lambda b, at: F.zip_with(
            before(at, b, value), b, lambda n, x: F.struct(n.alias("before"), x.alias("item")))))

    return _bind(items, lambda xs: _bind(_blocks(xs, BLOCK), placed))


def _spans(text: Column, pattern: str, kind: int, keep=None, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, stop) in code points: the
    matches and the gaps between them alternate, so positions are running sums of
    their lengths.  ``keep`` filters matches; ``hint`` is a string every match holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda p: F.struct(F.length(p["g"]).cast("bigint").alias("g"),
                                                      F.length(p["m"]).cast("bigint").alias("m")))
        return F.transform(
            _with_prefix(sizes, lambda x: x["g"] + x["m"], lambda x, y: x + y),
            lambda p: F.struct((p["before"] + p["item"]["g"]).alias("start"), F.lit(kind).alias("kind"),
                               (p["before"] + p["item"]["g"] + p["item"]["m"]).alias("stop")))

    def pairs(m: Column) -> Column:
        return F.zip_with(m, F.slice(gaps, 1, F.size(m)),
                          lambda x, g: F.struct(g.alias("g"), x.alias("m")))

    spans = F.transform(F.array(found), lambda m: placed(pairs(m)))[0]
    if keep is not None:
        spans = F.transform(F.array(found), lambda m: F.transform(
            F.filter(F.zip_with(placed(pairs(m)), m,
                                lambda s, x: F.struct(s.alias("s"), x.alias("m"))),
                     lambda p: keep(p["m"])), lambda p: p["s"]))[0]
    some = text.rlike(pattern)
    if hint:
        some = text.contains(hint) & some
    return F.when(some, spans).otherwise(F.array().cast(SPAN))


def _base(t: Column) -> Column:
    return F.concat(
        _spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_MIN),
        _spans(t, ACCESS, 1, hint="AKIA"),
        _spans(t, HEX, 2))


def _weak(t: Column) -> Column:
    return F.concat(_spans(t, WEAK_ACCESS, 3), _spans(t, WEAK_SECRET, 4),
                    _spans(t, ENDPOINT, 5, hint="://"))


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_weak``, spans in the text by kind, and ``_size``, its length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (docs.withColumn("_base", _base(t)).withColumn("_weak", _weak(t))
            .withColumn("_size", F.length(t).cast("bigint")))


def _needs(kind: Column, a: Column, b: Column) -> Column:
    """Whether a weak part of ``kind`` is reported: ``a`` an access, ``b`` a secret is in scope."""
    return ((kind == 3) & b) | ((kind == 4) & a) | ((kind == 5) & a & b)


def linked(found: DataFrame, scope: int | None = SCOPE) -> DataFrame:
    """Weak parts with their complements nearby: ``_row``, ``_linked`` spans.

    ``found``: ``_row``, ``_base``, ``_weak``, ``_size``.  Roles: access (access, weak_access),
    secret (assign, hex, weak_secret), endpoint.  An access needs a secret, a secret an
    access, an endpoint both, in its scope: the interval of the whole text if ``scope`` is
    None, else at most ``scope`` code points away.  An interval join.  Over the whole text, the
    parts of a role are first reduced to the extent that they take in their text, a row per
    text, and a scope joins the extents that it meets.  Else each part is filed under the bins of
    ``scope`` code points that its widened interval meets, weak parts under the bins of
    their own; equal (row, bin) are joined, which bounds a key by what fits into a
    few bins of one text.
    """
    weak = found.where(F.size("_weak") > 0)
    every = (weak.select("_row", F.explode(F.concat("_base", "_weak")).alias("s"))
             .select("_row", F.col("s.start").alias("o_start"), F.col("s.stop").alias("o_stop"),
                     F.col("s.kind").alias("o_kind"))
             .withColumn("o_role", F.when(F.col("o_kind").isin(1, 3), 1)
                         .when(F.col("o_kind") == 5, 3).otherwise(2)))
    if scope is None:
        extents = every.groupBy("_row").agg(*[
            f(F.when(F.col("o_role") == role, F.col(f"o_{end}"))).alias(f"{name}_{end}")
            for name, role in (("a", 1), ("b", 2)) for f, end in ((F.min, "start"), (F.max, "stop"))])
        scopes = weak.select("_row", F.explode("_weak").alias("s"), F.lit(0).cast("bigint").alias("scope_start"),
                             F.col("_size").alias("scope_stop"))

        def met(name: str) -> Column:
            return F.coalesce((F.col(f"{name}_start") < F.col("scope_stop"))
                              & (F.col(f"{name}_stop") > F.col("scope_start")), F.lit(False))
        return (scopes.join(extents, "_row").where(_needs(F.col("s.kind"), met("a"), met("b")))
                .groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("_linked")))
    every = every.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col("o_start") / scope) - 1, F.floor(F.col("o_stop") / scope) + 1)))
    mine = (weak.select("_row", F.explode("_weak").alias("s"))
            .withColumn("_bin", F.explode(F.sequence(
                F.floor(F.col("s.start") / scope), F.floor(F.col("s.stop") / scope)))))
    near = ((F.col("o_start") - F.col("s.stop") <= scope)
            & (F.col("s.start") - F.col("o_stop") <= scope))
    return (mine.join(every, ["_row", "_bin"]).where(near)
            .groupBy("_row", "s").agg(F.bool_or(F.col("o_role") == 1).alias("a"),
                                      F.bool_or(F.col("o_role") == 2).alias("b"))
            .where(_needs(F.col("s.kind"), F.col("a"), F.col("b")))
            .groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("_linked")))


def scan(docs: DataFrame, text: str = "text", scope: int | None = SCOPE, keep=("doc_id",)) -> DataFrame:
    """All secrets of every text: the ``keep`` columns, ``base`` and ``spans``.

    ``base``: the spans of the base patterns, ``spans``: with linked weak parts; arrays
    of (start, kind, stop) by start, then kind (an index into ``KINDS``); code points,
    stop exclusive.  The text is read once; what later steps move are spans only.
    Null and empty texts have empty arrays; repeated rows keep their rows (each row
    has its own key); an empty table gives an empty result; other columns are ignored.
    """
    cols = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    found = parts(docs.select(*cols, F.col(text).alias("_text")), "_text").drop("_text")
    found = saved(found.withColumn("_row", F.monotonically_increasing_id()), "secret-parts")
    more = saved(linked(found, scope), "secret-links")
    none = F.array().cast(SPAN)
    return (found.join(more, "_row", "left")
            .select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
                    F.array_sort("_base").alias("base"),
                    F.array_sort(F.concat("_base", F.coalesce("_linked", none))).alias("spans")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op8_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), scope=None).select(
        "doc_id", _count(0).alias("n_assign"), _count(1).alias("n_access"),
        _count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))


def _cut(spans: Column, t: Column, mask: str) -> Column:
    """The text with each span, or group of overlapping spans, replaced by ``mask``."""
    cuts = F.filter(_with_prefix(spans, lambda s: s["stop"], lambda x, y: F.greatest(x, y)),
                    lambda p: p["item"]["start"] >= p["before"])

    def sub(string: Column, at: Column, stop: Column) -> Column:
        return F.substring(string, (at + 1).cast("int"), (stop - at).cast("int"))

    def pieces(block: Column) -> Column:
        # Cut from the block's own region: a substring is sought from the start of its string.
        at = F.get(block, F.lit(0))["before"]
        region = F.struct(at.alias("at"), sub(t, at, F.element_at(block, -1)["item"]["start"]).alias("text"))
        return _bind(region, lambda r: F.transform(
            block, lambda c: sub(r["text"], c["before"] - r["at"], c["item"]["start"] - r["at"])))

    end = F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: F.greatest(acc, s["stop"]))
    tail = F.substring(t, (end + 1).cast("int"), F.length(t))
    cut = _bind(cuts, lambda cs: F.flatten(F.transform(_blocks(cs, CUT_BLOCK), pieces)))
    return F.array_join(F.concat(cut, F.array(tail)), mask)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]",
           scope: int | None = SCOPE) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask`` (overlapping
    spans by one).  Rows, repeated ones too, order of columns and null texts stay as they are;
    an empty table stays empty; columns of any name are kept.

    Links are the interval join of ``linked`` for every scope, as in ``scan``.  What it moves are
    spans, which are joined back by the place of the row; texts are written only where ``docs``
    isn't read from files.
    """
    keyed, at = located(docs, "secret-docs")
    found = parts(keyed.select(F.struct(*at).alias("_row"), F.col(text).alias("_text")), "_text")
    # Filtered when written: pushed below the patterns, the filter would match them once more.
    found = saved(found.drop("_text"), "secret-parts").where(F.size("_base") + F.size("_weak") > 0)
    more = linked(found, scope)
    name = free("_spans", keyed.columns)
    spans = saved(found.join(more, "_row", "left").select(
        *[F.col(f"_row.{c}").alias(c) for c in at],
        F.array_sort(F.concat("_base", F.coalesce("_linked", F.array().cast(SPAN)))).alias(name)), "secret-links")
    return (keyed.join(spans, at, "left")
            .withColumn(text, F.when(F.size(name) > 0, _cut(F.col(name), F.col(text), mask))
                        .otherwise(F.col(text)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
