"""URL filters: rules, and empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmweave.llm.common import saved, table
from tmweave.llm.suffixes import RULES as SUFFIXES

# The rules of the query, as host/path prefix and verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))
BLOCK_RATE = 0.25            # a host is blocked if its rate of bad pages is above this
Z = 1.2816                   # with a posterior probability of at least 0.9
PRIOR_RANGE = (2.0, 1000.0)  # pseudo-counts of a fitted prior


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_suffix(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """``hosts`` (distinct ``host``) with ``suffix``: of the rules that fit an end of the host an
    exception, else the longest; the last label without one.  The rules are a table joined to
    the ends of the hosts, as many labels of them as the longest rule has."""
    given = []
    for r in suffixes:
        end = r.lstrip("!").removeprefix("*.")
        size = end.count(".") + 1
        given.append((end, size - 1 if r[0] == "!" else size + 1 if r[0] == "*" else size, int(r[0] == "!")))
    most = max((end.count(".") + 1 for end, _, _ in given), default=1)
    rules = hosts.sparkSession.createDataFrame(given, "end string, labels int, over int")
    parts = F.split(F.col("host"), r"\.")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.greatest(F.lit(1), n - most + 1), n), lambda i: F.array_join(
        F.slice(parts, i, n), "."))
    found = (hosts.select("host", n.alias("n"), F.explode(ends).alias("end")).join(rules, "end")
             .where("labels <= n").groupBy("host").agg(F.max(F.struct("over", "labels")).alias("best")))
    labels = F.coalesce(F.col("best.labels"), F.lit(1))
    return (hosts.join(found, "host", "left")
            .withColumn("suffix", F.array_join(F.slice(parts, n - labels + 1, labels), ".")).drop("best"))


def _domain(host: Column, suffix: Column) -> Column:
    """One label and the suffix; the host itself if it has no more labels."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) <= labels, host).otherwise(
        F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), "."))


def _strength(rows: DataFrame, mean: str) -> DataFrame:
    """Pseudo-counts s of the beta prior of one level by moments: with n trials and k
    bad ones per group and prior means m, sum((k - n m)^2) is expected to be
    sum(n m (1 - m) (1 + (n - 1) / (s + 1)))."""
    n, k, m = F.col("n"), F.col("k"), F.col(mean)
    v = n * m * (1 - m)
    rho = F.try_divide(F.sum((k - n * m) * (k - n * m)) - F.sum(v), F.sum(v * (n - 1)))
    lo, hi = PRIOR_RANGE
    # Without groups of two trials nothing is known of the spread: the weakest prior.
    return rows.agg(F.when(rho.isNull(), F.lit(lo))
                    .when(rho > 0, F.greatest(F.lit(lo), F.least(F.lit(hi), F.try_divide(F.lit(1.0), rho) - 1)))
                    .otherwise(F.lit(hi)).alias("s"))


def reputations(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Posterior of every host's rate of bad pages.

    ``hosts``: ``host``, ``n`` (labelled pages), ``k`` (bad ones), one row per host.  Level by
    level - suffix, registered domain, host - a group's prior is a beta with the parent's
    posterior mean and a strength fitted by moments over all groups of the level; its
    posterior adds its own outcomes.  Returns ``host``, ``rate``, ``low`` (``Z`` posterior
    deviations below).  Hosts without outcomes keep their parent's mean.
    """
    # A host of the form of a suffix is its own domain; numbers and names alike.
    hosts = with_suffix(saved(hosts, "rep-counts"), suffixes)
    hosts = saved(hosts.withColumn("domain", _domain(F.col("host"), F.col("suffix"))), "rep-hosts")
    top = hosts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m"))
    levels = [("suffix", hosts.groupBy("suffix")), ("domain", hosts.groupBy("domain", "suffix")),
              ("host", hosts.groupBy("host", "domain"))]
    parent = None
    for name, groups in levels:
        rows = groups.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if parent is None:
            rows = rows.crossJoin(F.broadcast(top))                      # one row
        else:
            up = "suffix" if name == "domain" else "domain"
            rows = rows.join(parent.select(up, F.col("rate").alias("m")), up)
        rows = saved(rows, f"rep-{name}")
        s = _strength(rows, "m")
        a = F.col("k") + F.col("s") * F.col("m")
        total = F.col("n") + F.col("s")
        parent = saved(rows.crossJoin(F.broadcast(s))                    # one row
                       .withColumn("rate", a / total)
                       .withColumn("low", F.greatest(F.lit(0.0), a / total - Z * F.sqrt(
                           a * (total - a) / (total * total * (total + 1)))))
                       .select(name, "rate", "low"), f"rep-{name}-post")
    return parent


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE,
          keep=("page_id",), suffixes=SUFFIXES) -> DataFrame:
    """Verdict on every url: ``keep`` columns, ``host``, ``path``, ``rule``, ``verdict``,
    ``rate``, ``low``.

    ``pages``: ``url`` and the ``keep`` columns.  ``outcomes``: ``url`` and ``bad`` (0 or 1;
    null rows do not count).  ``suffixes``: rules in the form of the Public Suffix List.  ``rules``: pairs of host/path prefix and allow or block; a rule
    fits its host and all subdomains if the path starts with its path; the longest wins.
    Without a rule, a host is blocked if the lower posterior bound of its rate of bad pages
    is above ``block_rate``.  Urls that are null or have no ``://`` have an empty host and
    path, are one group of their own and fit no rule.  Repeated rows keep their rows; empty
    tables give an empty result (no outcomes: prior means alone); other columns are ignored.

    Outcomes are summed per host first, so hot hosts shrink before the shuffle; rules are
    joined to distinct hosts by their suffixes.  One join brings both to the pages; the host
    table is written first, so it is broadcast if small and else a hot host is split by
    the adaptive skew join.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    cols = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    rows = pages.select(*cols, host.alias("host"), path.alias("path"))
    seen = outcomes.where("bad is not null").select(host.alias("host"), F.col("bad").cast("long")
                                                    .alias("bad"))
    counts = (rows.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
              .union(seen.select("host", F.lit(1).cast("long"), F.col("bad")))
              .groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    post = reputations(counts, suffixes)
    given = spark.createDataFrame(
        [(r.partition("/")[0], r[r.index("/"):], r, v) for r, v in rules],
        "r_host string, path string, rule string, verdict string")
    parts = F.split(F.col("host"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, i, F.size(parts)), "."))
    fits = (post.select("host", F.explode(ends).alias("r_host")).join(given, "r_host")
            .groupBy("host").agg(F.collect_list(F.struct(
                F.length("rule").alias("size"), "rule", "path", "verdict")).alias("rules")))
    table_ = saved(post.join(fits, "host", "left"), "rep-table")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["path"])))
    return (rows.join(table_, "host").withColumn("best", best)
            .select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "host", "path",
                    F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"),
                               F.when(F.col("low") > block_rate, "block").otherwise("allow"))
                    .alias("verdict"), "rate", "low"))


def op2_url_reputation(spark, sf_dir):
    """The tables hold no outcomes of pages; the label with a page's number stands for
    its outcome (bad: quality 0 or toxic 1)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = pages.select("page_id", "url").join(
        labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id")
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _posterior(level: str, rows: str) -> str:
    """SQL of one level: ``rows`` has the group, n, k and m."""
    return f"""
{level}_s AS (SELECT CASE WHEN rho IS NULL THEN 2.0 WHEN rho > 0 THEN greatest(2.0, least(1000.0, 1 / rho - 1)) ELSE 1000.0 END AS s
  FROM (SELECT (sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * m * (1 - m) * (n - 1)), 0) AS rho
        FROM {rows})),
{level}_p AS (SELECT r.*, (k + s * m) / (n + s) AS rate, s FROM {rows} r, {level}_s)"""


OP2_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k
      FROM h LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
                        FROM labels) l ON l.doc_id = h.page_id GROUP BY host),
d AS (SELECT *, regexp_extract(host, '[^.]*$') AS suffix,
             CASE WHEN length(host) - length(replace(host, '.', '')) < 2 THEN host
                  ELSE regexp_extract(host, '[^.]*[.][^.]*$') END AS domain FROM g),
top AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM d),
a AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM d, top GROUP BY suffix),
""" + _posterior("a", "a") + r""",
b AS (SELECT d.domain, sum(d.n) AS n, sum(d.k) AS k, any_value(a_p.rate) AS m
      FROM d JOIN a_p USING (suffix) GROUP BY d.domain),
""" + _posterior("b", "b") + r""",
c AS (SELECT d.host, d.n, d.k, b_p.rate AS m FROM d JOIN b_p USING (domain)),
""" + _posterior("c", "c") + r""",
v AS (SELECT host, rate - 1.2816 * sqrt((n + s) * rate * (n + s) * (1 - rate)
                                        / ((n + s) * (n + s) * (n + s + 1))) AS low FROM c_p),
rules(r_host, r_path, rule, say) AS (VALUES ('com', '/', 'com/', 'allow'),
  ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
  ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(say, length(rule)) AS say
         FROM h JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
         GROUP BY page_id)
SELECT h.page_id, h.host, h.path, best.rule,
       coalesce(best.say, CASE WHEN v.low > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN v USING (host) LEFT JOIN best USING (page_id)
"""


