"""URL filters: rules first, then propagation over the host link graph, in DataFrame operations only.

Rules (host, path prefix) judge a url when they fit; the longest fitting rule wins (of equally
long ones a blocking rule, then the smaller in code-point order). Every other url takes its host's
verdict. Trust is personalised PageRank from the hosts whose pages rules allow; distrust is the
same walk over reversed links from hosts whose pages rules block. A host is blocked when its
share distrust / (trust + distrust) is above a threshold; a host that neither reaches is allowed. The
walks go on until no block of steps reaches a further host or changes a host's mass by more than a small share of it,
so a chain of links counts in whole. (Masses below 1e-300, some 4,200 links away, count as none.) What a mass then lacks
is less than that share, so that a verdict is exact unless trust and distrust differ by less.

Defined cases: a null url, or one without ``://``, has empty host and path; null or broken html has
no links; links to the page's own host, relative links and repeated links from one host count once
or not at all; empty hosts take no part in the graph; no rows in, no rows out.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, TOLERANCE, THRESHOLD, BLOCK_STEPS = 0.85, 1e-6, 0.5, 8
STEPS = 10  #: of the SQL form only, which cannot ask whether the walks have settled
HREF = r"""(?i)[\s"'/]href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _lower(x: Column) -> Column:
    return F.translate(x, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest fitting rule, else null. ``rules`` is a bounded literal list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):  # the last one set is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def walk(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, block: int = BLOCK_STEPS) -> DataFrame:
    """Personalised PageRank of every kind at once: ``seeds`` (kind, host, seed), ``edges`` (kind, src, dst) distinct -> (kind, host, mass).

    Every step joins masses with weighted edges on the source host and sums by target with partial aggregation; a
    block of steps is one checkpoint, so that plans stay short and lost executors cost a block. Masses only grow from the
    seeds' own; the walk ends when no host has grown by more than ``tolerance`` of its mass within a block.
    """
    out_degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = materialise(edges.join(materialise(out_degree), ["kind", "src"]))
    base = seeds.where("seed > 0").select("kind", "host", (F.col("seed") * (1 - damping)).alias("mass"))
    old = base
    while True:
        mass = old
        for n in range(block):
            moved = weighted.join(mass.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * damping / F.col("degree")).alias("mass"))
            mass = base.unionByName(moved)
            if n + 1 < block:
                mass = mass.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        both = mass.withColumn("was", F.lit(0.0)).unionByName(old.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("was")))
        both = materialise(both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was")))
        old = both.select("kind", "host", "mass")
        if both.where(F.abs(F.col("mass") - F.col("was")) > F.col("mass") * tolerance + 1e-300).isEmpty():
            return old


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", html: str = "html", tolerance: float = TOLERANCE, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    The html is read once, for its links' hosts; all further steps move hosts and edges only.
    """
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: host_of(F.regexp_replace(x, "^[^/]*//", "x://"))))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), links.alias("links"))
    parsed = materialise(parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)))
    edges = parsed.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select("src", "dst")
    edges = materialise(edges)
    share = lambda v: F.avg(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = materialise(parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    kinds = lambda t, d: F.explode(F.array(F.struct(F.lit("trust").alias("kind"), *t), F.struct(F.lit("distrust").alias("kind"), *d))).alias("x")
    both_seeds = seeds.select("host", kinds([F.col("allow").alias("seed")], [F.col("block").alias("seed")])).select("x.kind", "host", "x.seed")
    both_ways = edges.select(kinds([F.col("src"), F.col("dst")], [F.col("dst").alias("src"), F.col("src").alias("dst")])).select("x.*")
    mass = walk(both_seeds, both_ways, tolerance, damping)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0))
    bad = mass.groupBy("host").agg(of("trust").alias("t"), of("distrust").alias("b")).where(F.col("b") > (F.col("t") + F.col("b")) * threshold).select("host", F.lit(True).alias("bad"))
    by_host = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.drop("links").join(materialise(bad), "host", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_host).alias("verdict")
    )


def oracle(steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, with one pair of common table expressions for each step."""
    fits = " ".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{p}') THEN '{v} {n}/{p}'"
        for v, r in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
        for n, _, p in [r.partition("/")]
    )
    sql = rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE {fits} END AS fit FROM p),
e AS (SELECT DISTINCT host AS src, translate(regexp_extract(x, '//([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS dst
      FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)[\s"''/]href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS x FROM p)),
g AS (SELECT * FROM e WHERE src <> dst AND src <> '' AND dst <> ''),
go AS (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM g),
gi AS (SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY dst) AS deg FROM g),
s AS (SELECT host, avg(CASE WHEN fit LIKE 'allow%' THEN 1.0 ELSE 0.0 END) * {1 - damping} AS t, avg(CASE WHEN fit LIKE 'block%' THEN 1.0 ELSE 0.0 END) * {1 - damping} AS b FROM f WHERE host <> '' GROUP BY host),
t0 AS (SELECT host, t AS m FROM s WHERE t > 0), b0 AS (SELECT host, b AS m FROM s WHERE b > 0)"""
    for i in range(steps):
        for x, edges in (("t", "go"), ("b", "gi")):
            sql += f",\n{x}{i + 1} AS (SELECT host, sum(m) AS m FROM (SELECT host, m FROM {x}0 UNION ALL SELECT dst, m * {damping} / deg FROM {edges} JOIN {x}{i} ON src = host) GROUP BY host)"
    return (
        sql
        + f""",
bad AS (SELECT host FROM (SELECT host, m AS t, 0 AS b FROM t{steps} UNION ALL SELECT host, 0, m FROM b{steps}) GROUP BY host HAVING sum(b) > (sum(t) + sum(b)) * {threshold})
SELECT page_id, host, path, nullif(substr(fit, 7), '') AS rule,
       coalesce(substr(fit, 1, 5), CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
    )
