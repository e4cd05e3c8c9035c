"""URL filter: host-suffix / path-prefix expressions matched by hash prefix.

Every URL is expanded into ``host-suffix + path-prefix`` expressions. Short
hash prefixes of the expressions are equi-joined with those of the rules, full
digests confirm a match, and the longest matching rule decides. Native
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, literal_rows

#: Hex characters of the digest that the equi-join uses (4 bytes).
PREFIX_HEX = 8
#: Rules up to this many bytes may be broadcast by Spark; a larger list is
#: replicated over SALTS so that no host's rows meet in one task.
BROADCAST_BYTES = 8 << 20
SALTS = 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to / ? # or the end,
    A-Z lower-cased; path from there up to ? or #. No ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _digest(expr: Column) -> Column:
    return F.sha2(expr.cast("binary"), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with expression, digest and join key.

    Null hosts, paths or verdicts drop the rule. Of equal expressions one
    stays: ``block`` wins over ``allow``.
    """
    return (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("rule", F.concat("r_host", "r_path"))
        # the separator keeps host "a" + path "b/" apart from host "ab"
        .withColumn("digest", _digest(F.concat_ws("\n", "r_host", "r_path")))
        .withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the URL's path starts with the
    rule's path; the longest ``host + path`` wins. Without a fitting rule,
    ``rule`` is null and ``verdict`` is ``default``. Null or scheme-less URLs
    have empty host and path and fit no rule unless one has an empty host.
    Repeated rows each give a row; other columns of ``pages`` are ignored. An
    empty rule table leaves every verdict at ``default``.
    """
    spark = pages.sparkSession
    ready = prepare_rules(rules)
    # Only as deep as some rule reaches: a few numbers about the rule list.
    depth = ready.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.length("r_path") - F.length(F.replace("r_path", F.lit("/")))).alias("slashes"),
        F.sum(F.length("rule") + 80).alias("bytes"),
        F.collect_set(F.when(~F.endswith("r_path", F.lit("/")), F.length("r_path"))).alias("odd"),
    ).first()
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if depth["labels"] is None:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(depth["labels"]))),
        lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."),
    )
    parts = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth["slashes"] or 0))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))
        ),
    )
    # Rules that end inside a segment are met at their own lengths.
    odd = [x for x in depth["odd"] if x]
    if odd:
        cuts = F.filter(F.array(*map(F.lit, odd)), lambda k: k <= F.length("path"))
        prefixes = F.array_union(prefixes, F.transform(cuts, lambda k: F.substring(F.col("path"), F.lit(1), k)))
    # One row for each distinct (host, path): a hot site is looked up once.
    asked = urls.select("host", "path").distinct()
    expressions = (
        asked.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", F.concat_ws("\n", "suffix", "prefix").alias("expr"))
        .withColumn("full", _digest(F.col("expr")))
        .withColumn("key", F.substring("full", 1, PREFIX_HEX))
    )
    if depth["bytes"] <= BROADCAST_BYTES:
        hits = expressions.join(F.broadcast(ready), "key")
    else:
        salted = ready.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        hits = spread.join(salted, ["key", "salt"])
    best = (
        hits.where("full = digest")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "r_verdict"), F.struct(F.length("rule"), F.length("r_host"), "rule")).alias("won"))
    )
    # A hot host has many paths, so (host, path) spreads it; URLs without either
    # may be many, and look at one row.
    bare = (F.col("host") == "") & (F.col("path") == "")
    met = urls.where(~bare).join(best.where(~bare), ["host", "path"], "left")
    return met.unionByName(urls.where(bare).join(F.broadcast(best.where(bare)), ["host", "path"], "left")).select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.r_verdict", F.lit(default)).alias("verdict"),
    )


#: Fixed values of the query's contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_frame(spark) -> DataFrame:
    return literal_rows(spark, RULES, "host", "path", "verdict")


ORACLE_SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rests),
fits AS (
  SELECT u.n, u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC) AS k
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
