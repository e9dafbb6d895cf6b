"""URL filters by host-suffix and path-prefix expressions.

A rule is an expression ``host-suffix/path-prefix`` such as ``spam.example.com/`` or
``example.com/ads/`` with an action, ``block`` or ``allow``. Each URL is expanded into every
combination of its host suffixes (at least two labels; the whole host always counts) and its path
prefixes (every directory, the whole path, the path with its query). Expressions meet rules in an
equi-join on the first 4 bytes of their SHA-256; the full digest confirms. Suffixes of more labels and directories deeper than
any rule's are not made, as no rule can be among them, so that long URLs cost no more than the rules ask for. Of the rules that hold, the one with the longest host wins, then the longest path, then ``allow`` before ``block``.

Defined cases: a null, empty or hostless URL gets the action ``invalid`` and is not kept; a URL
without a matching rule is allowed; repeated rows each get their verdict; tied rules fall to
``allow``, then to the expression that sorts first; an empty rule table allows every valid URL;
null rules are ignored; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.measures import let
from affinis.llm.common import col, table

BLOCKED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DEFAULT_RULES = [(f"{name}.example.{top}/", "block") for name in BLOCKED for top in ("com", "net", "org")] + [
    # Parts of blocked hosts that are allowed, and parts of those that aren't.
    ("casino-win.example.com/en/", "allow"), ("www.free-bets.example.com/", "allow"), ("www.free-bets.example.com/de/", "block"), ("m.spam-farm.example.org/fr/", "allow"),
    # Parts of every host, but of some.
    ("example.net/es/", "block"), ("blog.example.net/es/", "allow"), ("example.org/de/", "block"), ("example.com/en/404.html", "block"),
    # A tie.
    ("ads-track.example.net/de/", "block"), ("ads-track.example.net/de/", "allow"),
]

#: More labels or directories than any URL has.
MANY = 1 << 20
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*([?][^#]*)"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "expression string, action string")


def host_suffixes(host: Column, labels_most: int = MANY) -> Column:
    """From the longest of at most so many labels."""

    def cut(labels: Column) -> Column:
        n = F.size(labels)
        last = F.when(host.rlike(r"^[0-9.]+$"), F.lit(1)).otherwise(F.greatest(n - 1, F.lit(1)))
        first = F.least(last, F.greatest(n - labels_most + 1, F.lit(1)))
        return F.transform(F.sequence(first, last), lambda i: F.array_join(F.slice(labels, i, n), "."))

    return let(F.split(host, r"\."), cut)


def path_prefixes(path: Column, query: Column, depth: int = MANY) -> Column:
    """Directories of at most this depth (1: the root), the path, and the path with its query."""
    folders = let(F.split(path, "/"), lambda p: F.transform(F.sequence(F.lit(1), F.least(F.size(p) - 1, F.lit(depth))), lambda i: F.concat(F.array_join(F.slice(p, F.lit(1), i), "/"), F.lit("/"))))
    return F.array_distinct(F.concat(folders, F.array(path, F.concat(path, query))))


def url_expressions(url: Column, labels_most: int = MANY, depth: int = MANY) -> Column:
    """All expressions of a URL that a rule with at most so many labels and directories can equal; null where it has no host."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"[.]+$", ""))
    path = F.regexp_extract(url, PATH, 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(url, QUERY, 1)
    pairs = let(path_prefixes(path, query, depth), lambda prefixes: F.transform(host_suffixes(host, labels_most), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(host != "", F.flatten(pairs))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: the id, the URL, ``action``, the winning ``rule`` and ``kept``."""
    digest = lambda c: F.sha2(c, 256)
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"))
    known = (
        rules.select("expression", "action")
        .where(F.col("expression").isNotNull() & F.col("action").isin("block", "allow"))
        .distinct()
        .withColumn("full", digest(F.col("expression")))
        .select("expression", "action", F.col("full").alias("rule_full"), F.substring("full", 1, 8).alias("short"))
    )
    host = F.substring_index("expression", "/", 1)
    most = known.agg(F.max(F.size(F.split(host, r"\."))).alias("labels"), F.max(F.regexp_count("expression", F.lit("/"))).alias("depth")).first()  # one row
    expanded = (
        rows.select("url").where(F.col("url").isNotNull())
        .select("url", F.explode(url_expressions(F.col("url"), max(2, most["labels"] or 0), most["depth"] or 1)).alias("e"))
        .select("url", digest(F.col("e")).alias("full"))
        .withColumn("short", F.substring("full", 1, 8))
    )
    hits = expanded.join(known, "short").where(F.col("full") == F.col("rule_full"))
    order = F.struct(-F.length(host), -F.length("expression"), (F.col("action") == "block").cast("int"), F.col("expression"))
    verdicts = hits.groupBy("url").agg(F.min_by(F.struct("action", "expression"), order).alias("hit")).select(F.col("url").alias("hit_url"), "hit")
    valid = F.coalesce(F.regexp_replace(F.regexp_extract("url", HOST, 1), r"[.]+$", "") != "", F.lit(False))
    action = F.when(~valid, F.lit("invalid")).otherwise(F.coalesce("hit.action", F.lit("allow")))
    return rows.join(verdicts, F.col("url") == F.col("hit_url"), "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), action.alias("action"), F.col("hit.expression").alias("rule"), (action == "allow").alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), default_rules(spark))


SQL = f"""
WITH rules(expression, action) AS (VALUES {", ".join(f"('{e}', '{a}')" for e, a in DEFAULT_RULES)}),
parts AS (
  SELECT DISTINCT url, lower(regexp_replace(regexp_extract(url, '{HOST}', 1), '[.]+$', '')) AS host,
    CASE WHEN regexp_extract(url, '{PATH}', 1) = '' THEN '/' ELSE regexp_extract(url, '{PATH}', 1) END AS path,
    regexp_extract(url, '{QUERY}', 1) AS q
  FROM pages WHERE url IS NOT NULL),
hosts AS (
  SELECT url, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS h
  FROM parts, unnest(generate_series(1, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 1 ELSE greatest(len(string_split(host, '.')) - 1, 1) END)) AS s(i)
  WHERE host <> ''),
paths AS (
  SELECT url, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/' AS p
  FROM parts, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS s(i)
  UNION SELECT url, path FROM parts UNION SELECT url, path || q FROM parts),
hits AS (
  SELECT h.url, r.action, r.expression, row_number() OVER (PARTITION BY h.url
    ORDER BY length(split_part(r.expression, '/', 1)) DESC, length(r.expression) DESC, r.action = 'block', r.expression) AS n
  FROM hosts h JOIN paths p ON h.url = p.url JOIN rules r ON r.expression = h.h || p.p)
SELECT g.page_id, g.url, CASE WHEN a.host IS NULL OR a.host = '' THEN 'invalid' ELSE coalesce(h.action, 'allow') END AS action,
  h.expression AS rule, CASE WHEN a.host IS NULL OR a.host = '' THEN false ELSE coalesce(h.action, 'allow') = 'allow' END AS kept
FROM pages g LEFT JOIN parts a ON a.url = g.url LEFT JOIN hits h ON h.url = g.url AND h.n = 1
"""
