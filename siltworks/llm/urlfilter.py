"""URL filters: pattern rules indexed by their rarest literal token. DataFrame operations only.

* Every URL is cut into its distinct tokens (runs of ASCII letters and digits, lower-cased).
* Token counts over all URLs say which of a rule's literal tokens is the rarest; the rule is indexed by it.
* URL tokens fetch the rules of the index, and only those are run: a regular expression for pattern rules, host and
  path tests for domain rules. Rules without a literal token are run on every URL.

The longest domain rule that fits decides; without one, a URL that a pattern rule fits is blocked, else allowed.

Results in odd cases: a null URL or one without ``://`` has an empty host and path, no rule and the verdict allow. Equal
URLs get equal results, one row for each page. An empty table gives no rows, an empty rule list no rule. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import cut, maybe_broadcast

#: Domain rules as (verdict, host, path).
DOMAIN_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-cased URL, and the whole tokens that any URL it fits must hold."""

    regex: str
    tokens: tuple[str, ...]


#: The method's own rules: advertising, tracking, adult and session pages, and addresses of machines.
PATTERN_RULES = (
    Pattern(r"[/.]ads?[/.?]", ()),
    Pattern(r"[/._-]doubleclick[/._-]", ("doubleclick",)),
    Pattern(r"[?&]utm_source=", ("utm", "source")),
    Pattern(r"[?&]sessionid=", ("sessionid",)),
    Pattern(r"/wp-login\.php", ("wp", "login", "php")),
    Pattern(r"/cgi-bin/", ("cgi", "bin")),
    Pattern(r"[/.]porn[/.]", ("porn",)),
    Pattern(r"[/.]casino[/.]", ("casino",)),
    Pattern(r"[?&]page=[0-9]{3,}", ("page",)),
    Pattern(r"[?&]ref=x.*[?&]ref=x", ("ref", "x")),
    Pattern(r"^[a-z]+://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[:/]", ()),
)

_TOKEN = r"[a-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased."""
    return F.translate(_host(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(ascii_lower, F.lit(_TOKEN), F.lit(0)))


def rules(spark: SparkSession, domains: Sequence[tuple[str, str, str]], patterns: Sequence[Pattern]) -> DataFrame:
    """(rule_id, kind, verdict, host, path, regex, tokens). The tokens of a domain rule are those of its host: a path prefix may end within one."""
    from re import findall

    rows = [(i, "domain", v, h, p, None, findall(_TOKEN, h)) for i, (v, h, p) in enumerate(domains)]
    rows += [(len(rows) + i, "pattern", "block", None, None, x.regex, list(x.tokens)) for i, x in enumerate(patterns)]
    schema = "rule_id long, kind string, verdict string, host string, path string, regex string, tokens array<string>"
    return spark.createDataFrame(rows, schema)


def indexed(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """The rules with ``token``, their rarest by ``counts`` (token, n); rules whose rarest token no URL has fit none and go."""
    each = listed.select("*", F.explode_outer("tokens").alias("token"))
    met = each.join(counts, "token", "left").withColumn("n", F.when(F.col("token").isNotNull(), F.coalesce("n", F.lit(0))))
    rarest = met.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("least"))
    return listed.join(rarest, "rule_id").where("least.n is null or least.n > 0").select(*listed.columns, F.col("least.token").alias("token"))


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url)."""
    # equal URLs are judged once
    urls = pages.select("url").where("url is not null").distinct()
    urls = cut(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _tokens(F.col("url")).alias("tokens")))
    words = urls.select("url", F.explode("tokens").alias("token"))
    wanted = cut(listed.select(F.explode("tokens").alias("token")).distinct())
    wanted = maybe_broadcast(wanted, wanted.count())
    counts = words.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = cut(indexed(listed, counts))
    n = index.count()
    own = index.select("token", "rule_id", "kind", "verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"), "regex")
    body = urls.select("url", "host", "path", F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("token"))
    # only tokens that index a rule go on; the null token stands for rules without one
    candidates = body.join(maybe_broadcast(own, n), body["token"].eqNullSafe(own["token"]))
    fits_host = (F.col("host") == F.col("r_host")) | F.endswith("host", F.concat(F.lit("."), "r_host"))
    domain = (F.col("kind") == "domain") & fits_host & F.startswith("path", F.col("r_path"))
    lowered = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = (F.col("kind") == "pattern") & F.rlike(lowered, F.col("regex")) & (F.col("host") != "")
    name = F.concat("r_host", "r_path")
    best = F.max(F.when(domain, F.struct(F.length(name).alias("n"), name.alias("rule"), "verdict"))).alias("best")
    told = candidates.where(F.when(F.col("kind") == "domain", domain).otherwise(pattern)).groupBy("url").agg(best, F.bool_or(pattern).alias("hit"))
    told = told.select(F.col("url").alias("_url"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("hit"), "block")).alias("verdict"))
    return pages.select("page_id", "url").join(told, F.col("url") == F.col("_url"), "left").select(
        "page_id",
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def oracle_sql(domains: Sequence[tuple[str, str, str]] = DOMAIN_RULES, patterns: Sequence[Pattern] = PATTERN_RULES) -> str:
    """The same rows by DuckDB: every rule on every URL."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in domains)
    regexes = ", ".join(f"('{x.regex}')" for x in patterns)
    return rf"""
WITH rules(verdict, r_host, r_path) AS (VALUES {listed}),
patterns(regex) AS (VALUES {regexes}),
rest AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id),
hits AS (SELECT DISTINCT page_id FROM parts JOIN patterns ON regexp_matches(url, regex) WHERE host <> '')
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN h.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN hits h USING (page_id)
"""
