"""Operator 1. URL rules whose block decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .components import components

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null. Rules are a short list of the caller's."""
    c = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        c = (F.when if c is None else c.when)(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    return none if c is None else c.otherwise(none)


def key_of(url: Column) -> Column:
    """A url's node: host, path and query, without scheme and fragment; null without a host."""
    key = F.concat(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))
    return F.when(_rest(url).rlike(r"^[^/?#]"), key)


def resolved(link: Column, host: Column, path: Column) -> Column:
    """A link as a whole url, seen from a page; null for links to other schemes and for empty ones."""
    site = F.concat(F.lit("http://"), host)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == "") | F.startswith(link, F.lit("#")), F.lit(None))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path, link))
        .otherwise(F.concat(site, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), link))
    )


#: The value of an attribute, quoted or not, in a tag that some other attribute picks out.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page's url and of each canonical link and refresh redirect in its html.

    Comments are left out. Null urls and pages give no edge.
    """
    some = pages.where(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    d = some.select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    first = lambda c, pattern: F.concat(*[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)])
    content = first(F.col("tag"), r"(?i)\bcontent" + _VALUE)
    link = F.when(
        F.col("tag").rlike(r"""(?i)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), first(F.col("tag"), r"(?i)\bhref" + _VALUE)
    ).when(F.col("tag").rlike(r"""(?i)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(content, r"""(?i)url\s*=\s*['"]?([^'"]*)""", 1))
    # explode() keeps filters above from being copied into the long expressions below
    own = [key_of(F.col("url")).alias("a"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    d = d.select(*own, F.explode(F.array(F.trim(F.replace(link, F.lit("&amp;"), F.lit("&"))))).alias("link"))
    d = d.select("a", F.explode(F.array(resolved(F.col("link"), F.col("host"), F.col("path")))).alias("to"))
    return d.select("a", F.explode(F.array(key_of(F.col("to")))).alias("b"))


def judged(pages: DataFrame, edges: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule (null if none) and verdict (allow or block).

    edges (a, b) say that two nodes (key_of) are the same page: redirects, canonical links. A page with
    a rule of its own keeps the rule's verdict. Any other takes that of its component: block if a member
    has a block rule and none an allow rule, else allow. Members that are only link targets count.

    Null urls and urls without :// have an empty host and path, no rule and the verdict allow. Repeated
    rows are judged alike; empty tables give empty ones. Input columns of the four names are replaced.
    Components are found by distributed rounds on the edges alone; a component's verdict is one
    aggregate, and pages meet it by their node, so no group is ever collected.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    d = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), key_of(F.col(url)).alias("_gl_key"))
    d = d.withColumn("_gl_own", rule_of(F.col("host"), F.col("path"), rules))
    d = d.select(*keep, "host", "path", "_gl_key", F.col("_gl_own.rule").alias("rule"), F.col("_gl_own.verdict").alias("_gl_verdict"))
    own = F.coalesce("_gl_verdict", F.lit("allow")).alias("verdict")
    # pages without a link in either direction, most of them, have nothing to look up
    nodes = components(edges, "url-components")
    if nodes.isEmpty():
        return d.select(*keep, "host", "path", "rule", own)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    nodes = nodes.withColumn("own", rule_of(host_of(as_url), path_of(as_url), rules)["verdict"])
    verdicts = nodes.groupBy("root").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
    verdicts = verdicts.where("blocked AND NOT coalesce(allowed, false)").select("root")
    blocked = written(nodes.join(verdicts, "root").where("own IS NULL").select(F.col("node").alias("_gl_key"), F.lit("block").alias("_gl_spread")), "url-blocked")
    # both sides are plain exchanges, so a node that very many pages share is split by the adaptive plan
    d = d.join(blocked, "_gl_key", "left")
    return d.select(*keep, "host", "path", "rule", F.coalesce("_gl_verdict", "_gl_spread", F.lit("allow")).alias("verdict"))


def op1_redirect_equivalence(spark, sf_dir: str) -> DataFrame:
    """Verdicts of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages.select("page_id", "url"), page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")

#: The same rows in DuckDB: links of both kinds, then components by reachability.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p
),
k AS (SELECT *, CASE WHEN host <> '' THEN host || tail END AS node FROM h),
t AS (SELECT node, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM k WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
l AS (
  SELECT node, host, path, replace(trim(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN trim(regexp_extract(tag, '(?is)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)url\s*=\s*[''"]?([^''">]*)', 1) END), '&amp;', '&') AS link FROM t
),
a AS (
  SELECT node, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN substr(link, instr(link, '://') + 3) WHEN link LIKE '//%' THEN substr(link, 3)
    WHEN link = '' OR link LIKE '#%' OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN link LIKE '/%' THEN host || link WHEN link LIKE '?%' THEN host || path || link
    ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS rest FROM l WHERE link IS NOT NULL
),
e AS (
  SELECT node AS x, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS y
  FROM a WHERE node IS NOT NULL AND regexp_matches(rest, '^[^/?#]')
),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
near AS (SELECT x, x AS y FROM b UNION SELECT near.x, b.y FROM near JOIN b ON near.y = b.x),
n AS (SELECT DISTINCT x AS node, regexp_extract(x, '^[^/?#]*') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
o AS (SELECT node, host, path FROM n UNION SELECT node, host, path FROM k WHERE node IS NOT NULL),
rules AS (
  SELECT *, split_part(rule, '/', 1) AS own, substr(rule, instr(rule, '/')) AS start
  FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) AS v(verdict, rule)
),
f AS (SELECT node, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule FROM o JOIN rules ON (host = own OR suffix(host, '.' || own)) AND starts_with(path, start) GROUP BY node),
s AS (SELECT near.x AS node FROM near JOIN f ON f.node = near.y GROUP BY near.x HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
SELECT page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN s.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM k LEFT JOIN f ON f.node = k.node LEFT JOIN s ON s.node = k.node
"""
