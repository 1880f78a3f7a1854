"""URL filters: rules on host and path, carried to aliases through redirects.

A page's URL, its canonical link and its refresh target name the same content.
These pairs are edges; distributed connected components turn them into classes of
aliases. A URL with a rule of its own keeps that rule's verdict. Any other URL
takes its class's: allow if a member is explicitly allowed, else block if a
member is blocked, else allow.

The plan is column expressions and joins. Most pages have no such link, so only
those that do reach the graph, and the answer is joined back by URL key alone.

Defined results: a null URL, or one without ``://``, has empty host and path and
no aliases, so it is allowed; null and empty html hold no links, very long html is
searched whole, a tag whose quotes never end holds none; of rules of one length the
first counts; repeated rows stay; an empty table gives an empty result; other
columns of `pages`, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import attach, connected_components, cut, let


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Aliases with a verdict that are broadcast at most, about 20 MB; more are joined by a shuffle of the URLs.
BROADCAST_URLS = 100_000

#: The rules of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What tells URLs apart in the graph: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^?#]*(\?[^#]*)", 1), F.lit(""))
    return let(F.struct(host_of(url).alias("host"), F.concat(path_of(url), query).alias("rest")), lambda u: F.when(u["host"] != "", F.concat(u["host"], u["rest"])))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), else null.

    Longest in characters of the whole rule; of equally long ones, the first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Tags that name another address of the page, and the address in them.
#: Possessive, as the Java engine takes a stack frame for each turn of a group that it may have to take back.
_TAG = r"""(?is)<(?:link|meta)\b[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH = r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"'\s>]+)"""


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and refresh redirects of every page.

    Relative targets are taken from the page's host, or its folder.
    """
    some = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    some = some.where("url is not null and html rlike '(?i)canonical|http-equiv'")
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    tags = some.select("url", F.explode(F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0))).alias("tag"))
    target = (
        F.when(F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), F.regexp_extract("tag", _HREF, 1))
        .when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", _REFRESH, 1))
    )
    t = F.replace(F.col("t"), F.lit("&amp;"), F.lit("&"))
    scheme, host = F.regexp_extract("url", r"(?s)\A(.*?)://", 1), host_of(F.col("url"))
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)\A(?:.*/)?", 0)
    whole = (
        F.when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(scheme, F.lit("://"), host, t))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), t))
    )
    return tags.select("url", target.alias("t")).where("t <> ''").select("url", whole.alias("target"))


def judge_urls(pages: DataFrame, rules=RULES, links: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, via) of every row of `pages` (page_id, url, html).

    links: (url, target) pairs known otherwise, such as a crawl's redirects; they
    add to those that the pages hold. via: rule, alias or default.
    """
    found = alias_links(pages)
    if links is not None:
        found = found.unionAll(links.select(F.col("url").cast("string"), F.col("target").cast("string")))
    found = cut(found)
    url = F.col("url")
    judged = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    judged = judged.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    if found.isEmpty():
        judged = judged.withColumn("shared", F.lit(None).cast("string"))
    else:
        node = connected_components(found.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b")))
        name = F.concat(F.lit("x://"), F.col("node"))
        node = cut(node.withColumn("own", matching_rule(host_of(name), path_of(name), rules)["verdict"]))
        top = F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1).otherwise(0))
        of_class = node.groupBy("component").agg(top.alias("top"), F.count("*").alias("n")).where("top > 0")
        shared = F.when(F.col("top") == 2, "allow").otherwise("block")
        node = cut(attach(node, of_class, "component", node.count()).select(F.col("node").alias("key"), shared.alias("shared")))
        node = F.broadcast(node) if node.count() <= BROADCAST_URLS else node
        judged = judged.withColumn("key", alias_key(url)).join(node, "key", "left")
    via = F.when(F.col("own").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default")
    verdict = F.coalesce(F.col("own.verdict"), F.col("shared"), F.lit("allow"))
    return judged.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), via.alias("via"))


#: The registered query's rows; aliases are reached by recursion over the same links.
ORACLE_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
    '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
  FROM pages WHERE url IS NOT NULL
), raw AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"''\s>]+)', 1)
  END, '&amp;', '&') AS t
  FROM tags
), links AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?)://', 1) || '://' || regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') || t
    ELSE regexp_extract(url, '^.*?://[^/?#]*') || coalesce(nullif(regexp_extract(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '^.*/'), ''), '/') || t END AS target
  FROM raw WHERE t <> ''
), urls AS (
  SELECT DISTINCT u, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) END AS rest
  FROM (SELECT url AS u FROM pages UNION ALL SELECT target FROM links)
), named AS (
  SELECT u, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1), '') AS query
  FROM urls
), rules(rule, verdict, h, pa) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), fit AS (
  SELECT u, rule, verdict, row_number() OVER (PARTITION BY u ORDER BY length(rule) DESC) AS k
  FROM named, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa)
), node AS (
  SELECT n.u, n.host, n.path, CASE WHEN n.host <> '' THEN n.host || n.path || n.query END AS key, f.rule, f.verdict
  FROM named n LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON n.u IS NOT DISTINCT FROM f.u
), edge AS (
  SELECT DISTINCT a.key AS a, b.key AS b FROM links JOIN node a ON a.u = links.url JOIN node b ON b.u = links.target WHERE a.key <> b.key
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), shared AS (
  SELECT reach.a AS key, max(CASE verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS top
  FROM reach JOIN node ON node.key = reach.b GROUP BY reach.a
)
SELECT p.page_id, p.url, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule,
  coalesce(n.verdict, CASE s.top WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict,
  CASE WHEN n.rule IS NOT NULL THEN 'rule' WHEN s.top > 0 THEN 'alias' ELSE 'default' END AS via
FROM pages p LEFT JOIN node n ON n.u = p.url LEFT JOIN shared s ON s.key = n.key
"""
