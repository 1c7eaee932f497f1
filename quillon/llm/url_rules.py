"""URL filters: host and path rules, whose block decisions reach aliases over redirects and canonical links.

Every url is a node. An edge joins it with where it redirects to: what a ``refresh`` of its
page names, what its page declares canonical, what a table of observed redirects says, and
the form that sites redirect to by convention (no fragment, no tracking parameters, no
trailing slash or ``.html``, no ``www.``, ``m.`` or default port, and any scheme). Connected
components of these edges, found by joins over a table of edges, are classes of aliases. A url
that a rule names keeps its rule's decision. Any other url is blocked if a url of its class,
whether or not it is in the table, is blocked by a rule and none is allowed by one: an explicit
allow takes precedence. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.session import discard, stage

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none. Equal lengths: the longer host, then allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def usual_form(url: Column) -> Column:
    """The form that sites redirect a url to by convention; null where it has no ``://`` or no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.([^.]+\.)", "$2"), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/(index\.html?)?$", ""), r"\.html?$", "")
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(asked, "&"), lambda x: ~x.rlike("^(utm_[a-z]*|ref)(=|$)") & (x != "")), "&")
    out = F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", out)


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, value, k) for k in (1, 2, 3)))


def absolute(base: Column, link: Column) -> Column:
    """``link`` as found in a page at ``base``; null if it is empty or of another scheme than http."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(origin, F.regexp_replace(path_of(base), "[^/]*$", ""))
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), link))
        .when((link == "") | link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), F.lit(None))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def page_links(url: Column, html: Column) -> Column:
    """array<string>: absolute targets of a page's canonical links and refreshes."""
    links = F.filter(F.regexp_extract_all(html, F.lit(_LINK), 0), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(_META), 0), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    to = F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"]*)""", 1))
    found = F.concat(F.transform(links, lambda t: _attribute(t, "href")), to)
    # most pages have no such tag: one search tells
    hit = F.when(html.rlike(r"(?is)<(link|meta)\b[^>]*(canonical|refresh)"), found).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(hit, lambda x: absolute(url, x)), lambda x: x.isNotNull())


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct (u, v), u <> v: from each url, and each target of a link, to where it leads."""
    leads = F.concat(page_links(F.col("url"), F.coalesce("html", F.lit(""))), F.array(F.lit(None).cast("string")))
    seen = pages.where(F.col("url").isNotNull()).select(F.col("url").alias("u"), F.explode(leads).alias("v"))
    if redirects is not None:
        seen = seen.unionByName(redirects.select(F.col("from_url").alias("u"), F.col("to_url").alias("v")))
    ends = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    u, v = F.col("u"), F.col("v")
    each = F.explode(F.array(ends(u, v), ends(u, usual_form(u)), ends(v, usual_form(v)))).alias("e")
    return seen.distinct().select(each).select("e.u", "e.v").where("u <> v").distinct()


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages(url, html)``.

    A null url, or one without ``://``, has empty host and path, no rule and no aliases but those that a link
    names; it is allowed. A null html has no links. Rows that repeat an id or url are judged each. An empty table
    gives an empty result; other columns are not read. A url that leads to itself is no edge, and circles are classes as any other.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col("url").alias("_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    edges = stage(alias_edges(pages, redirects))
    classes = components(edges)
    judged = classes.withColumn("verdict", rule_of(host_of(F.col("id")), path_of(F.col("id")), rules)["verdict"])
    is_ = lambda what: F.max(F.coalesce((F.col("verdict") == what).cast("int"), F.lit(0))) == 1
    blocked = judged.groupBy("component").agg(is_("block").alias("b"), is_("allow").alias("a")).where("b AND NOT a").select("component")
    aliases = stage(judged.where("verdict IS NULL").join(blocked, "component").select(F.col("id").alias("_url"), F.lit(True).alias("_alias")))
    discard(edges)
    out = rows.join(aliases, "_url", "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_alias"), "block"), F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


_FORM = r"""CASE WHEN regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1) <> '' THEN 'https://'
  || regexp_replace(regexp_replace(translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.([^.]+\.)', '\2'), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/(index\.html?)?$', ''), '\.html?$', '')
  || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({0}, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref)(=|$)')), '&'), ''), '') END"""
#: For tables whose pages hold no links: each class is then the urls that end in one usual form.
ORACLE = rf"""
WITH RECURSIVE chain AS (
  SELECT DISTINCT url, url AS here, 0 AS step FROM pages WHERE url IS NOT NULL
  UNION SELECT url, {_FORM.format("here")}, step + 1 FROM chain WHERE {_FORM.format("here")} <> here),
nodes AS (SELECT DISTINCT last(here ORDER BY step) OVER (PARTITION BY url ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS class, here AS url FROM chain),
parts AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url FROM nodes UNION SELECT url FROM pages)),
ruled AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled),
blocked AS (SELECT class FROM nodes JOIN judged USING (url) GROUP BY class HAVING bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false))),
alias AS (SELECT DISTINCT url FROM nodes JOIN blocked USING (class))
SELECT page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule, coalesce(j.verdict, CASE WHEN alias.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN judged j ON j.url = pages.url LEFT JOIN alias ON alias.url = pages.url
"""
