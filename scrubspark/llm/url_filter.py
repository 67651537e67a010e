"""URL filter: prefix rules on host and path, and block decisions carried over redirects.

A rule names a host and a path prefix (``example.com/en/``); it fits that host and its subdomains where the
path starts with the prefix, and of the fitting rules the longest decides.  Urls that a redirect or a canonical
link joins are one resource under several names: distributed connected components over those edges give the
equivalence classes, and a class with a url that a rule blocks blocks every alias that no rule names.
An explicit allow stands before that: a url whose own longest rule allows it stays, whatever its aliases are.
An allow is not handed on to aliases.

Edges come from a page's html (``<link rel=canonical>`` and ``<meta http-equiv=refresh>``, outside comments
and scripts) and from a table of observed redirects.  A node is a url without its fragment, scheme and host
in lower case.  All of it is DataFrame expressions and joins; nothing of the edges reaches the driver.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, no rule and no aliases, and is
allowed; a NULL or empty html has no edges; repeated pages keep their rows; a link to itself, a link without a
target and a loop of links change nothing; dot segments of a relative link stay as they are; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import quoted, stored
from scrubspark.llm.graph import components

#: (verdict, rule); a rule is a host, a slash and the rest of the path prefix.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]
#: Comments and scripts of a page; an open one runs to the end.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
#: A value of an attribute: quoted either way, or bare.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _low(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)


def host_of(url: Column) -> Column:
    return _low(F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def ordered_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rules in the order in which the first fitting one decides: longer first, at equal length allow first."""
    return sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of a url, NULL where none fits: one conditional chain over the ordered rules."""
    text = kind = None
    for verdict, rule in ordered_rules(rules):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        text = F.when(fits, F.lit(rule)) if text is None else text.when(fits, F.lit(rule))
        kind = F.when(fits, F.lit(verdict)) if kind is None else kind.when(fits, F.lit(verdict))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, kind)


def node_of(url: Column) -> Column:
    """The node of a url: scheme and host in lower case, no fragment; NULL without a host."""
    whole = r"(?s)\A(.*?://[^/?#]*)([^#]*)"
    return F.when(host_of(url) != "", F.concat(_low(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)))


def resolved(link: Column, base: Column) -> Column:
    """An absolute url for a link found on ``base``; NULL for an empty one."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme, site = F.regexp_extract(base, r"(?s)\A(.*?:)//", 1), F.regexp_extract(base, r"(?s)\A.*?://[^/?#]*", 0)
    folder = F.regexp_extract(path_of(base), r"(?s)\A.*/", 0)
    return (F.when(link == "", F.lit(None).cast("string"))
            .when(F.regexp_like(link, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
            .when(F.startswith(link, F.lit("/")), F.concat(site, link))
            .when(F.startswith(link, F.lit("?")), F.concat(site, path_of(base), link))
            .when(F.startswith(link, F.lit("#")), base)
            .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def _value(tag: Column, name: str) -> Column:
    """The value of attribute ``name`` of a tag, empty without one."""
    pattern = rf"(?is)\s{name}{VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\s[^<>]*>"), F.lit(0))


def link_targets(html: Column) -> Column:
    """The targets, as written, of a page's canonical links and meta refreshes (an array; empty for most pages)."""
    read = F.regexp_replace(html, UNREAD, " ")
    links = F.filter(_tags(read, "link"), lambda t: F.regexp_like(_value(t, "rel"), F.lit(r"(?i)\A(?:.*\s)?canonical(?:\s|\z)")))
    moved = F.filter(_tags(read, "meta"), lambda t: _low(_value(t, "http-equiv")) == "refresh")
    to = F.transform(moved, lambda t: F.regexp_extract(_value(t, "content"), r"""(?is)\A[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    found = F.concat(F.transform(links, lambda t: _value(t, "href")), to)
    return F.when(F.regexp_like(html, F.lit("(?i)canonical|refresh")), found)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the nodes that a page's canonical links and meta refreshes join."""
    found = pages.where(quoted(html).isNotNull()).select(quoted(url).alias("base"), F.explode(link_targets(quoted(html))).alias("link"))
    return found.select(node_of(F.col("base")).alias("a"), node_of(resolved(F.col("link"), F.col("base"))).alias("b"))


def blocked_nodes(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(node): every node whose equivalence class over ``edges`` (a, b) has a url that a rule blocks."""
    joined = components(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    roots = joined.groupBy("root").agg(F.max((own == "block").cast("int")).alias("hit")).where("hit = 1").select("root")
    return stored(joined.join(roots, "root", "left_semi").select("node"), "blocked-urls")


def verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None,
             page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: its id, host, path, rule (NULL without one) and verdict.

    ``redirects`` is a table of observed redirects (from_url, to_url) beside the links in the pages.
    """
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    hit = blocked_nodes(edges, rules).select(F.col("node"), F.lit(True).alias("hit"))
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(quoted(page_id).alias("page_id"), host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path"),
                          node_of(quoted(url)).alias("node"))
    judged = judged.withColumn("rule", rule).withColumn("own", kind)
    passed_on = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(hit, "node", "left").select("page_id", "host", "path", "rule",
                                                   F.coalesce("own", passed_on).alias("verdict"))
