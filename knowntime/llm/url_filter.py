"""URL filters with redirect equivalence: a block decision holds for every alias of the blocked address.

Built-in expressions and joins only. Rules judge host and path; redirects and canonical links join addresses into
components; a page that no rule names takes its component's decision, where an allow rule outweighs a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import saved
from knowntime.llm.components import connected_components

#: The letters whose case is folded in a host.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query (host, path, action).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def address(url: Column) -> Column:
    """The address a server sees, without scheme and fragment: what redirects and links are compared by."""
    plain = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    rest = F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(plain.contains("://"), F.concat(host(plain), rest))


def judged(df: DataFrame, rules: Sequence[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> DataFrame:
    """Add ``rule`` and ``action`` of the longest rule that fits (host itself or a subdomain, path by prefix).

    Of rules equally long, allow wins. ``rules`` is a parameter; it is looked up by each suffix of the host, so its length
    costs nothing per row.
    """
    by_host: dict[str, list] = {}
    for h, p, action in rules:
        by_host.setdefault(h, []).append((h, p, action))
    if not by_host:
        return df.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})

    def entry(h: str, p: str, action: str) -> Column:
        return F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(int(action == "allow")).alias("allow"),
                        F.lit(h + p).alias("rule"), F.lit(p).alias("path"))

    book = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[entry(*r) for r in rs]))])
    deepest = max(h.count(".") + 1 for h in by_host)
    labels = F.split(F.col(host_col), r"\.")
    labels = F.slice(labels, F.greatest(F.size(labels) - deepest + 1, F.lit(1)), deepest)      # no rule has a longer host
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = F.filter(F.flatten(F.transform(ends, lambda e: F.coalesce(F.try_element_at(book, e), F.array().cast(
        "array<struct<size:int,allow:int,rule:string,path:string>>")))), lambda r: F.col(path_col).startswith(r["path"]))
    best = F.array_max(hits)
    return df.withColumn("_best", best).withColumns({
        "rule": F.col("_best.rule"),
        "action": F.when(F.col("_best.allow") == 1, "allow").when(F.col("_best.allow") == 0, "block")}).drop("_best")


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and meta refreshes in the html; relative targets are resolved against the page."""
    canonical = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
    refresh = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
    href = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    content = r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
                    lambda t: t.rlike(canonical) | t.rlike(refresh))
    found = pages.where("html is not null and url is not null").select("url", F.explode(tags).alias("tag"))
    target = F.when(F.col("tag").rlike(canonical), F.regexp_extract("tag", href, 1)).otherwise(F.regexp_extract("tag", content, 1))
    return found.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target"))


def resolved(url: Column, target: Column) -> Column:
    """A link's target as a whole url; null for an empty one."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(url, r"(?s)^(.*?://[^?#]*)", 1), r"(?<![:/])/[^/]*$", "")
    return (F.when(target == "", None).when(target.contains("://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target)).otherwise(F.concat(folder, F.lit("/"), target)))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every page (page_id, url, html): page_id, host, path, rule, verdict and component.

    Edges come from the pages' canonical links and refreshes, and from ``redirects`` (url, target) where a crawl log has
    them. A rule decides first. Else the page is blocked if its component holds a blocked address and no allowed one.
    Null urls, and urls without ``://``, have empty host and path, fit no rule, are in no component and stay allowed.
    Repeated rows are judged alike. Pages with no edge never leave their scan partition but for one outer join.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = saved(edges, "links")                       # the one pass over the html
    edges = saved(edges.withColumn("target", resolved(F.col("url"), F.col("target"))), "links")
    edges = saved(edges.select("url", "target", address(F.col("url")).alias("a"), address(F.col("target")).alias("b")), "links").where("a <> b")
    parts = connected_components(edges)
    ends = edges.select(F.col("url").alias("u"), F.col("a").alias("node")).unionByName(
        edges.select(F.col("target").alias("u"), F.col("b").alias("node")))
    shown = pages.where("url is not null").select(F.col("url").alias("u"), address(F.col("url")).alias("node"))
    members = (shown.join(parts, "node").select("u", "component")
               .unionByName(ends.join(parts, "node").select("u", "component")))
    calls = (judged(members.withColumns({"host": host(F.col("u")), "path": path(F.col("u"))}), rules)
             .groupBy("component").agg(F.max(F.col("action") == "allow").alias("any_allow"),
                                       F.max(F.col("action") == "block").alias("any_block"))
             .withColumn("inherited", F.when(F.coalesce("any_block", F.lit(False)) & ~F.coalesce("any_allow", F.lit(False)), "block").otherwise("allow"))
             .select("component", "inherited"))
    alias = parts.join(calls, "component")
    rows = judged(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                               address(F.col("url")).alias("node")), rules)
    return (rows.join(alias, "node", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("action", "inherited", F.lit("allow")).alias("verdict"), "component"))
