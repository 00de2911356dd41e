"""URL filtering with redirect equivalence (DataFrame operations only).

Rules name a host and the start of a path, and allow or block. A page that a
rule fits gets the rule's verdict. Every other page belongs to a class of
aliases, the connected component of its address over redirect and
canonical-link edges, and is blocked if its class holds an address that a rule
blocks and none that a rule allows; otherwise it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.graph import connected_components
from foliant.llm.storage import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def host(url: Column) -> Column:
    """What stands behind the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What stands behind the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of two as long, one that allows wins.

    rules: (verdict, "host/path"). A rule fits its host and all subdomains if
    the path starts with the rule's. Hosts are looked up in a map literal, by
    each of the host's suffixes, so the cost doesn't grow with the rules.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((slash + rest, verdict, rule))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    # of two rules of one length the one that allows is the greater
    own = lambda x: F.struct(F.lit(len(x[2])).alias("size"), F.lit(x[1] == "allow").alias("allows"), F.lit(x[0]).alias("start"), F.lit(x[1]).alias("verdict"), F.lit(x[2]).alias("rule"))
    table = F.create_map(*(c for name, each in by_host.items() for c in (F.lit(name), F.array(*map(own, each)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<struct<size:int,allows:boolean,start:string,verdict:string,rule:string>>"))))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["start"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def address(url: Column) -> Column:
    """The form of a URL by which aliases are compared: without scheme, fragment and default port, host lower-cased, path / if empty; null without a host."""
    name = F.regexp_replace(host(url), r":(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(name != "", F.concat(name, F.when(path(url) == "", F.lit("/")).otherwise(path(url)), query))


def absolute(target: Column, base: Column) -> Column:
    """A link's target as a URL with host; one relative to a folder is taken from the base's folder."""
    root = F.concat(F.lit("http://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, target))
        .when(target != "", F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a, b: addresses of pages and of what their canonical link or refresh points to."""
    page = pages.select(F.col(url).alias("u"), F.array(F.regexp_extract(html, _LINK, 1), F.regexp_extract(html, _REFRESH, 1)).alias("to"))
    edges = page.select("u", F.explode("to").alias("t")).where("t <> ''")
    return edges.select(address(F.col("u")).alias("a"), address(absolute(F.col("t"), F.col("u"))).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """pages without html, with host, path, rule and verdict (allow or block).

    redirects: further edges from_url, to_url, as a crawl log has them. Null
    URLs and ones without :// have an empty host and path, fit no rule and are
    allowed. URLs and HTML of any length are read whole. Repeated rows stay,
    each with the same verdict; columns of the added names are replaced. Only
    addresses with edges are shuffled, and classes without a blocked address
    fall away before pages are looked up in them.
    """
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        more = redirects.select(address(F.col("from_url")).alias("a"), address(absolute(F.col("to_url"), F.col("from_url"))).alias("b"))
        edges = edges.union(more.where("a is not null and b is not null and a <> b")).distinct()
    edges = cut(edges, "aliases")
    out = pages.drop(html, "host", "path", "rule", "verdict").withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    out = out.withColumn("_match", match(F.col("host"), F.col("path"), rules))
    own = [F.col("_match.rule").alias("rule"), F.col("_match.verdict")]
    if edges.isEmpty():
        return out.select("*", own[0], F.coalesce(own[1], F.lit("allow")).alias("verdict")).drop("_match")
    classes = connected_components(edges, "a", "b")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    judged = classes.withColumn("verdict", match(host(as_url), path(as_url), rules)["verdict"])
    bad = judged.groupBy("component").agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    bad = bad.where("block and not coalesce(allow, false)").select("component")
    blocked = cut(classes.join(bad, "component").select(F.col("node").alias("_node")).distinct(), "blocked")
    out = out.withColumn("_address", address(F.col(url))).join(blocked, F.col("_address") == F.col("_node"), "left")
    verdict = F.coalesce(own[1], F.when(F.col("_node").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("*", own[0], verdict.alias("verdict")).drop("_match", "_address", "_node")
