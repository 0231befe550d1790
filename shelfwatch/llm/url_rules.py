"""URL verdicts by host and path rules, spread over redirects and canonical links.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule wins.  Urls that redirect to each other, or name each other
as canonical, form one component (``components`` rounds over the edges).  A url without a
rule of its own is blocked if some url of its component is blocked by a rule; a url with a
rule keeps the rule's verdict, so an explicit allow takes precedence over a block that
comes from an alias.  Everything else is allowed.

Native expressions only.  Rules and verdicts are worked out once per distinct url; a host
with very many pages costs one row per distinct url, and pages meet their url's verdict in
a join whose other side has one row per url, which can be split.

Null urls and urls without ``://`` have empty host and path, fit no rule, are nobody's
alias and are allowed.  Null and empty html names nothing.  Repeated rows stay repeated;
empty tables give empty results; html of any length is read whole, by regular expressions
that look at its tags only; extra columns of any name are left out.
"""
from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators.components import components

_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
_ABSOLUTE = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_spelling(url: Column) -> Column:
    """The spelling that servers redirect others to: https, no fragment, no final slash, no utm_ parameters."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    path = F.regexp_replace(path_of(url), r"(?<=.)/+$", "")
    return F.concat(F.lit("https://"), host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments carried out."""
    closed = F.regexp_replace(path, r"/(\.\.?)\z", "/$1/")
    segments = F.aggregate(
        F.split(closed, "/"), F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
        .otherwise(F.array_append(kept, s)))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.array_join(segments, "/")).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """``target`` as a page at ``url`` names it: whole, or relative to its scheme, host, folder or path.

    Null for empty targets, bare fragments and other schemes (``mailto:``).  A page's
    ``<base>`` is not looked at.
    """
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)\z", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*\z", "")
    rooted = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    return (F.when(target.rlike(_ABSOLUTE), target)
            .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
            .when((target == "") | target.startswith("#") | target.rlike(_SCHEME), F.lit(None).cast("string"))
            .when(path == "", F.concat(root, path_of(url), tail))
            .otherwise(F.concat(root, without_dots(rooted), tail)))


def link_edges(pages: DataFrame) -> DataFrame:
    """a, b: urls joined by a canonical link, a refresh redirect or a redirect to the plain spelling.

    Link targets have a plain spelling of their own, so a page is met under any spelling of its url.
    """
    url = F.col("url")

    def named(tag: str, attribute: str) -> Column:
        value = F.regexp_extract(F.regexp_extract("html", tag, 0), attribute, 1)
        return resolved(url, F.regexp_replace(value, _AMPERSAND, "&"))

    targets = F.array_compact(F.array(named(_LINK, _HREF), named(_REFRESH, _TARGET), url))
    rows = pages.filter(url.contains("://")).select("url", F.explode(targets).alias("target"))
    target = F.col("target")
    pairs = F.array(F.struct(url.alias("a"), target.alias("b")),
                    F.struct(target.alias("a"), plain_spelling(target).alias("b")))
    return rows.select(F.inline(pairs)).filter("a <> b").distinct()


def own_rules(urls: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """url, host, path, rule, own: the longest rule of every distinct url, null where none fits.

    Hosts are taken apart into their suffixes and joined with the rules on equal hosts.
    """
    spark = urls.sparkSession
    listed = spark.createDataFrame(
        [(r.host, r.path, r.verdict, f"{r.host}/{r.path.removeprefix('/')}") for r in rules],
        "rule_host string, rule_path string, own string, rule string")
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = (
        parts.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host"))
        .join(listed, "rule_host").filter(F.startswith("path", "rule_path"))
        .groupBy("url").agg(F.max_by(F.struct("rule", "own"), F.struct(F.length("rule"), "rule")).alias("best"))
    )
    return parts.join(fitting, "url", "left").select("url", "host", "path", "best.rule", "best.own")


def judge(pages: DataFrame, edges: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    url = F.coalesce("url", F.lit(""))
    aliases = components(edges.filter("a <> b")).withColumnRenamed("node", "url")
    nodes = pages.select(url.alias("url")).unionByName(aliases.select("url")).distinct()
    ruled = own_rules(nodes, rules)
    placed = ruled.join(aliases, "url", "left")
    blocked = placed.filter("own = 'block' and component is not null").select("component").distinct()
    spread = placed.join(blocked.withColumn("hit", F.lit(True)), "component", "left").select(
        "url", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))
    return pages.select(F.col("page_id").alias("page_id"), url.alias("url")).join(spread, "url").select(
        "page_id", "host", "path", "rule", "verdict")
