"""URL rules with redirect equivalence: a blocked page takes its aliases with it.

Pages whose URLs are joined by redirects or canonical links form a component. A page with a rule of its
own follows it. The others are blocked if their component holds a blocked URL and no explicitly allowed
one: an explicit allow takes precedence over every block in its component.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplore.llm.common import fresh
from shoplore.llm.components import connected_components
from shoplore.session import checkpointed

# Patterns of canonical links, of refresh redirects, and of query parameters that track.
CANONICAL_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)"""
TRACKING = r"(?i)(?<=[?&])(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*&?"


class Rule(NamedTuple):
    """``action`` is allow or block; fits the host and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """What spellings of one address share: host, path without a last slash, and the query without tracking
    parameters; scheme and fragment do not count. Null for a URL without a host."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"[?&]+$", "")
    return F.when(url_host(url) != "", F.concat(url_host(url), F.regexp_replace(url_path(url), r"/+$", ""), query))


def _rule_of(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, as one CASE expression; null without one."""
    column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        column = F.when(fits, F.lit(value(rule))).otherwise(column)
    return column


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, target)`` for every canonical link and refresh redirect in a page; relative targets take the
    scheme and host of the page."""
    targets = F.concat(
        F.transform(F.regexp_extract_all(F.col(html), F.lit(CANONICAL_TAG), F.lit(0)),
                    lambda tag: F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)])),
        F.transform(F.regexp_extract_all(F.col(html), F.lit(REFRESH_TAG), F.lit(0)),
                    lambda tag: F.regexp_extract(tag, REFRESH_URL, 1)))
    found = pages.select(F.col(url).alias("url"), F.explode(targets).alias("target")).filter("target <> ''")
    site = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    target = F.col("target")
    whole = (F.when(target.contains("://"), target).when(target.startswith("//"), F.concat(scheme, target))
             .when(target.startswith("/"), F.concat(site, target))
             .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), target)))
    return found.filter(site != "").select("url", whole.alias("target"))


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html",
                 redirects: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Links come from the pages' HTML and from ``redirects``, two columns of URLs. Rules are literals of the
    program. Only URLs that have a link go through the component search; pages find their component by a
    join whose hot keys can be split at run time. A null URL or one without ``://`` has no host, fits no rule and
    is allowed; null HTML has no links; repeated pages get a row each. If a page has a column called like one of
    the new ones, the new one gets an underscore.
    """
    host, path, rule, verdict, node, action = fresh(pages.columns, "host", "path", "rule", "verdict", "node", "action")
    own = F.col(f"`{url}`")
    links = page_links(pages, url, html)
    if redirects is not None:
        a, b = redirects.columns[:2]
        links = links.unionByName(redirects.select(F.col(a).alias("url"), F.col(b).alias("target")))
    links = checkpointed(links.select(
        url_node(F.col("url")).alias("left"), url_node(F.col("target")).alias("right"),
        F.col("url"), F.col("target")).dropna(subset=["left", "right"]).distinct())
    linked = connected_components(links)

    def told(column: Column) -> Column:
        return _rule_of(url_host(column), url_path(column), rules, lambda r: r.action)

    ends = links.select(F.col("left").alias("at"), told(F.col("url")).alias("told")).unionByName(
        links.select(F.col("right").alias("at"), told(F.col("target")).alias("told")))
    # pages that are spelt like an end of a link but have another path vote as well
    voters = pages.select(url_node(own).alias("at"), told(own).alias("told"))
    votes = ends.unionByName(voters).dropna()
    classes = (votes.join(linked, votes["at"] == linked["vertex"]).groupBy("component")
               .agg(F.bool_or(F.col("told") == "allow").alias("allowed"), F.bool_or(F.col("told") == "block").alias("blocked"))
               .filter("blocked AND NOT allowed").select("component"))
    blocked = linked.join(classes, "component", "left_semi").select(F.col("vertex").alias(node), F.lit(True).alias("blocked_alias"))
    judged = pages.withColumns({host: url_host(own), path: url_path(own)}).withColumns({
        rule: _rule_of(F.col(host), F.col(path), rules, lambda r: r.host + r.path),
        action: _rule_of(F.col(host), F.col(path), rules, lambda r: r.action), node: url_node(own)})
    (mark,) = fresh(judged.columns, "blocked_alias")
    return (judged.join(blocked.withColumnRenamed("blocked_alias", mark), node, "left")
            .withColumn(verdict, F.coalesce(F.col(action), F.when(F.col(mark), "block"), F.lit("allow")))
            .select(*[F.col(f"`{c}`") for c in pages.columns], host, path, rule, verdict))
