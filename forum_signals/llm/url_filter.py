"""URL filters with redirect equivalence.

A rule is (host, path, verdict); it fits its host and all subdomains if the path starts with the rule's, and the longest
fitting rule wins. A url no rule fits takes the decision of its aliases: urls joined by redirects and canonical links are
one page, found as connected components. An explicit allow on any alias takes precedence over blocks; with no decision
in the component the verdict is allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forum_signals.llm.common import stored
from forum_signals.llm.components import connected_components

Rule = tuple[str, str, str]

#: Link and meta elements. A ``<`` ends an element that is not closed, so a page is read once, whatever it holds.
ELEMENT = r"(?is)<(?:link|meta)\b[^<>]*+>"
#: The target of a link element with rel=canonical and of a meta refresh, with the attributes in either order.
CANONICAL = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)""",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule: longest host first, then longest path; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in reversed(ordered):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def normal_url(url: Column) -> Column:
    """The url with scheme and host in lower case and without its fragment: spellings of one page become equal."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.concat(F.lower(head), F.substr(plain, F.length(head) + 1))


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments; ``..`` at the top is dropped."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    above = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))

    def step(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", shorter).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(above, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), closed)).otherwise(path)


def resolved(target: Column, page: Column) -> Column:
    """The absolute url that a link target means on a page; null for other schemes, the page itself and pages without ``://``."""
    plain = F.regexp_replace(F.regexp_replace(target, r"(?i)&(?:amp|#38|#x26);", "&"), r"(?s)#.*$", "")
    base = normal_url(page)
    scheme = F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*:(?=//)", 0)
    origin = F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*://[^/?]*", 0)
    own = F.regexp_extract(F.substr(base, F.length(origin) + 1), r"(?s)^[^?]*", 0)
    folder = F.regexp_extract(own, r"(?s)^.*/", 0)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.regexp_extract(plain, r"(?s)^[^?]*", 0)
    query = F.substr(plain, F.length(path) + 1)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    absolute = plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return (
        F.when(absolute, normal_url(plain))
        .when((plain == "") | plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), F.lit(None).cast("string"))
        .when(plain.startswith("//"), normal_url(F.concat(scheme, plain)))
        .when(path == "", F.concat(origin, own, query))
        .otherwise(F.concat(origin, without_dots(rooted), query))
    )


def _target(pattern: str):
    return lambda element: F.regexp_extract(element, pattern, 1)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) of the canonical links and refresh redirects that pages declare.

    Targets are resolved against the page's url: relative and ``//host`` forms become absolute, ``&amp;`` is decoded. Both
    sides come as ``normal_url``; targets without a page they could mean are left out.
    """
    elements = F.regexp_extract_all(F.col(html_col), F.lit(ELEMENT), F.lit(0))
    found = F.flatten(F.array(*(F.transform(elements, _target(pattern)) for pattern in CANONICAL)))
    targets = pages.select(F.col(url_col).alias("page"), F.explode(found).alias("found")).where("page IS NOT NULL AND found != ''")
    return targets.select(normal_url(F.col("page")).alias("source"), resolved(F.col("found"), F.col("page")).alias("target")).where(
        "target IS NOT NULL"
    ).distinct()


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], aliases: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: the id column, host, path, rule, verdict, and how the verdict came about (``reason``).

    ``aliases`` has two columns of urls that are one page, whatever the case of their hosts and their fragments. reason is ``rule``, ``alias`` or ``default``. A null url has an
    empty host and path, fits only a rule with an empty host, has no aliases and so is allowed by default. Urls that
    occur only in ``aliases`` pass decisions on too. Repeated pages give repeated rows; an empty table an empty one.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)

    def judged(urls: DataFrame) -> DataFrame:
        return urls.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "decided": verdict})

    own = judged(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    edges = aliases.select(*(normal_url(F.col(f"`{c}`")).alias(n) for c, n in zip(aliases.columns, ("source", "target"))))
    groups = stored(connected_components(edges, "url-aliases"), "url-groups")
    known = judged(groups.select(F.col("node").alias("url"), "component"))
    decisions = known.where("decided IS NOT NULL").groupBy("component").agg(F.min("decided").alias("passed"))  # allow < block
    passed = groups.join(decisions, "component").select(F.col("node").alias("normal"), "passed")
    return own.withColumn("normal", normal_url(F.col("url"))).join(passed, "normal", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decided", "passed", F.lit("allow")).alias("verdict"),
        F.when(F.col("decided").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise("default").alias("reason"),
    )
