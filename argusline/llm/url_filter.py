"""URL filters with redirect equivalence.

A rule blocks or allows a host (with its subdomains) and a path prefix; the
longest fitting rule judges a URL.  A URL that no rule fits is judged by its
aliases: redirects, declared canonical links and, if wanted, spellings of one
address form a graph whose components are found by distributed star contraction.  A block
decision on any member reaches every alias without a rule, unless another
member is explicitly allowed; without a decision a URL is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusline.llm.common import Stages
from argusline.llm.components import components

#: (verdict, host, path prefix); a list for the driver, compiled into the plan.
Rule = tuple[str, str, str]

#: What a browser does not take for markup: comments and raw text.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp)\b[^>]*>.*?(?:</\1\b|\z)"
LINK, META = r"(?is)<link[\s/][^>]*>", r"(?is)<meta[\s/][^>]*>"
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)"""
#: Query parameters that do not change the page that is meant.
TRACKING = r"(?i)([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null without one."""
    name = verdict = None
    # Of equally long rules the first in code-point order is taken.
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def normal_url(url: Column, spellings: bool = True) -> Column:
    """One spelling of an address: no scheme and fragment.

    With ``spellings`` also without tracking parameters, index page, ``.html``
    and final slash: these are taken for one page by policy, not by a link.
    """
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    if not spellings:
        return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    query = F.regexp_replace(F.concat(F.lit("?"), query), TRACKING, "$1")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, "&+", "&"), r"\?&", "?"), r"[?&]+\z", "")
    return F.concat(host, F.regexp_replace(path, r"(/index)?(\.html?)?/*\z", ""), query)


def unescaped(value: Column) -> Column:
    """HTML references of ``&`` and quotes as the characters."""
    value = F.regexp_replace(F.regexp_replace(value, "(?i)&quot;|&#34;|&#x22;", '"'), "(?i)&apos;|&#39;|&#x27;", "'")
    return F.regexp_replace(value, "(?i)&amp;|&#38;|&#x26;", "&")


def resolved(base: Column, goal: Column) -> Column:
    """``goal`` seen from ``base`` as RFC 3986 says; null if it is no web address.

    The base has ``://``.  A page's ``<base>`` element is not looked at.
    """
    scheme = F.regexp_extract(goal, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.concat(F.regexp_extract(base, r"(?s)\A(.*?://)", 1), host_of(base))
    mark = F.regexp_instr(goal, F.lit("[?#]"))
    own = F.when(mark > 0, F.substring(goal, F.lit(1), mark - 1)).otherwise(goal)
    rest = F.when(mark > 0, F.substring(goal, mark, F.length(goal))).otherwise("")
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    # Dot segments: ".." takes back the segment before it, "." is nothing.
    parts = F.split(F.regexp_replace(whole, r"\A/", ""), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    slash = F.when(whole.rlike(r"(\A|/)\.\.?\z") & (F.size(walked) > 0), "/").otherwise("")
    path = F.concat(F.lit("/"), F.array_join(walked, "/"), slash)
    same = F.when(goal.startswith("#"), F.lit(None)).when(goal.startswith("?"), F.concat(origin, path_of(base), goal))
    out = F.when(goal.startswith("//"), F.concat(F.lit("http:"), goal)).when(goal.startswith("?") | goal.startswith("#"), same).otherwise(F.concat(origin, path, rest))
    return F.when(scheme != "", F.when(goal.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), goal)).otherwise(out)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of exactly that name; empty without one."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda t: F.lower(F.regexp_extract(t, r"\A[^\s=]+", 0)) == name)
    return F.coalesce(F.regexp_extract(F.get(own, F.lit(0)), r"""(?s)\A[^=]*=\s*["']?\s*(.*?)\s*["']?\z""", 1), F.lit(""))


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, dst (as written, dst made absolute): every declared canonical link and refresh.

    Comments, scripts and other raw text declare nothing.
    """
    url, html = F.col(url_col), F.col(html_col)
    # Few pages declare any, so the tags are looked at in those only.
    some = pages.where(url.contains("://") & html.rlike("(?i)canonical|refresh")).select(url.alias("src"), F.regexp_replace(html, UNSEEN, " ").alias("seen"))
    tags = lambda pattern: F.regexp_extract_all("seen", F.lit(pattern), F.lit(0))
    links = F.filter(tags(LINK), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(tags(META), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    goals = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(metas, lambda t: F.regexp_extract(unescaped(attribute(t, "content")), TARGET, 1)))
    rows = some.select("src", F.explode(goals).alias("goal")).where("goal != ''").select("src", unescaped(F.col("goal")).alias("goal"))
    return rows.select("src", resolved(F.col("src"), F.col("goal")).alias("dst")).where("dst IS NOT NULL")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
    spellings: bool = True,
) -> DataFrame:
    """id, host, path, rule, verdict of every row of ``pages``.

    ``redirects`` (src, dst URLs) adds known redirects to those declared in the
    pages.  Spellings of one address (see ``normal_url``) are one node unless
    ``spellings`` is off.  A null URL or one without
    ``://`` has an empty host and path, no aliases, and is allowed unless a
    rule says otherwise.  Repeated rows give repeated results; only the named
    columns are read, so others cannot clash.
    """
    stages = Stages(pages.sparkSession, "url-filter")
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *([F.col(html_col).alias("html")] if html_col else []))
    links = link_edges(slim, "url", "html") if html_col else None
    if redirects is not None:
        given = redirects.where(F.col("src").contains("://") & F.col("dst").contains("://")).select("src", "dst")
        links = given if links is None else links.union(given)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = rule_columns(host, path, rules)
    name = lambda c: normal_url(F.col(c), spellings)
    node = F.when(F.col("url").contains("://"), name("url"))
    rows = slim.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("said"), node.alias("node"))
    rows = stages.write(rows, "judged")
    # A node's group: the root of its component, or itself.
    spelt = rows
    group = F.col("node")
    ends = None
    if links is not None:
        links = stages.write(links.distinct(), "links")
        edges = links.select(name("src").alias("src"), name("dst").alias("dst"))
        roots = components(edges, "src", "dst", stages).withColumnsRenamed({"node": "n", "root": "r"})
        spelt = rows.join(roots, rows["node"] == roots["n"], "left")
        group = F.coalesce("r", "node")
        # Addresses that no page has are judged too.
        named = links.select(F.col("src").alias("url")).union(links.select(F.col("dst").alias("url"))).distinct()
        ends = named.select(name("url").alias("node"), rule_columns(host, path, rules)[1].alias("said")).where("said IS NOT NULL").join(roots, F.col("node") == F.col("n"), "left").select(group.alias("group"), "said")
    spelt = spelt.withColumn("group", group)
    # Blocks reach aliases; an explicit allow in the group stops them.
    members = spelt.select("group", "said").where(F.col("said").isNotNull() & F.col("group").isNotNull())
    decided = (
        (members if ends is None else members.union(ends))
        .groupBy("group").agg(F.max((F.col("said") == "block").cast("int")).alias("b"), F.max((F.col("said") == "allow").cast("int")).alias("a"))
        .where("b = 1 and a = 0").select("group", F.lit("block").alias("inherited"))
    )
    need = spelt.where(F.col("said").isNull() & F.col("group").isNotNull())
    rest = spelt.where(F.col("said").isNotNull() | F.col("group").isNull()).withColumn("inherited", F.lit(None).cast("string"))
    out = need.join(decided, "group", "left").select("page_id", "host", "path", "rule", "said", "inherited").unionByName(rest.select("page_id", "host", "path", "rule", "said", "inherited"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "inherited", F.lit("allow")).alias("verdict"))
