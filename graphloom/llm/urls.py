"""URL filter with redirect equivalence, in DataFrame functions only.

Rules block or allow hosts (with their subdomains) and path prefixes; the
longest that fits wins. Redirects and canonical links tie URLs to classes,
by distributed connected components; an URL without a rule takes the block
of its class, unless a rule allows a member of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .decontamination import lowered
from .storage import materialize

#: A rule is (host, path, verdict).
Rule = tuple[str, str, str]
#: Rules that become one expression; more are joined.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (with host, path) and ``rule``, ``rule_verdict``: of the longest fitting rule, else null.

    Of equally long rules an allow wins, then the lesser text.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    if len(ranked) <= INLINE_RULES:
        chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
        for host, path, verdict in reversed(ranked):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            chosen = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
        return urls.withColumn("_c", chosen).withColumns({"rule": F.col("_c.rule"), "rule_verdict": F.col("_c.verdict")}).drop("_c")
    table = urls.sparkSession.createDataFrame([(h, p, v, i) for i, (h, p, v) in enumerate(ranked)], "rule_host string, rule_path string, verdict string, rank int")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    pairs = urls.select("host", "path").distinct()
    best = pairs.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.min(F.struct("rank", F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("_b"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_b.rule"), "rule_verdict": F.col("_b.verdict")}).drop("_b")


def resolved(target: Column, base: Column) -> Column:
    """An absolute URL without fragment; null for other schemes and empty targets."""
    t = F.regexp_replace(F.trim(target), "#.*$", "")
    origin, scheme = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(t.rlike(r"(?i)^https?://"), t).when(t.startswith("//"), F.concat(scheme, t)).when(t == "", F.lit(None)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(t.startswith("/"), F.concat(origin, t)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), t))
    )


def html_links(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: canonical links and immediate refreshes of pages (url, html), as absolute URLs."""
    tag = lambda pattern: F.regexp_extract("html", pattern, 0)
    canonical = tag(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*>""")
    refresh = tag(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>""")
    href = F.regexp_extract(canonical, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    moved = F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    url = F.regexp_replace("url", "#.*$", "")
    found = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|refresh")).select(url.alias("src"), F.explode(F.array(resolved(href, F.col("url")), resolved(moved, F.col("url")))).alias("dst"))
    return found.where("dst is not null and dst <> src").distinct()


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict, propagated)`` of every row of ``pages`` (page_id, url, html).

    ``redirects`` (src, dst) are edges besides those in the pages' html. An
    URL's own rule always holds; an URL without one is blocked if its class
    has a blocked member and none that a rule allows; else it gets
    ``default``. URLs are one vertex whatever their fragment. A null url, or
    one without ``://``, has empty host and path and no class. Repeated rows
    each give the same row; no rows give no rows.
    """
    plain = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = html_links(plain)
    if redirects is not None:
        bare = lambda c: F.regexp_replace(F.col(c).cast("string"), "#.*$", "")
        edges = edges.union(redirects.select(bare("src"), bare("dst")))
    edges, _ = materialize(edges, "redirects")
    own = judged(plain.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if edges.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"), F.lit(False).alias("propagated"))
    classes, _ = materialize(connected_components(edges), "classes")
    members = judged(classes.select("id", "component", host_of(F.col("id")).alias("host"), path_of(F.col("id")).alias("path")), rules)
    blocked = members.groupBy("component").agg(F.max((F.col("rule_verdict") == "block").cast("int")).alias("b"), F.max((F.col("rule_verdict") == "allow").cast("int")).alias("a")).where("b = 1 and coalesce(a, 0) = 0").select("component")
    aliases = classes.join(blocked, "component", "left_semi").select(F.col("id").alias("alias"))
    met = own.withColumn("bare", F.regexp_replace("url", "#.*$", "")).join(aliases, F.col("bare") == F.col("alias"), "left")
    spread = F.col("rule_verdict").isNull() & F.col("alias").isNotNull()
    return met.select("page_id", "host", "path", "rule", F.when(spread, "block").otherwise(F.coalesce("rule_verdict", F.lit(default))).alias("verdict"), spread.alias("propagated"))
