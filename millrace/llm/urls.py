"""Verdicts on URLs by rules, carried to aliases through redirects and canonical links.

Rules name a host and a start of the path; the longest that fits decides, whatever its aliases say. Where none fits, the URL takes the verdict of
its aliases: the connected component over canonical links, refreshes and given redirects. A component with a blocked member and no
explicitly allowed one is blocked. Nodes are 64-bit hashes of URLs without scheme, fragment and closing slash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.storage import materialize
from millrace.llm.text import lower_ascii

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
CANONICAL = r"""(?i)<link[^>]+rel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
_AFTER = r"(?s)^.*?://"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, _AFTER, ""), "#", 1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The hash of host, path and query; null for what is no URL."""
    query = F.regexp_extract(_rest(url), r"(?s)(\?.*)$", 1)
    return F.when(host_of(url) != "", F.xxhash64(F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), query)))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def resolve(url: Column, target: Column) -> Column:
    """The whole URL that target, found on the page at url, names; null for one without a host, such as mailto:, for a place on the page (#), and on a page without a URL."""
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    own = F.regexp_extract(target, r"^([^?#]*)", 1)
    path = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path_of(url), r"(?s)^(.*/)?", 0), own))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    step = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    parts = F.aggregate(F.split(F.regexp_replace(path, r"/\.(\.?)$", "/.$1/"), "/"), F.array().cast("array<string>"), step)
    path = F.when(own == "", path_of(url)).otherwise(F.array_join(parts, "/"))
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|#|$)") | (host == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(scheme, F.lit("://"), host, path, F.regexp_extract(target, r"(?s)[?#].*$", 0)))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of canonical links and refreshes, whatever the case of their tags; relative targets are resolved against the page's url."""
    html = F.col(html_col)
    canonical = F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1)
    found = pages.filter(html.rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("url"), F.explode(F.array(canonical, refresh)).alias("found"))
    whole = found.select("url", resolve(F.col("url"), F.regexp_replace("found", "(?i)&(amp|#38|#x26);", "&")).alias("target"))
    return whole.filter("target is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages; redirects may add rows (url, target).

    A null url, or one without `://`, has an empty host and path, no rule and no alias: it is allowed. Repeated rows each give a row; an
    empty table gives none; other columns are left alone.
    """
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = materialize(edges.select(F.col("url"), F.col("target"), node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).filter("a is not null and b is not null"))
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), node_of(F.col(url_col)).alias("node"))
    judged = judged.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    roots = components(edges).withColumnRenamed("node", "n")
    ends = edges.select(F.explode(F.array("url", "target")).alias("u"))
    spoken = judged.select("node", "r").unionByName(ends.select(node_of(F.col("u")).alias("node"), rule_for(host_of(F.col("u")), path_of(F.col("u")), rules).alias("r"))).filter("r is not null").groupBy("node").agg(F.max(F.col("r.verdict") == "block").alias("block"), F.max(F.col("r.verdict") == "allow").alias("allow"))
    rooted = spoken.join(roots, F.col("node") == F.col("n"), "left").select(F.coalesce("root", "node").alias("root"), "block", "allow")
    blocked = rooted.groupBy("root").agg(F.max("block").alias("block"), F.max("allow").alias("allow")).filter("block and not allow").select(F.col("root").alias("bad"))
    mute = judged.filter("r is null").join(roots, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node"))
    mute = mute.join(blocked, F.col("root") == F.col("bad"), "left").select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("bad").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return judged.filter("r is not null").select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).unionByName(mute)
