"""URL filters over redirect-equivalent pages. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.components import connected_components
from orrery.llm.scratch import Scratch, others

#: Rules that are part of the plan; more of them, or a table of them, are joined.
MOST_RULES = 512
FIT = "struct<size:int,rule:string,verdict:string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What redirects and canonical links join: host, path and query; scheme and fragment do not count. Null without ``://``."""
    return F.when(url.contains("://"), F.concat(host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def resolve(link: Column, url: Column) -> Column:
    """An absolute URL for a link on the page ``url``."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    root = F.concat(F.lit("http://"), host(url))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def fitting(rules: list[tuple[str, str, str]], at_host: Column, at_path: Column) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule, null if none fits. Rules are (verdict, host, path).

    A rule fits its host and every subdomain if the path starts with its own. Of
    equally long rules `allow` goes first, then the smaller text.
    """
    best = F.lit(None).cast(FIT)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", [-ord(c) for c in r[1] + r[2]])):
        fits = ((at_host == h) | at_host.endswith(f".{h}")) & at_path.startswith(p)
        best = F.when(fits, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def joined_fits(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, fit) of the distinct (host, path) in ``places`` that a rule of the table (verdict, host, path) fits.

    Equi-joins only: every suffix of a host meets the lengths of the paths that rules of that host
    have, then each prefix of such a length meets the rule.
    """
    rules = rules.toDF("verdict", "rule_host", "rule_path").where("rule_host is not null and rule_path is not null and verdict is not null").distinct()
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.select("host", "path").where("host is not null and path is not null").distinct().withColumn("rule_host", F.explode(suffixes))
    each = each.join(lengths, "rule_host").withColumn("length", F.explode("lengths")).where("length <= length(path)").withColumn("rule_path", F.substring("path", F.lit(1), F.col("length")))
    text = F.concat("rule_host", "rule_path")
    met = each.join(rules, ["rule_host", "rule_path"]).select("host", "path", F.length(text).alias("size"), (F.col("verdict") == "allow").alias("allows"), text.alias("rule"), "verdict")
    # the longest, then allow, then the smaller text
    top = met.groupBy("host", "path").agg(F.max(F.struct("size", "allows")).alias("top"), F.collect_set(F.struct("size", "allows", "rule", "verdict")).alias("all"))
    first = F.array_sort(F.filter("all", lambda r: (r["size"] == F.col("top.size")) & (r["allows"] == F.col("top.allows"))), lambda a, b: F.when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))[0]
    return top.select("host", "path", F.struct(first["size"].alias("size"), first["rule"].alias("rule"), first["verdict"].alias("verdict")).alias("fit"))


def with_fit(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, at_host: str, at_path: str) -> DataFrame:
    """``rows`` with the column __fit; at_host and at_path name columns."""
    if isinstance(rules, list):
        if len(rules) <= MOST_RULES:
            return rows.withColumn("__fit", fitting(rules, F.col(at_host), F.col(at_path)))
        rules = rows.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    found = joined_fits(rows.select(F.col(at_host).alias("host"), F.col(at_path).alias("path")), rules).select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("fit").alias("__fit"))
    return rows.join(found, (rows[at_host] == F.col("__h")) & (rows[at_path] == F.col("__p")), "left").drop("__h", "__p")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of every canonical link and every refresh redirect of the pages."""
    html, url = F.col(html_col), F.col(url_col)
    found = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    some = pages.where(url.contains("://") & html.rlike("(?i)canonical|refresh"))
    each = some.select(url.alias("url"), F.explode(found).alias("link")).where("link != ''")
    return each.select(node(F.col("url")).alias("src"), node(resolve(F.col("link"), F.col("url"))).alias("dst")).where("src is not null and dst is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its ``keep`` columns) with host, path, rule and verdict.

    ``rules`` is a list of (verdict, host, path), or a table of these columns; up to MOST_RULES of a
    list are part of the plan, all others are joined. A page's own longest rule decides. Without
    one, its aliases do: the pages and link targets in the same connected component of redirect and
    canonical-link edges (``redirects`` may add rows of (from url, to url)). If a rule allows any of
    them the page is allowed, else if one blocks any it is blocked, else allowed.

    A null url, or one without ``://``, has empty host and path, no rule and no alias.
    Null html has no links. Repeated pages get the same answer each. Existing
    columns of the four names, in any case, are replaced; empty tables give no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    keep = others(pages.columns if keep is None else keep, ("host", "path", "rule", "verdict"))
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.union(redirects.select(node(F.col(a)), node(F.col(b))).dropna())
    alias = connected_components(edges, scratch)
    # a node is its url without the scheme
    at = F.concat(F.lit("x://"), F.col("node"))
    judged = with_fit(alias.withColumns({"host": host(at), "path": path(at)}), rules, "host", "path")
    groups = judged.groupBy("component").agg(F.max(F.when(F.col("__fit.verdict") == "allow", 2).when(F.col("__fit.verdict") == "block", 1).otherwise(0)).alias("__says")).where("__says > 0")
    said = scratch.save(alias.join(groups, "component").select(F.col("node").alias("__node"), "__says"))

    # what is kept goes in one column, so no name of it meets one used here
    rows = pages.select((F.struct(*keep) if keep else F.lit(None)).alias("__kept"), F.col(url_col).alias("__url")).withColumns({"host": host(F.col("__url")), "path": path(F.col("__url"))})
    rows = with_fit(rows, rules, "host", "path")
    # a page with a rule, or without a node, meets no alias: a key of its own keeps such pages apart
    none = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("__node", F.coalesce(F.when(F.col("__fit").isNull(), node(F.col("__url"))), none))
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__says") == 1, "block").otherwise("allow"))
    return rows.join(said, "__node", "left").select(*[F.col("__kept")[c].alias(c) for c in keep], "host", "path", F.col("__fit.rule").alias("rule"), verdict.alias("verdict"))
