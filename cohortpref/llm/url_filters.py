"""URL filters with redirect equivalence, in DataFrame expressions only.

Rules allow or block a host with all its subdomains below a path; the longest rule that fits decides. Pages without a
rule of their own take the decision of their aliases: URLs joined by redirects (meta refresh), canonical links and equal
canonical forms are connected components of a graph, computed by `components`; a component with an explicitly allowed
member is allowed, else one with a blocked member is blocked, else it is allowed. A URL's own rule always wins.

Results for odd input: a null URL or one without `://` has an empty host and path, fits no rule and is allowed; repeated
URLs get equal verdicts; links to places outside the table take part, as they may be named by a rule; relative links are
resolved against the host of the page, other forms are ignored; an empty table gives an empty table. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.llm.components import components
from cohortpref.session import snapshot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
# Parameters that name a campaign, not a page.
TRACKING = r"(?i)(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*&?"
CANONICAL_TAG = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*([^\"'\s>;]+)"
# Rules up to this measured number are broadcast, more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """The URL without scheme, www. or m., page suffix, trailing slash, tracking parameters and fragment; null for a
    URL without `://`."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?(?:\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"[?&]+$", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("canonical://"), host, path, query))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, verdict, rule_host, rule_path from (allow or block, host + path)."""
    cells = [(text, verdict, text.partition("/")[0], "/" + text.partition("/")[2]) for verdict, text in rules]
    return spark.createDataFrame(cells, "rule string, verdict string, rule_host string, rule_path string")


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of the distinct URLs in `urls` that a rule fits. Of rules of one length the longer host
    wins, then block."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    rows = rows.select("url", "path", F.explode(suffixes).alias("suffix"))
    side = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    met = rows.join(side, (F.col("suffix") == F.col("rule_host")) & F.startswith("path", F.col("rule_path")))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict"))
    return met.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best")).select("url", "best.rule", "best.verdict")


def alias_links(pages: DataFrame) -> DataFrame:
    """Links (a, b) between a URL and its canonical form, its canonical link and the target of its redirect."""
    url = F.col("url")
    target = lambda pattern, word: F.when(F.contains(F.lower("html"), F.lit(word)), F.regexp_extract("html", pattern, 1))
    known = pages.where(canonical_form(url).isNotNull())
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)

    def absolute(link: Column) -> Column:
        base = F.concat(scheme, F.lit("://"), host_of(url))
        return (
            F.when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(base, link))
            .when(F.contains(link, F.lit("://")), link)
        )

    found = known.select("url", absolute(target(CANONICAL_TAG, "canonical")).alias("c"), absolute(target(REFRESH_TAG, "refresh")).alias("r"))
    ends = F.array(canonical_form(url), F.col("c"), canonical_form(F.col("c")), F.col("r"), canonical_form(F.col("r")))
    links = found.select(F.col("url").alias("a"), F.explode(ends).alias("b"))
    return links.where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()


def judge_pages(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The rows of `pages` with host, path, rule and verdict. `links` (a, b) default to `alias_links`."""
    links = snapshot(alias_links(pages) if links is None else links, "aliases")
    urls = pages.where(F.col("url").isNotNull()).select("url")
    nodes = urls.unionByName(links.select(F.col("a").alias("url"))).unionByName(links.select(F.col("b").alias("url"))).distinct()
    groups = components(links, "a", "b")
    own = nodes.join(longest_rule(nodes, rules).withColumnsRenamed({"url": "u", "verdict": "own"}), F.col("url") == F.col("u"), "left").drop("u")
    placed = own.join(groups, F.col("url") == F.col("node"), "left").select("url", "rule", "own", F.coalesce("component", "url").alias("component"))
    placed = snapshot(placed, "judged-urls")
    shared = placed.where(F.col("own").isNotNull()).groupBy("component").agg(F.min("own").alias("shared"))  # allow < block
    decided = placed.join(shared, "component", "left").select(
        F.col("url").alias("judged_url"), F.col("rule").alias("judged_rule"), F.coalesce("own", "shared").alias("judged_verdict")
    )
    out = pages.drop("host", "path", "rule", "verdict").join(decided, F.col("url") == F.col("judged_url"), "left")
    return out.select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("judged_rule").alias("rule"),
        F.coalesce("judged_verdict", F.lit("allow")).alias("verdict"),
    )
