"""Links of directory pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators.scope import positions
from docketlake.session import checkpoint

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


# How signs of an address are written inside an attribute; the ampersand itself comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&#32;", " "), ("&#x20;", " "), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for written, sign in ENTITIES:
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def absolute(base: Column, href: Column) -> Column:
    """href seen from the page at base; parts above the root are dropped, dots are resolved."""
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"(?i)^(https?://[^?#]*/)", 1)
    plain = F.regexp_replace(href, r"[?#].*$", "")
    joined = (
        F.when(plain.rlike("(?i)^https?://"), plain)
        .when(plain.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), plain))
        .when(plain.startswith("/"), F.concat(origin, plain))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), plain))
    )
    out = F.regexp_replace(joined, r"(?<!:)/(?:\./)+", "/")
    for _ in range(4):
        out = F.regexp_replace(out, r"(?<=[^:/])/(?!\.\./)[^/]+/\.\./", "/")
    return out


def page_links(pages: DataFrame, url: str = "url", html: str = "html", same_host: bool = True) -> DataFrame:
    """(url, n, link): the different links of each page in order; fragments, queries and mail addresses are left out."""
    pages = pages.select(F.col(url).alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))
    hrefs = F.transform(hrefs, unescaped)
    kept = F.filter(hrefs, lambda h: ~h.rlike(r"(?i)^(?:#|\?|mailto:|javascript:)"))
    links = F.array_distinct(F.transform(kept, lambda h: absolute(F.col("page"), h)))
    out = pages.select(F.col("page"), F.posexplode(links).alias("n", "link")).withColumnRenamed("page", "url")
    if same_host:
        at = r"(?i)^https?://([^/?#]+)"
        out = out.where(F.lower(F.regexp_extract("link", at, 1)) == F.lower(F.regexp_extract("url", at, 1)))
    return out


def crawl(fetch_pages, roots: DataFrame, max_depth: int = 2, skip: tuple[str, ...] = ("inbox", "_older"), most: int = 251) -> DataFrame:
    """(link, depth, kind): the files below the roots (url), and the directories that were not visited. fetch_pages maps a DataFrame (url) to pages (url, html).

    Breadth first: a level is one job over all its directories, known ones are taken out by
    an anti-join. ``most`` bounds the directories of the crawl, a setting of politeness; what it or
    ``max_depth`` leaves out is a row of kind ``not_visited``.
    """
    frontier = checkpoint(roots.select("url").distinct())
    seen, out, visited = frontier, None, 0
    for depth in range(max_depth + 1):
        ranked = positions(frontier, ["url"]).withColumn("taken", F.col("position") < most - visited)
        level = checkpoint(ranked.select("url", "taken"))
        links = checkpoint(page_links(fetch_pages(level.where("taken").select("url"))).where(F.col("link").startswith(F.col("url"))).select("link").distinct())
        visited += level.where("taken").count()
        here = links.where(~F.col("link").endswith("/")).select("link", F.lit(depth).alias("depth"), F.lit("file").alias("kind"))
        here = here.unionByName(level.where("not taken").select(F.col("url").alias("link"), F.lit(depth).alias("depth"), F.lit("not_visited").alias("kind")))
        out = here if out is None else out.unionByName(here)
        below = links.where(F.col("link").endswith("/")).select(F.col("link").alias("url"))
        for s in skip:
            below = below.where(~F.lower("url").rlike(rf"/{s}/$"))
        frontier = checkpoint(below.join(seen, "url", "left_anti"))
        seen = seen.union(frontier)
    left = frontier.select(F.col("url").alias("link"), F.lit(max_depth + 1).alias("depth"), F.lit("not_visited").alias("kind"))
    return out.unionByName(left).groupBy("link", "kind").agg(F.min("depth").alias("depth")).select("link", "depth", "kind")
