"""Text and links of landed web pages, without a parser per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, unescape

BLOCKS = r"(?is)<(script|style|nav|footer|header|aside)\b.*?</\1\s*>"
#: Spaces, those beyond ASCII included, that a paragraph neither begins nor ends with.
EDGE = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Fixed value: what a company page's address holds at least one of.
TOKENS = ("defence", "newsroom", "fcas", "eurofighter", "a400m", "mrtt", "space", "military", "uav", "drone")


def title(html: Column, decode: Callable[[Column], Column] = unescape) -> Column:
    return clean(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def paragraphs(html: Column) -> Column:
    """Texts of paragraphs; one that isn't closed ends where the next begins."""
    bare = F.regexp_replace(html, BLOCKS, "")
    parts = F.split(bare, r"(?i)<p\b[^>]*>")
    texts = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.btrim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(s, "(?i)</p>"), 1), "<[^>]*>", " "), r"\s+", " "), F.lit(EDGE)))
    return F.filter(texts, lambda t: t != "")


def page_text(pages: DataFrame, decode: Callable[[Column], Column] = unescape) -> DataFrame:
    """(page_id, url, title, n_paragraphs, text) of each page; null html is an empty page. ``decode`` reads the title's character references."""
    rows = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("_p", paragraphs(F.col("html")))
    return rows.select("page_id", "url", title(F.col("html"), decode).alias("title"), F.size("_p").alias("n_paragraphs"), F.array_join("_p", " ").alias("text"))


def body_or_fallback(text: Column, heading: Column, summary: Column, query: Column, least: int = 300) -> Column:
    """A page's text or, where it is short, a line made of what is known of it."""
    made = F.concat(heading, F.lit(". "), F.coalesce(summary, F.lit("")), F.lit(". Search query: "), query)
    return F.when(F.length(text) < least, made).otherwise(text)


def links(pages: DataFrame, tokens: tuple[str, ...] = TOKENS, max_links: int = 20) -> DataFrame:
    """(page_id, rank, link): the page's own address, then its distinct links on the same host with a token, in order."""
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    found = pages.select("page_id", "url", base.alias("base"), F.posexplode(F.concat(F.array("url"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?i)href="([^"]*)"'), F.lit(1)))).alias("pos", "href"))
    link = F.when(F.col("pos") == 0, F.col("url")).when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href")).when(F.startswith("href", F.lit("/")), F.concat("base", "href")).otherwise(F.col("href"))
    found = found.withColumn("link", link)
    wanted = F.lit(False)
    for t in tokens:
        wanted = wanted | F.contains(F.lower("link"), F.lit(t))
    found = found.filter((F.col("pos") == 0) | ((F.regexp_extract("link", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1) == F.col("base")) & wanted))
    first = found.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    return ranked.filter(F.col("rank") <= max_links).select("page_id", "rank", "link")
