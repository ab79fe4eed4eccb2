"""Landed feed entries, and the registry of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, scores, text
from ..rules.pack import Pack
from . import pages

# Registered sources with type, address and trust.
SOURCES = (
    ("Airbus Newsroom", "official", "https://www.airbus.com/en/newsroom", 0.95),
    ("Airbus Defence", "official", "https://www.airbus.com/en/products-services/defence", 0.95),
    ("Reuters Aerospace and Defence", "news", "https://www.reuters.com/business/aerospace-defense/", 0.90),
    ("Defense News", "news", "https://www.defensenews.com", 0.82),
    ("Breaking Defense", "news", "https://breakingdefense.com", 0.82),
    ("NATO", "policy", "https://www.nato.int", 0.90),
    ("European Defence Agency", "policy", "https://eda.europa.eu", 0.88),
    ("Dassault Aviation", "competitor", "https://www.dassault-aviation.com", 0.85),
    ("BAE Systems", "competitor", "https://www.baesystems.com", 0.85),
    ("Boeing Defense", "competitor", "https://www.boeing.com/defense", 0.85),
)
TRUSTED_NEWS = ("reuters", "airbus", "nato", "defense news", "breaking defense")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SOURCES)], "seq int, name string, source_type string, base_url string, trust_score double")


def query_url(query: Column, base: str = "https://news.example/rss/search?q=") -> Column:
    """A feed address for a search; spaces become plus signs."""
    return F.concat(F.lit(base), F.url_encode(query))


def trust_by_name(name: Column, pack: Pack) -> Column:
    return labels.first_value(F.lower(F.coalesce(name, F.lit(""))), pack.name_trust, pack.default_name_trust).cast("double")


def news_trust(name: Column) -> Column:
    return F.when(text.contains_any(F.lower(F.coalesce(name, F.lit(""))), TRUSTED_NEWS), 0.88).otherwise(0.72)


def admit_items(entries: DataFrame, pack: Pack, per_query: int = 20, total: int = 150) -> DataFrame:
    """Feed entries (seq, query, position, title, url, summary, source_name, published_at) as documents.

    At most ``per_query`` of each search and, once duplicates of url or content are
    gone, ``total`` in all, in order of ``seq``; titles of under five characters are
    refused.
    """
    from ..operators.dedup import admit

    rows = entries.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("position", "seq"))).filter(F.col("_n") <= per_query).drop("_n")
    rows = rows.withColumn("title", text.clean(text.unescape(F.col("title")))).filter(F.length("title") >= 5)
    body = F.format_string("Title: %s. Source: %s. Query: %s. Published: %s. Summary: %s", "title", F.coalesce("source_name", F.lit("")), "query", F.coalesce("published_at", F.lit("")), F.coalesce("summary", F.lit("")))
    topic_text = F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), "query"))
    rows = rows.withColumns(
        {
            "clean_text": body,
            "raw_text": body,
            "source_type": F.lit("news"),
            "topic": labels.first_match(topic_text, pack.topics, pack.default_topic),
            "trust_score": trust_by_name(F.col("source_name"), pack),
            "published": scores.feed_date(F.col("published_at")),
            "content_hash": text.content_hash(F.concat_ws(" ", "title", "url", F.coalesce("summary", F.lit("")))),
        }
    )
    return admit(rows).orderBy("seq").limit(total)


def admit_pages(rows: DataFrame, pack: Pack, stored: DataFrame | None = None, least: int = 250) -> DataFrame:
    """Crawled pages (seq, title, url, text) as documents: short texts and known urls or contents are refused."""
    from ..operators.dedup import admit

    made = rows.withColumn("clean_text", text.clean(F.col("text"))).filter(F.length("clean_text") >= least)
    topic = labels.first_match(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "clean_text")), pack.topics, pack.default_topic)
    return admit(made.withColumns({"content_hash": text.content_hash(F.col("clean_text")), "topic": topic}), stored)


def crawl(landed: DataFrame, seeds: list[str], pack: Pack, stored: DataFrame | None = None, limit: int = 40, tokens: tuple[str, ...] = pages.TOKENS) -> DataFrame:
    """Pages (page_id, url, html) that the seed pages lead to, as documents: at most 20 links of each seed, distinct in order, the first ``limit`` that are accepted."""
    spark = landed.sparkSession
    order = spark.createDataFrame(list(enumerate(seeds)), "seed int, url string")
    start = landed.join(F.broadcast(order), "url").select("page_id", "url", "html", "seed")
    found = pages.links(start, tokens).join(start.select("page_id", "seed"), "page_id")
    found = found.groupBy(F.col("link").alias("url")).agg(F.min(F.col("seed") * 1000 + F.col("rank")).cast("long").alias("seq"))
    rows = pages.page_text(landed.join(found.select("url"), "url", "left_semi")).join(found, "url")
    titled = F.when(F.length("title") > 0, F.col("title")).otherwise("Official page")
    return admit_pages(rows.select("seq", titled.alias("title"), "url", "text"), pack, stored).orderBy("seq").limit(limit)


def admit_news(entries: DataFrame, landed: DataFrame, pack: Pack, stored: DataFrame | None = None, per_query: int = 20, total: int = 160) -> DataFrame:
    """News entries (seq, query, position, title, url, summary, source_name) as documents, with the text of the page each points to.

    Where the page is missing or short, what the entry says stands in for it.
    """
    rows = entries.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("position", "seq"))).filter(F.col("_n") <= per_query).drop("_n")
    rows = rows.withColumn("title", F.trim(text.unescape(F.col("title"))))
    rows = rows.join(pages.page_text(landed).select("url", F.col("text").alias("page")), "url", "left")
    body = pages.body_or_fallback(F.coalesce("page", F.lit("")), F.col("title"), F.col("summary"), F.col("query"))
    rows = rows.select("seq", "title", "url", body.alias("text"), F.lit("news").alias("source_type"), news_trust(F.col("source_name")).alias("trust_score"))
    return admit_pages(rows, pack, stored).orderBy("seq").limit(total)
