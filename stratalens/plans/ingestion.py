"""Registered queries of ingestion, stored tables, answers and profiles, over the synthetic tables with the sample pack."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, scores, text
from ..operators import browse, dedup, monitors, recommend, router, search, summaries
from ..rules import SAMPLE as PACK
from ..session import shared_folder, stored
from ..sources import archives, feeds
from ..sources.store import Store
from .queries import AS_OF, TOKENS, found_signals, qa_log, table
from .queries import _as_double as as_double
from .queries import _gappy as gappy
from .queries import _recs as recommendation_rows
from .queries import documents as corpus_documents

HREF = r'(?i)href="([^"]*)"'


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Landed feed entries: a page's title, the beginning of a document as summary, the time of an event; some titles are too short, some fields missing."""
    about = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "source", F.substring("text", 1, 150).alias("start"))
    times = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    heads = table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("head"))
    rows = heads.join(about, "seq").join(times, "seq")
    seq, third = F.col("seq"), F.col("seq") % 3
    return rows.select(
        "seq",
        F.concat(F.lit("query "), (seq % 7).cast("string")).alias("query"),
        (seq % 45).cast("int").alias("position"),
        F.when(seq % 17 == 0, "ab").otherwise(F.col("head")).alias("title"),
        F.concat(F.lit("https://news.example/"), (seq % 211).cast("string")).alias("url"),
        F.when(seq % 5 == 0, None).otherwise(F.col("start")).alias("summary"),
        F.when(third == 0, F.concat(F.lit("Reuters "), "source")).when(third == 1, F.col("source")).alias("source_name"),
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("published_at"),
    )


def q_feed_items(spark, d):
    rows = feeds.admit_items(entries(spark, d), PACK, per_query=20, total=100)
    return rows.select("seq", "title", "source_type", "topic", "trust_score", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "content_hash", F.sha2("clean_text", 256).alias("body"))


def q_feed_news(spark, d):
    pages = table(spark, d, "pages")
    seq = F.col("seq")
    targets = pages.select(F.col("page_id").alias("target"), F.col("url").alias("page_url"))
    rows = entries(spark, d).withColumn("target", seq - seq % 2).join(targets, "target")
    rows = rows.withColumn("url", F.when(seq % 9 == 0, F.concat(F.lit("https://gone.example/"), seq.cast("string"))).otherwise(F.col("page_url"))).drop("page_url", "target")
    out = feeds.admit_news(rows, pages, PACK, per_query=20, total=90)
    return out.select("seq", "title", "url", "topic", "trust_score", "content_hash")


def q_crawl(spark, d):
    """Pages of one host, each named by a link of its own, so that links lead from page to page."""
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://site.example"), F.regexp_extract("html", HREF, 1)).alias("url"), "html")
    landed = dedup.first_by(pages, "url", "page_id")
    # sixty addresses
    seeds = [r["url"] for r in pages.filter("page_id < 60").orderBy("page_id").select("url").collect()]
    out = feeds.crawl(landed, list(dict.fromkeys(seeds)), PACK, limit=40, tokens=TOKENS)
    return out.select("seq", "title", "url", "topic", "content_hash")


def q_admitted(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("seq"), F.lit("T").alias("title"), F.concat(F.lit("https://x.example/"), (F.col("n_chars") % 1701).cast("string")).alias("url"), "text")
    known = rows.filter(F.col("seq") % 50 == 0).select("url", F.lit("-").alias("content_hash"))
    return feeds.admit_pages(rows.filter(F.col("seq") % 50 != 0), PACK, known).select("seq", "url", "topic", "content_hash")


def _generation(spark: SparkSession):
    return Store(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}").current()


def q_stored_recommendations(spark, d):
    """Recommendations and evidence appended twice under one batch's name, and joined as they are stored."""
    found = stored(found_signals(spark, d).drop("entities", "evidence_text"))
    tables = _generation(spark)
    recs, links = stored(recommend.recommendations(found, PACK)), stored(recommend.evidence(found, PACK))
    for _ in range(2):
        recommend.store(tables, recs, links, "rebuild")
    named = tables.read("recommendations").select(F.col("id").alias("recommendation_id"), "title", "priority", "confidence_score")
    return tables.read("recommendation_evidence").join(named, "recommendation_id").select("recommendation_id", "title", "priority", "confidence_score", "document_id", "evidence_strength")


def q_stored_sources(spark, d):
    """The registry's sources stored first, then the corpus's own, in two batches: names that are there keep their row."""
    tables = _generation(spark)
    tables.append("sources", feeds.registry(spark), "registry")
    seen = table(spark, d, "documents").select(F.col("source").alias("name"), F.lit("news").alias("source_type"), F.lit(None).cast("string").alias("base_url"), feeds.news_trust(F.col("source")).alias("trust_score")).distinct()
    again = spark.createDataFrame([("NATO", "other", None, 0.1)], "name string, source_type string, base_url string, trust_score double")
    for batch in ("corpus", "corpus"):
        tables.append("sources", seen.unionByName(again), batch)
    return tables.read("sources").select("id", "name", "source_type", "base_url", "trust_score")


ROUTES = (("risk_analysis", "English"), ("opportunity_analysis", None), ("partnership_strategy", "German"), ("general_strategy", "Romance"))


def q_route_signals(spark, d):
    found = stored(found_signals(spark, d).drop("entities", "evidence_text"))
    out = None
    for i, (intent, topic) in enumerate(ROUTES):
        part = router.signals_for(found, intent, topic).select(F.lit(i).alias("route"), "document_id", "rule", "signal_type", "topic", "confidence_score")
        out = part if out is None else out.unionByName(part)
    return as_double(out)


def q_augmented(spark, d):
    asked = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    routed = router.route_questions(asked)
    topic = F.when(F.col("conv_id") % 2 == 0, F.coalesce("topic", F.lit("Topic")))
    return routed.select("conv_id", "turn", F.sha2(router.augmented(F.col("question"), topic, F.col("business_area")), 256).alias("query_sha"))


def q_answer_bands(spark, d):
    log = qa_log(spark, d)
    score = F.col("confidence_score") * 2
    return log.select("id", scores.band(score).alias("band"), scores.needs_guardrail(F.col("evidence_count"), F.col("confidence_score")).alias("guarded"))


def q_reply_markup(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    thought = F.concat(F.lit("<Think>first\n\"a\" & <b></think>  "), F.col("text"), F.lit("\n**so**"))
    said = text.strip_thinking(thought)
    return rows.select("conv_id", "turn", F.sha2(said, 256).alias("said"), F.sha2(text.flatten_markdown(thought), 256).alias("flat"))


def q_answer_confidence(spark, d):
    """Answers scored from evidence, the ten best signals of their topic and all recommendations; sources of those signals count, one without a name too."""
    found = stored(found_signals(spark, d).drop("entities", "evidence_text"))
    log = qa_log(spark, d).withColumn("topic", labels.first_match(F.lower("question"), PACK.topics, PACK.default_topic))
    best = dedup.top_per(found, "topic", 10, F.desc("confidence_score"), F.desc("impact_score"), F.desc("urgency_score"), "document_id", "rule")
    name = F.when(~F.col("source_name").isin("src5", "src13"), F.col("source_name"))
    means = best.groupBy("topic").agg(F.avg("confidence_score").cast("double").alias("signal"), F.count_distinct(F.coalesce(name, F.lit("-"))).alias("sources"))
    recs = recommend.recommendations(found, PACK).agg(F.avg("confidence_score").alias("rec"))
    rows = log.join(F.broadcast(means), "topic", "left").crossJoin(F.broadcast(recs))  # a row for each topic of the pack; one row
    # to nine places first, so that sums in another order round alike
    nine = lambda c: F.round(c, 9)
    score = router.answer_confidence(nine(F.col("evidence_count") / 10), nine(F.col("signal")), nine(F.col("rec")), F.coalesce("sources", F.lit(0)))
    return rows.select("id", "topic", score.alias("confidence"))


def q_unit_profile(spark, d):
    """A unit's documents, signals of each kind, summaries and recommendations as one table of (section, label, amount, mean)."""
    docs = stored(corpus_documents(spark, d).withColumn("trust_score", F.col("trust_score").cast("double")))
    found = stored(as_double(found_signals(spark, d).drop("entities")))
    unit = monitors.profile(PACK, PACK.units[1].name, docs, found, stored(recommend.recommendations(found_signals(spark, d), PACK)))
    row = lambda section, label, amount, mean: [F.lit(section).alias("section"), label.cast("string").alias("label"), amount.cast("long").alias("amount"), mean.cast("double").alias("mean")]
    none = F.lit(None)
    parts = [
        unit.documents.groupBy("topic").count().select(*row("documents", F.col("topic"), F.col("count"), none)),
        *[unit.of_kind(kind).agg(F.count("*").alias("n")).select(*row("kind", F.lit(kind), F.col("n"), none)) for kind in ("opportunity", "risk", "trend")],
        unit.signal_summary.select(*row("signals", F.col("signal_type"), F.col("signals"), F.col("avg_confidence"))),
        unit.source_summary.select(*row("sources", F.col("source_type"), F.col("documents"), F.col("avg_trust"))),
        unit.recommendations.select(*row("recommendations", F.col("recommendation"), F.col("evidence_count"), F.col("confidence_score"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_page_archives(spark, d):
    """All pages through archives and back."""
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.write(table(spark, d, "pages"), path)
    return archives.read(spark, path).select("page_id", "url", F.sha2("html", 256).alias("html_sha"))


def q_vector_topk_many(spark, d):
    """The eight nearest of all vectors for every vector whose id 20 divides."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.search_many(vectors, asked, 8).select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


def q_indexed_browser(spark, d):
    """Keywords found by the trigram index: a common one, one of a topic, a rare one, and one that is too short for the index."""
    path = browse.new_path(shared_folder(spark))
    browse.build(corpus_documents(spark, d), path)
    out = None
    for i, (keyword, topic) in enumerate((("License", None), ("tionen", "German"), ("XQZ", None), ("@", "Contact"), ("therre", None))):
        part = browse.search(spark, path, keyword, topic, 40).select(F.lit(i).alias("search"), "id", "topic")
        out = part if out is None else out.unionByName(part)
    return out


def q_kept_summaries(spark, d):
    """Summaries after three batches of the corpus, each added once: (section, label, documents, mean, others)."""
    docs = stored(gappy(corpus_documents(spark, d)))
    path = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    for n in range(3):
        summaries.update(path, docs.filter(F.col("id") % 3 == n), PACK, AS_OF, n)
    row = lambda section, label, documents, mean, others: [F.lit(section).alias("section"), label.alias("label"), documents.cast("long").alias("documents"), mean.cast("double").alias("mean"), others.cast("long").alias("others")]
    gaps = summaries.data_gaps(spark, path)
    card = summaries.quality_scorecard(spark, path, PACK, recommendation_rows(spark))
    parts = [
        summaries.source_type_summary(spark, path).select(*row("type", F.col("source_type"), F.col("documents"), F.col("avg_trust"), F.col("sources"))),
        summaries.topic_coverage(spark, path).select(*row("topic", F.concat_ws(": ", "topic", "source_types"), F.col("documents"), F.col("avg_confidence"), F.col("signals"))),
        gaps.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in gaps.columns])).alias("g")).select(*row("gaps", F.col("g.k"), F.col("g.v"), F.lit(None), F.lit(None))),
        card.select(*row("score", F.lit("quality"), F.col("documents"), F.col("quality_score"), F.col("chunks"))),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


QUERIES = {
    "kept_summaries": q_kept_summaries,
    "page_archives": q_page_archives,
    "vector_topk_many": q_vector_topk_many,
    "indexed_browser": q_indexed_browser,
    "feed_items": q_feed_items,
    "feed_news": q_feed_news,
    "official_crawl": q_crawl,
    "admitted_documents": q_admitted,
    "stored_recommendations": q_stored_recommendations,
    "stored_sources": q_stored_sources,
    "route_signals": q_route_signals,
    "augmented_questions": q_augmented,
    "answer_bands": q_answer_bands,
    "reply_markup": q_reply_markup,
    "answer_confidence": q_answer_confidence,
    "unit_profile": q_unit_profile,
}
