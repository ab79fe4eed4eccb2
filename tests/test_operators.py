import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import audit, dedup, monitors, recommend, router, search, signals
from stratalens.rules import DOMAIN
from stratalens.sources import feeds, pages, schemas

AS_OF = "2026-06-23 00:59:00"
DOCS = "id long, title string, clean_text string, topic string, trust_score double, source_type string, source_name string, published timestamp"


@pytest.fixture(scope="module")
def docs(spark):
    long = " filler text that makes the document long enough for signals"
    rows = [
        (1, "FCAS dispute", "Dassault and Airbus delay the fighter contract." + long, "FCAS", 0.95, "news", "Reuters", None),
        (2, "Satellite launch", "Military satellite with secure communications, resilience and growth." + long, "Military Space", 0.0, "official", "Airbus", None),
        (3, None, "NATO procurement budget approval for drones." + long, None, None, None, None, None),
        (4, "Short", "x" * 40, "FCAS", 0.9, "news", "Reuters", None),
        (5, "Eurofighter", "Typhoon radar upgrade with Leonardo and Saab." + long, "Eurofighter", 0.8, "news", "", None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def found(docs):
    return signals.detect(docs, DOMAIN, AS_OF)


def sequential(rows, stored=()):
    urls, hashes, out = {s[0] for s in stored}, {s[1] for s in stored}, []
    for i, u, h in rows:
        if (u is not None and u in urls) or (h is not None and h in hashes):
            continue
        out.append(i)
        urls.add(u)
        hashes.add(h)
    return out


@pytest.mark.parametrize(("rows", "kept"), [([("u1", "h1"), ("u2", "h1"), ("u2", "h2")], [0, 2]), ([("u1", "h1"), ("u1", "h2"), ("u2", "h2")], [0, 2])])
def test_admit_small(spark, rows, kept):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, url string, content_hash string")
    assert sorted(r["seq"] for r in dedup.admit(frame).collect()) == kept


def test_admit_equals_one_by_one(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, "", *(f"u{k}" for k in range(12))]), rnd.choice([None, *(f"h{k}" for k in range(15))])) for i in range(80)]
    stored = [("u3", "h4"), ("zz", "h7"), (None, None)]
    frame = spark.createDataFrame(rows, "seq long, url string, content_hash string")
    assert sorted(r["seq"] for r in dedup.admit(frame).collect()) == sequential(rows)
    kept = dedup.admit(frame, spark.createDataFrame(stored, "url string, content_hash string"))
    assert sorted(r["seq"] for r in kept.collect()) == sequential(rows, [s for s in stored if s[0]])
    assert dedup.admit(frame.filter("false")).count() == 0


def test_signals(found):
    rows = {(r["document_id"], r["title"]): r for r in found.collect()}
    assert (1, "Programme governance dispute") in rows and not [k for k in rows if k[0] == 4]
    r = rows[1, "Programme governance dispute"]
    assert r["signal_type"] == "risk" and r["entities"] == ["Airbus", "Dassault", "FCAS"]
    assert float(r["confidence_score"]) == pytest.approx(0.40 * 0.95 + 0.25 * 0.55 + 0.25 * 0.88 + 0.03, abs=6e-4)
    third = [r for k, r in rows.items() if k[0] == 3]
    assert {r["topic"] for r in third} == {DOMAIN.default_topic}


def test_recommendations(found, spark):
    recs = recommend.recommendations(found, DOMAIN).collect()
    assert recs and all(r["evidence_count"] >= 2 and 0 < r["confidence_score"] <= 1 for r in recs)
    ranks = [{"High": 1, "Medium": 2}.get(r["priority"], 3) for r in recs]
    assert ranks == sorted(ranks)
    evidence = recommend.evidence(found, DOMAIN)
    assert evidence.filter("rank > 8").count() == 0
    links = recommend.unsupported(spark.createDataFrame([(0, "a"), (99, "b")], "recommendation_id int, recommendation string"), evidence).collect()
    assert {r["recommendation_id"]: r["links"] > 0 for r in links} == {0: True, 99: False}
    everything = recommend.related(recommend.recommendations(found, DOMAIN), None, "zzzzzz qqqqqq")
    assert everything.count() == min(6, len(recs))


def test_audit(docs, found, spark):
    gaps = spark.createDataFrame(
        [(None, "t", "x" * 300, 0.5, "x"), ("", None, "x", None, "x"), ("u", "", None, 0.1, None), ("u", "t", "", 0.1, None), ("u", "t", "", 0.1, "")],
        "url string, topic string, clean_text string, trust_score double, content_hash string",
    )
    r = audit.data_gaps(gaps).first()
    assert (r["without_url"], r["without_topic"], r["short_text"], r["without_trust"], r["duplicates"]) == (3, 3, 4, 1, 3)
    assert {r["source_type"] for r in audit.source_type_summary(docs).collect()} == {"news", "official"}
    assert audit.topic_coverage(docs, found.filter("false")).agg(F.sum("signals")).first()[0] == 0
    assert audit.source_type_summary(docs.filter("false")).count() == 0
    counts = spark.createDataFrame([(190, 136, 199, 595, 6, 48, 0, 6, 0)], "documents long, sources long, chunks long, signals long, recommendations long, evidence long, unsupported long, answers long, weak_answers long")
    s = audit.evaluation_summary(audit.checks(counts)).first()
    assert (s["total"], s["passed"], s["score"], s["grade"]) == (9, 9, 1.0, "Production-demo ready")
    nothing = spark.createDataFrame([(0,) * 9], counts.schema)
    assert audit.evaluation_summary(audit.checks(nothing)).first()["grade"] == "Not ready"


def test_monitors(docs, found):
    radar = {r["entity"]: r["mentions"] for r in monitors.radar(docs, DOMAIN).collect()}
    assert radar["NATO"] == 1 and radar["Boeing"] == 0
    partners = monitors.partner_mentions(docs, DOMAIN).collect()
    assert len(partners) == 8 and partners[0]["mentions"] >= partners[-1]["mentions"]
    unit = monitors.profile(DOMAIN, "Military Space", docs, found, recommend.recommendations(found, DOMAIN))
    assert 2 in {r["id"] for r in unit.documents.collect()} and unit.of_kind("trend").count() >= 1 and unit.recommendations.count() >= 1
    with pytest.raises(ValueError):
        monitors.find_unit(DOMAIN, "nobody")
    assert [r["id"] for r in monitors.keyword_browser(docs, "SATELLITE", "Military Space").collect()] == [2]


def test_search(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(200)] + [(300, None, 0), (301, [1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    query = [0.5, -0.1, 0.3, 0.2, 0.9, -0.7]
    score = {i: sum(a * b for a, b in zip(v, query, strict=True)) for i, v, _ in rows[:200]}
    best = sorted(score, key=lambda i: (-score[i], i))
    assert [r["vec_id"] for r in search.search(frame, query, 8).collect()] == best[:8]
    assert search.overfetch(8) == 40 and search.overfetch(3) == 25
    got = [r["vec_id"] for r in search.search(frame, query, 8, F.col("label") == 1).collect()]
    assert got == [i for i in best[:40] if i % 3 == 1][:8]


def test_pages_and_feeds(spark):
    html = '<html><head><title>A &amp; B</title></head><nav><p>menu</nav><p>One <b>x</b><p>Two</p> tail <a href="/space/1">l</a><a href="/space/1">l</a><a href="https://other/space">o</a><a href="/none">n</a>'
    frame = spark.createDataFrame([(1, "https://h.example/start", html), (2, "https://h.example/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.page_text(frame).collect()}
    assert got[1]["title"] == "A & B" and got[1]["text"].startswith("One x Two") and got[1]["n_paragraphs"] == 2 and got[2]["text"] == ""
    links = [r["link"] for r in pages.links(frame).filter("page_id = 1").orderBy("rank").collect()]
    assert links == ["https://h.example/start", "https://h.example/space/1"]
    entries = [(i, f"q{i % 2}", i, t, f"u{i % 5}", None, "Reuters", "Fri, 13 Mar 2026 07:00:00 GMT") for i, t in enumerate(["FCAS news", "abcd", "Satellite &amp; more", "Third one", "Fourth one", "Fifth one", "Sixth one"])]
    feed = spark.createDataFrame(entries, "seq long, query string, position int, title string, url string, summary string, source_name string, published_at string")
    out = feeds.admit_items(feed, DOMAIN, per_query=3, total=3).collect()
    assert [r["seq"] for r in out] == [0, 2, 3] and out[0]["topic"] == "FCAS" and out[0]["trust_score"] == 0.90 and out[1]["title"] == "Satellite & more"
    assert feeds.registry(spark).count() == 10
    assert spark.range(1).select(feeds.query_url(F.lit("a b&c"))).first()[0].endswith("q=a+b%26c")
    assert schemas.empty(spark, "documents").count() == 0


def test_answers(spark, found):
    assert router.signals_for(found, "risk_analysis", None).filter("signal_type <> 'risk'").count() == 0
    log = spark.createDataFrame([(0.5, 3), (0.7, None)], "confidence_score double, evidence_count int")
    r = router.qa_metrics(log).first()
    assert (r["sessions"], r["avg_confidence"], r["evidence"], r["weak_answers"]) == (2, 0.6, 3, 1)
    value = lambda *x: spark.range(1).select(router.answer_confidence(*[F.lit(v).cast("double") for v in x])).first()[0]
    assert value(None, None, None, 0) == 0 and value(0.7, 0.8, 0.6, 5) == pytest.approx(0.755)
    text = router.compose("Why?", {"intent": "x", "topic": None}, [], [], [], [], 0.2)
    assert "thin" in text


def test_dense_ids(spark):
    rows = [(d * 10**12 + 7, c) for d in range(200, 0, -1) for c in range(3)]
    got = signals.dense_ids(spark.createDataFrame(rows, "document_id long, chunk_index int")).orderBy("document_id", "chunk_index").collect()
    assert [r["faiss_id"] for r in got] == list(range(600))
    assert signals.dense_ids(spark.createDataFrame([], "document_id long, chunk_index int")).count() == 0
