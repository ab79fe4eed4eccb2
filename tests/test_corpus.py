"""Sources, retrieval, answers and stored tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from stratalens import session
from stratalens.functions import scores
from stratalens.operators import audit, corpus, dedup, router, search
from stratalens.rules import DOMAIN, SAMPLE
from stratalens.sources import feeds, pages, schemas

DOCS = "id long, source_id long, title string, url string, clean_text string, source_type string, topic string, collected_at string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, 10, "A", "u1", "x" * 60, "news", "FCAS", "2026-01-01 00:00:00"), (2, 99, None, None, "y", "news", None, None), (3, None, "C", "u3", "z", None, "FCAS", "2026-03-04 05:06:07.8"), (4, 11, "D", "u4", "w", "official", "FCAS", "2025-01-01 00:00:00")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(10, "One", 0.5), (11, "Two", None), (12, "Three", 0.9)], "id long, name string, trust_score double")


def test_left_joins_keep_documents_without_a_source(spark, docs, sources):
    assert {r["id"]: r["source_name"] for r in corpus.with_source(docs, sources).collect()} == {1: "One", 2: None, 3: None, 4: "Two"}
    signals = spark.createDataFrame([(1, 0, "T", 0.9, 0.5, 0.5), (77, 0, "T", 0.8, 0.5, 0.5), (2, 0, "U", 0.7, 0.5, 0.5)], "document_id long, rule int, title string, confidence_score double, impact_score double, urgency_score double")
    got = {r["document_id"]: (r["source_name"], r["url"]) for r in corpus.signals_with_sources(signals, docs, sources).collect()}
    assert got == {1: ("One", "u1"), 77: (None, None), 2: (None, None)}
    assert [r["document_id"] for r in corpus.supporting_signals(signals, docs, sources, ["T"]).collect()] == [1]
    evidence = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 77, 0.8), (1, 1, 4, 0.7), (5, 1, 4, 0.7)], "recommendation_id int, rank int, document_id long, evidence_strength double")
    recs = spark.createDataFrame([(0, "R0"), (1, "R1")], "recommendation_id int, recommendation string")
    assert {(r["recommendation_title"], r["document_id"], r["source_name"]) for r in corpus.evidence_explorer(evidence, recs, docs, sources).collect()} == {("R0", 1, "One"), ("R1", 4, "Two")}
    assert {(r["recommendation_id"], r["document_id"]) for r in corpus.top_evidence_documents(evidence, docs, sources, 1).collect()} == {(0, 1), (1, 4), (5, 4)}
    assert [(r["name"], r["documents"]) for r in corpus.largest_sources(docs, sources).collect()] == [("One", 1), ("Two", 1)]
    assert [r["name"] for r in corpus.source_audit(sources).collect()] == ["Three", "One", "Two"]
    assert corpus.latest_update(docs).first()[0] == "2026-03-04T05:06:07" and corpus.latest_update(docs.filter("false")).first()[0] is None
    assert corpus.by_id(docs, 3).count() == 1 and corpus.by_id(docs, 30).count() == 0


def test_first_of_each_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "seq long, name string")
    assert sorted(r["seq"] for r in dedup.first_by(rows, "name", "seq").collect()) == [1, 3, 4, 5]
    stored = spark.createDataFrame([("b",)], "name string")
    assert sorted(r["seq"] for r in dedup.get_or_create(rows, stored).collect()) == [1, 3, 4]


def test_catalog_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    spark.catalog.setCurrentDatabase("kept")
    try:
        schemas.create_tables(spark)
        schemas.create_tables(spark)  # those that are there stay
        spark.createDataFrame([(7, 1, 0, "a b", 2, None), (8, 1, 1, "c", 1, None)], schemas.SCHEMAS["document_chunks"].replace(" not null", "")).write.mode("append").saveAsTable("document_chunks")
        assert session.count_table(spark, "document_chunks") == 2 and session.count_table(spark, "nothing") == 0
        assert session.read_df(spark, "SELECT * FROM document_chunks WHERE chunk_index = ?", 1).count() == 1
        assert session.read_df(spark, "SELECT * FROM document_chunks").count() == 2
        assert session.metric_value(spark, "SELECT count(*) FROM document_chunks") == 2 and session.metric_value(spark, "SELECT id FROM signals") is None
        schemas.reset(spark, "document_chunks")
        assert session.count_table(spark, "document_chunks") == 0
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_retrieval(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    chunks = spark.createDataFrame([(i, 1 + i % 2, i, f"text {'satellite' if i == 5 else i}") for i in range(6)], "faiss_id long, document_id long, chunk_index int, chunk_text string")
    docs = spark.createDataFrame([(1, None, "u", "FCAS", "news", "s"), (2, "Space", "u", "Other", "news", None)], "id long, title string, url string, topic string, source_type string, source_name string")
    got = search.retrieve(vectors, chunks, docs, [1.0, 0.0], 2, topic="FCAS", source_type="news").collect()
    assert [(r["vec_id"], r["score"], r["document_id"]) for r in got] == [(4, 4.0, 1), (2, 2.0, 1)]
    out = {r["probe"]: r for r in search.probe(vectors, chunks, docs, [([1.0, 0.0], ("Satellite", "space", "none")), ([0.0, 0.0, 1.0], ("x",))], 2).collect()}
    assert (out[0]["results"], out[0]["mean_score"], out[0]["matched"], out[0]["passed"]) == (2, 4.5, "Satellite, space", True)
    assert (out[1]["results"], out[1]["mean_score"], out[1]["matched"], out[1]["passed"]) == (0, 0.0, "", False)
    vectors.write.parquet(str(tmp_path / "vectors"))
    assert search.load_vectors(spark, str(tmp_path / "vectors")).count() == 6
    nothing = search.load_vectors(spark, str(tmp_path / "no vectors"))
    assert nothing.count() == 0 and search.search(nothing, [1.0, 0.0]).count() == 0
    encoded = spark.createDataFrame([("ab",), (None,)], "t string").select(search.encode(F.col("t"), lambda texts: [[float(len(t))] for t in texts]).alias("v")).collect()
    assert [r["v"] for r in encoded] == [[2.0], [0.0]]


def test_questions(spark):
    asked = spark.createDataFrame([(1, "Which partner for Saab?", None), (2, "What now, Indra?", ""), (3, "Which country?", "seen with OHB")], "id long, question string, evidence_text string")
    mentions = spark.createDataFrame([(n, 3 if n == "Thales" else 0) for n, _ in DOMAIN.partners], "name string, mentions long")
    got = {(r["id"], r["name"], r["relevance"]) for r in router.partners_for(asked, mentions, DOMAIN).collect()}
    assert got == {(1, "Saab", 0.55), (1, "Thales", 0.76), (3, "OHB", 0.55), (3, "Thales", 0.76)}
    log = router.qa_log(asked.select("id", "question", F.lit("a").alias("answer_markdown"), F.lit(0.5).alias("confidence_score"), F.lit(0).alias("evidence_count")))
    assert [r["id"] for r in router.recent(log, 2).collect()] == [3, 2]
    assert [(r["intent"], r["questions"]) for r in router.intents(log).collect()] == [("general_strategy", 2), ("partnership_strategy", 1)]
    rows = log.withColumn("signals", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.alias("n"))))
    pack = json.loads(rows.select(router.evidence_pack(rows).alias("p")).first()["p"])
    assert len(pack["strategic_signals"]) == 8 and pack["retrieved_evidence"] == [] and pack["query_route"]["region"] is None
    text = spark.range(1).select(router.augmented(F.lit("q"), F.lit("FCAS"), F.lit(None).cast("string")).alias("x")).first()["x"]
    assert text == "q Airbus FCAS"


def test_crawl_and_news(spark):
    body = "Satellite services for everyone. " * 12
    page = lambda links, text: "<title>T</title>" + "".join(f'<a href="{x}">' for x in links) + f"<p>{text}</p>"
    rows = [(1, "https://h.example/space", page(["/space/b", "/space/a", "/other"], "short")), (2, "https://h.example/space/a", page([], body)), (3, "https://h.example/space/b", page([], body + "more")), (4, "https://h.example/other", page([], body + "other")), (5, "https://n.example/1", page([], body + "news"))]
    landed = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = feeds.crawl(landed, ["https://h.example/space"], DOMAIN).collect()
    assert [r["url"] for r in got] == ["https://h.example/space/b", "https://h.example/space/a"] and {r["topic"] for r in got} == {"Military Space"}
    known = spark.createDataFrame([("https://h.example/space/b", "-")], "url string, content_hash string")
    assert [r["url"] for r in feeds.crawl(landed, ["https://h.example/space"], DOMAIN, known, 1).collect()] == ["https://h.example/space/a"]
    entries = spark.createDataFrame([(1, "q", 1, "A &amp; B", "https://n.example/1", "s", "Reuters"), (2, "q", 2, "Gone", "https://n.example/2", "s" * 300, None), (3, "q", 3, "Short", "https://n.example/3", None, "x")], "seq long, query string, position int, title string, url string, summary string, source_name string")
    news = {r["seq"]: r for r in feeds.admit_news(entries, landed, DOMAIN).collect()}
    assert set(news) == {1, 2} and news[1]["title"] == "A & B" and news[1]["trust_score"] == 0.88 and news[2]["trust_score"] == 0.72
    assert news[2]["clean_text"].startswith("Gone. sss") and news[2]["clean_text"].endswith("Search query: q")
    assert spark.range(1).select(pages.body_or_fallback(F.lit("b" * 300), F.lit("h"), F.lit(None).cast("string"), F.lit("q"))).first()[0] == "b" * 300


def test_bands(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(scores.band(F.lit(x))) for x in (0.75, 0.5, 0.49)] == ["High", "Medium", "Low"]
    assert [one(scores.needs_guardrail(F.lit(n), F.lit(c))) for n, c in ((1, 0.9), (2, 0.44), (2, 0.45))] == [True, True, False]
    assert one(corpus.iso(F.lit(datetime.datetime(2026, 1, 2, 3, 4, 5, 678)))) == "2026-01-02T03:04:05"
    r = audit.one_row(spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit("x").alias("b"))).first()
    assert (r["a"], r["b"]) == (1, "x")
    assert one(feeds.trust_by_name(F.lit("src7 and others"), SAMPLE)) == 0.72


def test_what_was_stored_can_be_cleaned_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}/app")
    monkeypatch.setattr(session, "_TABLES", set())
    kept = session.stored(spark.range(5).toDF("id"))
    spark.range(3).write.option("path", session.shared_table(spark, "for_now")).saveAsTable("for_now")
    assert kept.count() == 5 and spark.table("for_now").count() == 3 and len(list((tmp_path / "app").iterdir())) == 2
    session.clean(spark)
    assert list(tmp_path.iterdir()) == [] and not spark.catalog.tableExists("for_now")


def test_a_local_session_gets_a_folder(spark):
    class Local:
        class sparkContext:  # noqa: N801
            master, applicationId = "local[2]", "app-1"
            getConf = staticmethod(dict)

        conf = {}

    assert session.shared_folder(Local) == session.shared_folder(Local)
    assert session.shared_folder(Local).startswith("file:///") and session.shared_folder(Local).endswith("/app-1")


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://there:7077"
            getConf = staticmethod(dict)

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake)
