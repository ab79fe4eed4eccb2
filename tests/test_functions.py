import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions import labels, scores, text
from stratalens.rules import DOMAIN, SAMPLE
from stratalens.rules import router as R
from stratalens.operators import router


def one(spark, column, **values):
    """The value of a column expression over one row of text values."""
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_clean_and_hash(spark):
    x = F.col("t")
    assert one(spark, text.clean(x), t="a\n\n b  Cookie Policy c") == "a b  c"
    assert one(spark, text.clean(text.clean(x)), t="a\n\n b  Cookie Policy c") == "a b c"
    assert one(spark, text.clean(x), t="Cookie Privacy Policy Policy") == "Cookie  Policy"
    assert one(spark, text.clean(text.clean(x)), t="Cookie Privacy Policy Policy") == ""
    for empty in (None, "", " \n\t "):
        assert one(spark, text.clean(x), t=empty) == ""
    assert one(spark, text.content_hash(x), t="Ä  B") == hashlib.sha256("ä b".encode()).hexdigest()


@pytest.mark.parametrize(("length", "count"), [(0, 0), (1, 1), (1800, 1), (1801, 2), (3350, 2), (3351, 3)])
def test_chunk_counts(spark, length, count):
    made = one(spark, text.chunks(F.col("t")), t="x" * length)
    assert len(made) == count
    if length == 3351:
        assert [len(c) for c in made] == [1800, 1800, 251]


def test_chunks_equal_a_loop(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(8000))) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        t, want, start = " ".join(r["t"].split()), [], 0
        while t and start < len(t):
            end = min(start + 1800, len(t))
            want.append(t[start:end].strip())
            if end == len(t):
                break
            start = end - 250
        assert r["c"] == want


def test_topics(spark):
    topic = labels.first_match(F.lower("t"), DOMAIN.topics, DOMAIN.default_topic)
    want = {"Aerospace outlook": "Military Space", "border control": "Policy and Procurement", "Crewed-uncrewed teaming": "Uncrewed Combat Aircraft", "Manned teaming": "Crewed-Uncrewed Teaming", "hello": "General Airbus Strategy"}
    for t, label in want.items():
        assert one(spark, topic, t=t) == label


def test_scores(spark):
    as_of = F.lit("2026-06-23 00:59:00").cast("timestamp")
    recent = scores.recency(scores.feed_date(F.col("d")), as_of)
    assert float(one(spark, recent, d="Fri, 13 Mar 2026 07:00:00 GMT")) == 0.70
    assert float(one(spark, recent, d="Tue, 26 May 2026 07:00:00 GMT")) == 1.0
    assert float(one(spark, recent, d="Tue, 26 May 2027 07:00:00 GMT")) == 1.0
    assert float(one(spark, recent, d=None)) == 0.55 and float(one(spark, recent, d="2026-03-13")) == 0.55

    def conf(trust, recency, strength, kind):
        return float(one(spark, scores.confidence(scores.dec(trust), scores.dec(recency), scores.dec(strength), F.lit(kind), DOMAIN)))

    assert conf("0.95", "1.0", "0.88", "news") == 0.88
    assert conf("0.90", "1.0", "0.88", "news") == 0.86
    assert conf("0.95", "1.0", "0.78", "news") == 0.855
    assert conf("0.95", "0.55", "0.86", "official") == 0.833
    assert conf("0.95", "0.85", "0.86", "official") == 0.908
    assert float(one(spark, scores.impact(F.lit("FCAS"), F.lit("risk"), F.lit("contract nato"), DOMAIN))) == 0.99
    assert float(one(spark, scores.impact(F.lit("?"), F.lit("opportunity"), F.lit(""), DOMAIN))) == 0.65
    assert float(one(spark, scores.urgency(F.lit(""), scores.dec("0.55"), DOMAIN))) == 0.56
    assert float(one(spark, scores.urgency(F.lit("contract signed 2026"), scores.dec("1.0"), DOMAIN))) == 0.77
    assert float(one(spark, scores.evidence_strength(scores.dec("0.8"), scores.dec("0.9"), scores.dec("0.7")))) == 0.815
    assert [float(one(spark, scores.partner_relevance(F.lit(n)))) for n in (0, 3, 7)] == [0.55, 0.76, 1.0]
    assert one(spark, scores.clamp(F.lit(None).cast("double"))) is None
    assert float(one(spark, scores.trust_or_default(F.lit(0.0)))) == 0.5


def test_text_helpers(spark):
    assert one(spark, text.short(F.col("t"), 10), t="alpha  beta gamma") == "alpha..."
    assert one(spark, text.short(F.col("t"), 100), t="alpha  beta") == "alpha beta"
    assert one(spark, text.snippet(F.col("t"), ("zeta",)), t="a" * 300 + " zeta " + "b" * 900) == ("a" * 300 + " zeta " + "b" * 900)[161:711]
    assert one(spark, text.token_count(F.col("t")), t=" a b\nc ") == 3 and one(spark, text.token_count(F.col("t")), t="  ") == 0
    assert one(spark, text.strip_thinking(F.col("t")), t="<THINK>x\ny</think> z <think>q</think>") == "z"
    assert one(spark, text.flatten_markdown(F.col("t")), t="**a** <b>\nc") == "a &lt;b&gt;<br>c"
    assert one(spark, text.unescape(F.col("t")), t="a &amp;lt; b &#39;c&#39;") == "a &lt; b 'c'"
    assert one(spark, labels.sentiment(F.col("t"), SAMPLE.positive, SAMPLE.negative), t=None) == "Neutral"
    assert one(spark, F.array_join(labels.entities(F.col("t"), DOMAIN.entities), ", "), t="nato met AIRBUS and the c295 crew") == "Airbus, C295, NATO"


QUESTIONS = [
    ("Which partner in Europe should Airbus collaborate with for the long term future of FCAS?", "partnership_strategy", "FCAS", "Europe", ["long_term", "partnership_required"]),
    ("What is the risk of FCAS?", "risk_analysis", "FCAS", None, []),
    ("What if Airbus delivers more drones?", "scenario_analysis", "Uncrewed Combat Aircraft", "United States", []),
    ("Explain recommendation on satellite services", "recommendation_drilldown", "Military Space", None, []),
]


def test_router(spark):
    rows = spark.createDataFrame([(q[0],) for q in QUESTIONS], "question string")
    got = {r["question"]: r for r in router.route_questions(rows).collect()}
    for q, intent, topic, region, constraints in QUESTIONS:
        r = got[q]
        assert (r["intent"], r["topic"], r["region"], r["constraints"]) == (intent, topic, region, constraints)
        assert r["business_area"] == R.AREAS[0].label and r["needs_evidence"]
    assert one(spark, router.asks_for_partners(F.col("t")), t="which country?") and not one(spark, router.asks_for_partners(F.col("t")), t="what now?")
    assert "'A'" in router.drill_down("A", "no such action") and router.drill_down("A", "risks", " if late ").endswith("Condition: if late.")
    assert router.generate("p", "plain") == ("plain", None)
    assert router.generate("p", "plain", lambda p: 1 / 0)[0] == "plain"


def test_dates_are_local(spark):
    assert one(spark, scores.feed_date(F.col("d")), d="1 Jan 2024 10:00:00 +0900") == datetime.datetime(2024, 1, 1, 10)
