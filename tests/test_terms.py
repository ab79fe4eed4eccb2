"""Terms found in one walk against a scan for each."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions import labels, scores, text
from stratalens.functions.terms import Terms, Walked
from stratalens.operators import signals
from stratalens.rules import DOMAIN, SAMPLE


@pytest.mark.parametrize("pack", [DOMAIN, SAMPLE])
def test_every_term_of_a_pack(spark, pack):
    """A corpus in which every keyword stands alone, and some stand in one another."""
    rnd = random.Random(1)
    terms = pack.terms.terms
    texts = [*terms, *(f"x{t}y" for t in terms), *(t[:-1] for t in terms), *(" ".join(rnd.sample(terms, 9)).upper() for _ in range(200)), "", None, "ß😀 " + terms[0]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").withColumn("low", F.lower("t"))
    frame = frame.withColumn("bits", pack.terms.walk(F.col("low")))
    held = Walked(F.col("bits"), pack.terms)
    for row in frame.select("low", F.array(*[held.has(t) for t in terms]).alias("h")).collect():
        want = [None] * len(terms) if row["low"] is None else [t in row["low"] for t in terms]
        assert row["h"] == want
    both = frame.select(
        *[labels.first_match(x, pack.topics, "none").alias(f"topic{i}") for i, x in enumerate((F.col("low"), held))],
        *[labels.entities(x, pack.entities).alias(f"names{i}") for i, x in enumerate((F.col("low"), held))],
        *[text.count_terms(x, pack.impact_terms).alias(f"n{i}") for i, x in enumerate((F.col("low"), held))],
        *[labels.sentiment(x, pack.positive, pack.negative).alias(f"tone{i}") for i, x in enumerate((F.coalesce("low", F.lit("")), Walked(F.coalesce(F.col("bits"), F.array_repeat(F.lit(0).cast("long"), 9)), pack.terms)))],
    ).collect()
    for r in both:
        assert (r["topic0"], r["n0"], r["tone0"]) == (r["topic1"], r["n1"], r["tone1"])
        assert r["names0"] == r["names1"]


def test_few_and_no_terms(spark):
    frame = spark.createDataFrame([("ab",), (None,)], "t string")
    some = Terms(["", "A", "b", "B"])
    assert some.terms == ["a", "b"]
    got = frame.select(some.walk(F.col("t")).alias("x"), Terms([]).walk(F.col("t")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == [([3], []), (None, None)]


def test_domain_signals_by_hand(spark):
    """Each rule of the domain pack fires on its own keywords, with the scores of the formulas."""
    rows = [(10 * i + j, "", f"padding so that the text is long enough: {k} and no more of it", "None such") for i, r in enumerate(DOMAIN.signals) for j, k in enumerate(r.keywords)]
    docs = spark.createDataFrame(rows, "id long, title string, clean_text string, topic string")
    docs = docs.withColumns({"trust_score": F.lit("0.9").cast("decimal(9,4)"), "source_type": F.lit("news"), "published": F.lit(None).cast("timestamp")})
    found = {}
    for r in signals.detect(docs, DOMAIN, "2026-06-23 00:59:00").collect():
        found.setdefault(r["document_id"], {})[r["rule"]] = r
    for i, rule in enumerate(DOMAIN.signals):
        for j, keyword in enumerate(rule.keywords):
            low = ". " + rows[sum(len(x.keywords) for x in DOMAIN.signals[:i]) + j][2].lower()
            want = {n for n, x in enumerate(DOMAIN.signals) if any(k in low for k in x.keywords)}
            got = found[10 * i + j]
            assert set(got) == want and i in want
            r = got[i]
            extra = 0.03 if rule.kind in ("opportunity", "risk") else 0.0
            impact = min(1.0, float(DOMAIN.impact_default) + 0.02 * sum(t in low for t in DOMAIN.impact_terms) + extra)
            urgency = min(1.0, 0.45 + 0.04 * sum(t in low for t in DOMAIN.urgency_terms) + 0.20 * 0.55)
            assert float(r["impact_score"]) == pytest.approx(impact, abs=0.0006) and float(r["urgency_score"]) == pytest.approx(urgency, abs=0.0006)
            assert r["entities"] == sorted(e for e in DOMAIN.entities if e.lower() in low) and keyword in r["evidence_text"].lower()
    assert scores.UNDATED == "0.55"
