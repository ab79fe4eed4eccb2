"""Routing of questions, and answers from what they retrieve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, scores
from ..functions.text import contains_any
from ..rules import router as R
from ..rules.pack import Pack


def route(low: Column) -> dict[str, Column]:
    """The fields of a route, as columns, from a question in lower case."""
    intent = labels.first_match(low, R.INTENTS, R.DEFAULT_INTENT)
    return {
        "intent": intent,
        "topic": labels.first_match(low, R.TOPICS, None),
        "business_area": labels.first_match(low, R.AREAS, R.AREAS[0].label),
        "region": labels.first_match(low, R.REGIONS, None),
        "constraints": labels.all_matches(low, R.CONSTRAINTS),
        "needs_risk": intent.isin(list(R.RISK_INTENTS)) | F.contains(low, F.lit("risk")),
        "needs_evidence": F.lit(True),
        "needs_recommendation": intent != "evidence_request",
    }


def route_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    lowered = questions.withColumn("_low", F.lower(F.coalesce(column, F.lit(""))))
    return lowered.withColumns(route(F.col("_low"))).drop("_low")


def augmented(question: Column, topic: Column, area: Column) -> Column:
    """The retrieval string: question, topic and area."""
    return F.concat(question, F.coalesce(F.concat(F.lit(" Airbus "), topic), F.lit("")), F.coalesce(F.concat(F.lit(" "), area), F.lit("")))


def signals_for(signals: DataFrame, intent: str, topic: str | None, limit: int = 10) -> DataFrame:
    """Signals of a route's topic and, for some intents, of one kind."""
    kind = {"risk_analysis": "risk", "opportunity_analysis": "opportunity"}.get(intent)
    if topic:
        signals = signals.filter(F.col("topic") == topic)
    if kind:
        signals = signals.filter(F.col("signal_type") == kind)
    elif intent in ("partnership_strategy", "scenario_analysis"):
        signals = signals.filter(F.col("signal_type").isin("risk", "opportunity", "trend"))
    return signals.orderBy(F.desc("confidence_score"), F.desc("impact_score"), F.desc("urgency_score"), "document_id", "rule").limit(limit)


def answer_confidence(evidence: Column, signal: Column, rec: Column, sources: Column) -> Column:
    """From mean scores (null where a list is empty) and distinct sources, a missing name being one; 0 if all are empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = 0.35 * zero(evidence) + 0.30 * zero(signal) + 0.20 * zero(rec) + 0.15 * F.least(sources / 5, F.lit(1.0))
    empty = evidence.isNull() & signal.isNull() & rec.isNull()
    return F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3))


def asks_for_partners(low: Column) -> Column:
    """Whether a question in lower case asks about partners at all."""
    return contains_any(low, R.PARTNER_TERMS)


def partners_for(questions: DataFrame, mentions: DataFrame, pack: Pack) -> DataFrame:
    """One row for each question (with ``question`` and ``evidence_text``) that asks about partners and partner kept.

    A partner is kept if the question or its evidence names it, or if any document
    does; ``mentions`` has (name, mentions) for the pack's few partners.
    """
    low = F.lower(F.coalesce("question", F.lit("")))
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(c).alias("country")) for i, (n, c) in enumerate(pack.partners)])
    rows = questions.filter(asks_for_partners(low)).withColumn("_p", F.explode(names)).select(*questions.columns, "_p.*")
    rows = rows.join(F.broadcast(mentions.select("name", "mentions")), "name")  # a row per partner of the pack
    named = F.contains(low, F.lower("name")) | F.contains(F.lower(F.coalesce("evidence_text", F.lit(""))), F.lower("name"))
    return rows.filter(named | (F.col("mentions") > 0)).withColumn("relevance", scores.partner_relevance(F.col("mentions")).cast("double"))


def qa_log(answered: DataFrame) -> DataFrame:
    """Log rows of answered questions (question, answer_markdown, confidence_score, evidence_count) with their routes."""
    routed = route_questions(answered)
    kept = ["question", "intent", "topic", "business_area", "region", "answer_markdown", "confidence_score", "evidence_count"]
    return routed.select(*[c for c in answered.columns if c not in kept], *kept)


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


def qa_metrics(log: DataFrame) -> DataFrame:
    """Sessions, mean confidence, evidence and answers without any, of a question log."""
    return log.agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.round(F.avg("confidence_score"), 3), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence"),
        F.count_if(F.coalesce("evidence_count", F.lit(0)) == 0).alias("weak_answers"),
    )


def intents(log: DataFrame) -> DataFrame:
    """Questions of each intent, the most frequent first."""
    return log.groupBy("intent").agg(F.count("*").alias("questions")).orderBy(F.desc("questions"), "intent")


def evidence_pack(answers: DataFrame) -> Column:
    """What is known for an answer, as JSON: the question, its route, and at most eight pieces of evidence and signals, five recommendations and eight partners.

    ``answers`` has question, intent, topic, business_area, region, confidence_score and
    the arrays evidence, signals, recommendations and partners; missing arrays are empty.
    """
    some = lambda c, n: F.coalesce(F.slice(F.col(c), 1, n), F.array()) if c in answers.columns else F.array()
    return F.to_json(
        F.struct(
            F.col("question"),
            F.struct("intent", "topic", "business_area", "region").alias("query_route"),
            F.col("confidence_score").alias("answer_confidence_from_pipeline"),
            some("evidence", 8).alias("retrieved_evidence"),
            some("signals", 8).alias("strategic_signals"),
            some("recommendations", 5).alias("existing_recommendations"),
            some("partners", 8).alias("partner_options"),
        ),
        {"ignoreNullFields": "false"},
    )


DRILL_DOWNS = {
    "explain": "Explain recommendation '{title}' and why it was made.",
    "evidence": "Show me the evidence for recommendation '{title}'.",
    "risks": "What could go wrong with '{title}', and what is the risk?",
    "partners": "Which partner could support '{title}'?",
    "alternatives": "What are alternatives to '{title}'?",
    "scenario": "What if conditions change for '{title}'?",
    "actions": "What are the next steps for '{title}'?",
}


def drill_down(title: str, action: str, condition: str | None = None) -> str:
    """A follow-up question about a recommendation; an unknown action explains it."""
    text = DRILL_DOWNS.get(action, DRILL_DOWNS["explain"]).format(title=title)
    return f"{text} Condition: {condition.strip()}." if condition and condition.strip() else text


def compose(question: str, routed: dict, evidence: list[dict], signals: list[dict], recs: list[dict], partners: list[dict], confidence: float) -> str:
    """A Markdown answer from a few collected rows."""
    lines = [f"# {question}", "", f"- Intent: {routed['intent']}", f"- Topic: {routed.get('topic') or 'any'}", f"- Confidence: {confidence:.3f}", ""]
    if recs:
        lines += ["## Recommendations", *(f"- **{r['recommendation']}** ({r['priority']}, {r['confidence_score']:.3f})" for r in recs), ""]
    if partners:
        lines += ["## Partners", "| Partner | Country | Mentions |", "|-|-|-|", *(f"| {p['name']} | {p['country']} | {p['mentions']} |" for p in partners), ""]
    if signals:
        lines += ["## Signals", *(f"- {s['title']} ({s['signal_type']}, {s['confidence_score']:.3f})" for s in signals[:6]), ""]
    lines += ["## Evidence", *(f"{i}. document {e['document_id']} (score {e['score']:.3f})" for i, e in enumerate(evidence[:8], 1))]
    if len(evidence) < 2 or confidence < 0.45:
        lines += ["", "> Evidence is thin: treat this answer as a lead, not a conclusion."]
    return "\n".join(lines)


def generate(prompt: str, fallback: str, model=None) -> tuple[str, str | None]:
    """(answer, warning): a model's answer, or the fallback where there is none or it fails."""
    if model is None:
        return fallback, None
    try:
        return model(prompt), None
    except Exception as e:  # any model may fail in its own way; the answer must not
        return fallback, f"model unavailable: {e}"


