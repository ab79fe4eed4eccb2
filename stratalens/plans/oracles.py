"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from collections.abc import Iterable

from ..rules import SAMPLE as PACK
from ..rules import router as R

# Written out here, so that a changed constant of the engine shows.
AS_OF = "2024-02-15 00:00:00"
TOKENS = ("/th", "/on", "/de", "/le", "/un")
RECENCY, OLDER, UNDATED = ((30, "1.0"), (90, "0.85"), (180, "0.70"), (365, "0.55")), "0.40", "0.55"
GRADES, LOWEST_GRADE = ((0.90, "Production-demo ready"), (0.75, "Strong prototype"), (0.60, "Needs improvement")), "Not ready"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(xs: Iterable[str]) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def any_of(low: str, keywords: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {s(k.lower())})" for k in keywords) + ")"


def count_of(low: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({low}, {s(t.lower())})::INT" for t in terms) + ")"


def case(pairs: Iterable[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def first(low: str, rules, default: str | None) -> str:
    return case(((any_of(low, r.keywords), s(r.label)) for r in rules), "NULL" if default is None else s(default))


STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
COLLAPSE = r"regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g')"


def clean(x: str) -> str:
    return STRIP.format(f"regexp_replace({COLLAPSE.format(x)}, '(?i)Cookie Policy|Privacy Policy|Terms of Use', '', 'g')")


def content_hash(x: str) -> str:
    return f"sha256(lower({clean(x)}))"


DAYS = f"greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({{0}})) / 86400000000))"


def recency(ts: str) -> str:
    pairs = [(f"{ts} IS NULL", UNDATED), *((f"{DAYS.format(ts)} <= {n}", v) for n, v in RECENCY)]
    return "(" + case(((c, f"{v}::DECIMAL(9,4)") for c, v in pairs), f"{OLDER}::DECIMAL(9,4)") + ")"


DOCS = f"""docs0 AS (
  SELECT d.doc_id AS id, '' AS title, {clean('d.text')} AS clean_text, d.source AS source_name, d.lang AS source_type,
    'https://x.example/' || (d.n_chars % 701) AS url,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 0.9::DECIMAL(9,4) ELSE 0::DECIMAL(9,4) END AS trust_score, e.ts AS published
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id),
docs AS (SELECT *, {first('lower(clean_text)', PACK.topics, PACK.default_topic)} AS topic FROM docs0)"""

RULES = "rules(rule, signal_type, title, topics, keywords, strength) AS (VALUES " + ", ".join(
    f"({i}, {s(r.kind)}, {s(r.title)}, {array(r.topics)}, {array(r.keywords)}, {r.strength}::DECIMAL(9,4))" for i, r in enumerate(PACK.signals)
) + ")"
CLAMP = "greatest(0::DECIMAL(9,4), least(1::DECIMAL(9,4), {0}))"
IMPACT = CLAMP.format(
    "(" + case(((f"topic = {s(k)}", f"{v}::DECIMAL(9,4)") for k, v in PACK.impact_base.items()), f"{PACK.impact_default}::DECIMAL(9,4)") + f" + 0.02 * {count_of('low', PACK.impact_terms)} + CASE WHEN signal_type IN ('opportunity', 'risk') THEN 0.03 ELSE 0.00 END)::DECIMAL(12,6)"
)
URGENCY = CLAMP.format(f"(0.45 + 0.04 * {count_of('low', PACK.urgency_terms)} + 0.20 * {recency('published')})::DECIMAL(12,6)")
BONUS = case(((f"source_type = {s(k)}", f"{v}::DECIMAL(9,4)") for k, v in PACK.source_bonus.items()), "0::DECIMAL(9,4)")
TRUST = "CASE WHEN trust_score IS NULL OR trust_score = 0 THEN 0.5::DECIMAL(9,4) ELSE trust_score END"
CONFIDENCE = CLAMP.format(f"(0.40 * {TRUST} + 0.25 * {recency('published')} + 0.25 * strength + {BONUS})::DECIMAL(12,6)")
WHOLE = "(title || '. ' || clean_text)"


def snippet(text: str, places: str) -> str:
    return f"substr({text}, greatest(coalesce({places}, 1) - 140, 1), 550)"


SIGNALS = f"""{DOCS}, {RULES},
low AS (SELECT *, {STRIP.format(COLLAPSE.format(WHOLE))} AS whole, lower({WHOLE}) AS low FROM docs WHERE length(clean_text) > 40),
signals AS (SELECT id AS document_id, rule, signal_type, topic, r.title, source_name,
    round({IMPACT}, 3)::DECIMAL(9,3) AS impact_score, round({URGENCY}, 3)::DECIMAL(9,3) AS urgency_score, round({CONFIDENCE}, 3)::DECIMAL(9,3) AS confidence_score,
    {snippet('whole', "list_min(list_filter(list_transform(keywords, lambda k: instr(lower(whole), k)), lambda p: p > 0))")} AS evidence_text
  FROM low JOIN rules r ON list_contains(topics, topic) OR len(list_filter(keywords, lambda k: contains(low, k))) > 0)"""

CHUNKS = f"""{DOCS}, starts AS (
  SELECT id, clean_text AS t, {clean('clean_text')} AS c FROM docs WHERE length(clean_text) > 50),
chunks AS (SELECT id AS document_id, i AS chunk_index, trim(substr(c, 1 + 1550 * i, 1800)) AS chunk_text
  FROM starts, unnest(range(0, 1 + greatest(0, ceil((length(c) - 1800) / 1550.0))::INT)) AS x(i) WHERE length(c) > 0)"""
KEPT = "SELECT * FROM chunks WHERE length(chunk_text) >= 40"

BLUEPRINTS = "blueprints(recommendation_id, recommendation, priority) AS (VALUES " + ", ".join(f"({i}, {s(b.title)}, {s(b.priority)})" for i, b in enumerate(PACK.blueprints)) + ")"
WANTS = "wants(recommendation_id, title) AS (VALUES " + ", ".join(f"({i}, {s(t)})" for i, b in enumerate(PACK.blueprints) for t in b.signals) + ")"
SUPPORT = f"""{SIGNALS}, {BLUEPRINTS}, {WANTS},
supporting AS (SELECT * FROM (SELECT s.*, w.recommendation_id, row_number() OVER (PARTITION BY w.recommendation_id
    ORDER BY confidence_score DESC, impact_score DESC, urgency_score DESC, document_id, rule) AS rank
  FROM signals s JOIN wants w ON w.title = s.title) WHERE rank <= 14)"""
PRIORITY = "CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
SCORE = """least(0.35 * avg(confidence_score::DOUBLE) + 0.25 * avg(impact_score::DOUBLE) + 0.25 * least(count(DISTINCT coalesce(nullif(source_name, ''), 'unknown')) / 5.0, 1.0)
    + 0.15 * least(count(DISTINCT coalesce(nullif(topic, ''), 'unknown')) / 4.0, 1.0), 1.0)"""
RECS = f"""{SUPPORT}, recs AS (SELECT b.recommendation_id, recommendation, priority, count(*) AS evidence_count, round(({SCORE})::DECIMAL(18,9), 3)::DOUBLE AS confidence_score
  FROM supporting s JOIN blueprints b ON b.recommendation_id = s.recommendation_id GROUP BY ALL HAVING count(*) >= 2),
evidence AS (SELECT recommendation_id, rank, document_id, round((0.45 * confidence_score + 0.35 * impact_score + 0.20 * urgency_score)::DECIMAL(12,6), 3)::DOUBLE AS evidence_strength
  FROM supporting WHERE rank <= 8 AND recommendation_id IN (SELECT recommendation_id FROM recs))"""

Q = "asked AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user')"
INTENT = first("low", R.INTENTS, R.DEFAULT_INTENT)

WORDS = r"len(regexp_extract_all({0}, '[^ \t\n\r\f\v]+'))"
SOURCES = f"""sources AS (SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS id, source AS name, arg_min(lang, doc_id) AS source_type,
  ({case(((f'contains(lower(source), {s(k)})', v) for k, v in PACK.name_trust), PACK.default_name_trust)})::DOUBLE AS trust_score FROM documents WHERE source NOT IN ('src5', 'src13') GROUP BY source)"""
NAMED = "CASE WHEN source_name NOT IN ('src5', 'src13') THEN source_name END"
LOG = f"""log0 AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS question, lower(a.text) AS low, r.text AS answer, least({WORDS.format('r.text')} // 20, 8)::INT AS evidence_count
  FROM conversations a LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1 AND r.role = 'assistant' WHERE a.role = 'user'),
log AS (SELECT id, question, answer, evidence_count, {INTENT} AS intent, {first('low', R.TOPICS, None)} AS topic, {first('low', R.AREAS, R.AREAS[0].label)} AS business_area, {first('low', R.REGIONS, None)} AS region,
  round((0.35 * (evidence_count / 10.0) + 0.15 * least(evidence_count / 5.0, 1.0))::DOUBLE, 3) AS confidence_score FROM log0)"""

BARE = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<header\b.*?</header\s*>|<aside\b.*?</aside\s*>', '', 'g')"
SEGMENT = r"trim(regexp_replace(regexp_replace(string_split_regex(x, '(?i)</p>')[1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
UNESCAPE = "{0}"
for _name, _mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    UNESCAPE = f"replace({UNESCAPE}, {s(_name)}, {s(_mark)})"

UNIT = PACK.units[0]


def in_unit(topic: str, blob: str) -> str:
    return f"(topic IN ({', '.join(s(t) for t in UNIT.topics)}) OR {any_of(blob, UNIT.keywords)})"


MEANS = "round(avg(confidence_score::DOUBLE), 6) AS avg_confidence, round(avg(impact_score::DOUBLE), 6) AS avg_impact, round(avg(urgency_score::DOUBLE), 6) AS avg_urgency"
LOWTEXT = "lower(title || ' ' || clean_text)"
TONE = f"({count_of(LOWTEXT, PACK.positive)} - {count_of(LOWTEXT, PACK.negative)})"
COUNTS = f"""{RECS}, {LOG}, links AS (SELECT b.recommendation_id, count(e.document_id) AS links FROM blueprints b LEFT JOIN evidence e USING (recommendation_id) GROUP BY 1),
facts AS (SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT source_name) FROM docs) AS sources,
  (SELECT count(*) FROM (SELECT length(c) AS n, unnest(range(0, 1 + greatest(0, ceil((length(c) - 1800) / 1550.0))::INT)) AS i, c FROM (SELECT {clean('clean_text')} AS c FROM docs WHERE length(clean_text) > 50) WHERE length(c) > 0)
    WHERE length(trim(substr(c, 1 + 1550 * i, 1800))) >= 40) AS chunks,
  (SELECT count(*) FROM signals) AS signals, (SELECT count(*) FROM blueprints) AS recommendations, (SELECT sum(links)::BIGINT FROM links) AS evidence,
  (SELECT count(*) FROM links WHERE links = 0) AS unsupported,
  (SELECT count(*) FROM log) AS answers, (SELECT count(*) FROM log WHERE coalesce(evidence_count, 0) = 0) AS weak_answers)"""
CHECKS = "checks AS (" + " UNION ALL ".join(
    f"SELECT {s(n)} AS name, {v}::DOUBLE {op} {t}::DOUBLE AS passed, {v}::DOUBLE AS value, {t}::DOUBLE AS threshold FROM facts"
    for n, v, t, op in (
        ("documents", "documents", "100", ">="), ("sources", "sources", "3", ">="), ("chunks", "chunks", "documents", ">="), ("signals", "signals", "50", ">="),
        ("recommendations", "recommendations", "3", ">="), ("evidence_per_recommendation", "(evidence::DOUBLE / recommendations)", "3", ">="),
        ("unsupported_recommendations", "unsupported", "0", "="), ("answers", "answers", "1", ">="), ("weak_answers", "weak_answers", "0", "="),
    )
) + ")"
HITS = lambda names: ", ".join(f"({i}, {s(n)}, (SELECT count(*) FROM docs WHERE contains({LOWTEXT}, {s(n.lower())})))" for i, n in enumerate(names))
SCORED = "SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings"
GAPPY = f"""gappy AS (SELECT CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN '' ELSE url END AS url, CASE WHEN id % 13 = 0 THEN NULL ELSE topic END AS topic,
  CASE WHEN id % 17 = 0 THEN NULL ELSE {content_hash('clean_text')} END AS content_hash, clean_text, trust_score FROM docs)"""
GRADE = case(((f"score >= {v}", s(n)) for v, n in GRADES), s(LOWEST_GRADE))
MATCH = " + ".join(f"contains(lower(recommendation), {s(w)})::INT" for w in "how do we expand licensing abroad".split() if len(w) >= 5)


def short(x: str, n: int) -> str:
    t = STRIP.format(COLLAPSE.format(x))
    return f"CASE WHEN length({t}) > {n} THEN regexp_replace(substr({t}, 1, {n}), ' [^ ]*$', '') || '...' ELSE {t} END"


_t = STRIP.format(COLLAPSE.format("text"))
ORACLES = {
    "clean_hash_documents": f"SELECT doc_id, {content_hash('text')} AS content_hash, length({clean('text')}) AS n FROM documents",
    "dedup_first_wins": f"SELECT min(doc_id) AS doc_id, {content_hash('text')} AS content_hash FROM documents GROUP BY 2",
    "topic_counts": f"""WITH firsts AS (SELECT min(doc_id) AS id, {content_hash('text')} AS h FROM documents GROUP BY 2), {DOCS}
        SELECT topic, count(*) AS documents FROM docs JOIN firsts USING (id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "source_topk": f"WITH {DOCS} SELECT source_name, count(*) AS documents FROM docs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "source_type_counts": "SELECT lang AS source_type, count(*) AS documents FROM documents GROUP BY 1",
    "chunk_documents": f"""WITH {CHUNKS} SELECT document_id, chunk_index::INT AS chunk_index, sha256(chunk_text) AS chunk_sha,
        len(string_split_regex(chunk_text, '\\s+'))::INT AS token_count FROM ({KEPT})""",
    "dense_chunk_ids": f"WITH {CHUNKS} SELECT document_id, chunk_index::INT AS chunk_index, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS faiss_id FROM ({KEPT})",
    "signal_extract": f"""WITH {SIGNALS} SELECT document_id, rule, signal_type, topic, title, impact_score::DOUBLE AS impact_score, urgency_score::DOUBLE AS urgency_score,
        confidence_score::DOUBLE AS confidence_score, sha256(evidence_text) AS evidence FROM signals""",
    "entity_lists": f"WITH {DOCS} SELECT id, array_to_string(list_filter({array(sorted(PACK.entities))}, lambda e: contains(lower(clean_text), lower(e))), ', ') AS entities FROM docs",
    "signal_type_counts": f"WITH {SIGNALS} SELECT signal_type, count(*) AS signals FROM signals GROUP BY 1",
    "signal_digest": f"WITH {SIGNALS} SELECT title, signal_type, count(*) AS signals, round(avg(confidence_score::DOUBLE)::DECIMAL(18,7), 3)::DOUBLE AS avg_confidence FROM signals GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 12",
    "highest_confidence_signals": f"""WITH {SIGNALS} SELECT document_id, rule, confidence_score::DOUBLE AS confidence_score, impact_score::DOUBLE AS impact_score, urgency_score::DOUBLE AS urgency_score
        FROM signals ORDER BY signals.confidence_score DESC, signals.impact_score DESC, signals.urgency_score DESC, document_id, rule LIMIT 10""",
    "recommendation_rollup": f"WITH {RECS} SELECT * FROM recs ORDER BY {PRIORITY}, confidence_score DESC, recommendation_id",
    "recommendation_evidence": f"WITH {RECS} SELECT * FROM evidence",
    "recommendation_evidence_topn": f"""WITH {RECS} SELECT recommendation_id, n AS rank, document_id, evidence_strength FROM (
        SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY evidence_strength DESC, rank) AS n FROM evidence) WHERE n <= 3""",
    "unsupported_recommendations": f"WITH {COUNTS} SELECT recommendation_id, links FROM links",
    "source_type_summary": f"WITH {DOCS} SELECT source_type, count(id) AS documents, round(avg(trust_score::DOUBLE), 6) AS avg_trust, count(DISTINCT source_name) AS sources FROM docs GROUP BY 1",
    "topic_coverage": f"""WITH {SIGNALS}, a AS (SELECT topic, count(id) AS documents, round(avg(trust_score::DOUBLE), 6) AS avg_trust, string_agg(DISTINCT source_type, ', ' ORDER BY source_type) AS source_types FROM docs GROUP BY 1),
        b AS (SELECT topic, count(*) AS signals, round(avg(confidence_score::DOUBLE), 6) AS avg_confidence, round(avg(impact_score::DOUBLE), 6) AS avg_impact FROM signals GROUP BY 1)
        SELECT a.*, coalesce(b.signals, 0) AS signals, coalesce(avg_confidence, 0) AS avg_confidence, coalesce(avg_impact, 0) AS avg_impact FROM a LEFT JOIN b USING (topic)""",
    "evidence_audit": f"""WITH {RECS} SELECT b.recommendation_id, count(e.document_id) AS links, coalesce(round(avg(evidence_strength), 6), 0) AS avg_strength
        FROM blueprints b LEFT JOIN evidence e USING (recommendation_id) GROUP BY 1""",
    "data_gaps": f"""WITH {DOCS}, {GAPPY} SELECT count(*) FILTER (url IS NULL) + count(*) FILTER (coalesce(url, '') = '') AS without_url,
        count(*) FILTER (topic IS NULL) + count(*) FILTER (coalesce(topic, '') = '') AS without_topic, count(*) FILTER (length(clean_text) < 250) AS short_text,
        count(*) FILTER (trust_score IS NULL) AS without_trust, count(*) - count(DISTINCT coalesce(content_hash, '')) AS duplicates FROM gappy""",
    "quality_scorecard": f"""WITH {COUNTS}, m AS (SELECT avg(coalesce(trust_score, 0.5::DECIMAL(9,4))) AS trust, count(DISTINCT coalesce(topic, 'Unknown')) AS topics FROM docs)
        SELECT documents, sources::INT AS sources, chunks::INT AS chunks, signals::INT AS signals, round(evidence::DOUBLE / recommendations, 2) AS evidence_per_recommendation, round(trust, 3) AS avg_trust, topics,
        round((0.18 * least(sources / 25.0, 1.0) + 0.18 * least(documents / 100.0, 1.0) + 0.14 * least(chunks::DOUBLE / greatest(documents, 1), 1.0) + 0.16 * least(signals::DOUBLE / greatest(documents, 1), 1.0)
          + 0.18 * least(evidence::DOUBLE / recommendations / 5, 1.0) + 0.08 * least(trust, 1.0) + 0.08 * least(topics / 8.0, 1.0))::DECIMAL(18,9), 3)::DOUBLE AS quality_score FROM facts, m""",
    "evaluation_checks": f"WITH {COUNTS}, {CHECKS} SELECT * FROM checks",
    "evaluation_summary": f"""WITH {COUNTS}, {CHECKS}, t AS (SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM checks),
        u AS (SELECT *, passed::DOUBLE / total AS score FROM t) SELECT total, passed, failed, round(score, 3) AS score, {GRADE} AS grade FROM u""",
    "readiness": f"""WITH {COUNTS}, g AS (SELECT (documents > 0)::INT + (sources > 0)::INT + (chunks > 0)::INT + (signals > 0)::INT + (recommendations > 0)::INT + (evidence > 0)::INT + (answers > 0)::INT + (unsupported = 0)::INT AS n FROM facts)
        SELECT CASE WHEN n = 8 THEN 'Demo ready' WHEN n >= 6 THEN 'Mostly ready' WHEN n >= 4 THEN 'Needs rebuild' ELSE 'Not ready' END AS label FROM g""",
    "vector_topk": f"SELECT vec_id, label, round(score, 5) AS score FROM (SELECT * FROM ({SCORED}) ORDER BY score DESC, vec_id LIMIT 8)",
    "vector_topk_filtered": f"""SELECT vec_id, label, round(score, 5) AS score FROM (SELECT * FROM (SELECT * FROM ({SCORED}) ORDER BY score DESC, vec_id LIMIT 40)
        WHERE label <> 0 ORDER BY score DESC, vec_id LIMIT 8) WHERE score >= -0.5""",
    "sentiment_by_topic": f"""WITH {DOCS} SELECT topic, CASE WHEN {TONE} > 0 THEN 'Positive' WHEN {TONE} < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment, count(*) AS documents FROM docs GROUP BY 1, 2""",
    "radar_mentions": f"""WITH {DOCS}, m(ord, entity, mentions) AS (VALUES {HITS(PACK.radar)})
        SELECT entity, mentions, CASE WHEN mentions >= 10 THEN 'High relevance' WHEN mentions >= 3 THEN 'Moderate relevance' ELSE 'Low current signal' END AS reading FROM m""",
    "partner_mentions": f"""WITH {DOCS}, m(ord, name, mentions) AS (VALUES {HITS([n for n, _ in PACK.partners])}), c(name, country) AS (VALUES {', '.join(f'({s(a)}, {s(b)})' for a, b in PACK.partners)})
        SELECT name, country, mentions, least(1.0, 0.55 + 0.07 * mentions)::DOUBLE AS relevance FROM m JOIN c USING (name) ORDER BY relevance DESC, mentions DESC, ord LIMIT 8""",
    "unit_filter": f"WITH {DOCS} SELECT id, topic FROM docs WHERE {in_unit('topic', "lower(clean_text || ' ' || source_name)")}",
    "unit_signal_summary": f"""WITH {SIGNALS} SELECT signal_type, count(*) AS signals, {MEANS} FROM signals WHERE {in_unit('topic', "lower(title || ' ' || evidence_text)")} GROUP BY 1""",
    "unit_source_summary": f"""WITH {DOCS} SELECT source_type, count(*) AS documents, round(avg(trust_score::DOUBLE), 6) AS avg_trust FROM docs WHERE {in_unit('topic', "lower(clean_text || ' ' || source_name)")} GROUP BY 1""",
    "risk_monitor": f"WITH {SIGNALS} SELECT title, topic, count(*) AS signals, {MEANS} FROM signals WHERE signal_type = 'risk' GROUP BY 1, 2",
    "alert_level": f"""WITH {SIGNALS}, c AS (SELECT count(*) FILTER (signal_type = 'opportunity' AND confidence_score >= 0.75) AS opportunities, count(*) FILTER (signal_type = 'risk' AND confidence_score >= 0.75) AS risks FROM signals)
        SELECT *, CASE WHEN risks >= 5 THEN 'Elevated' ELSE 'Moderate' END AS alert FROM c""",
    "related_recs": f"""WITH {RECS}, m AS (SELECT *, {MATCH} AS match FROM recs) SELECT recommendation_id, match, confidence_score FROM m
        WHERE match > 0 OR (SELECT max(match) FROM m) = 0 ORDER BY match DESC, confidence_score DESC, {PRIORITY}, recommendation_id LIMIT 6""",
    "unit_recommendations": f"""WITH {RECS}, m AS (SELECT *, {any_of('lower(recommendation)', [*UNIT.keywords, *UNIT.topics])} AS hit, row_number() OVER (ORDER BY {PRIORITY}, confidence_score DESC, recommendation_id) AS n FROM recs)
        SELECT recommendation_id, recommendation FROM m WHERE hit OR (NOT (SELECT bool_or(hit) FROM m) AND n <= 3)""",
    "route_questions": f"""WITH {Q}, r AS (SELECT *, {INTENT} AS intent FROM asked)
        SELECT conv_id, turn, intent, {first('low', R.TOPICS, None)} AS topic, {first('low', R.AREAS, R.AREAS[0].label)} AS business_area, {first('low', R.REGIONS, None)} AS region,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {any_of('low', c.keywords)} THEN {s(c.label)} END" for c in R.CONSTRAINTS)}], lambda x: x IS NOT NULL), ',') AS constraints,
        intent IN ({', '.join(s(x) for x in R.RISK_INTENTS)}) OR contains(low, 'risk') AS needs_risk, intent <> 'evidence_request' AS needs_recommendation FROM r""",
    "intent_counts": f"WITH {Q} SELECT {INTENT} AS intent, count(*) AS questions FROM asked GROUP BY 1",
    "priority_order": """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 3 END AS rank, count(*) AS orders,
        round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY 1 ORDER BY 1""",
    "top_per_group": """SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
        FROM lineitem) WHERE rank <= 3""",
    "keyword_browser": f"WITH {DOCS} SELECT id, topic FROM docs WHERE contains(lower(clean_text), 'license') ORDER BY id LIMIT 100",
    "recency_bands": f"SELECT {recency('ts')}::DOUBLE AS recency, count(*) AS events FROM events GROUP BY 1",
    "page_title_paragraphs": f"""WITH p AS (SELECT page_id, html, list_filter(list_transform(string_split_regex({BARE}, '(?i)<p\\b[^>]*>')[2:], lambda x: {SEGMENT}), lambda t: t <> '') AS ps FROM pages)
        SELECT page_id, {clean(UNESCAPE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, len(ps)::INT AS n_paragraphs, sha256(array_to_string(ps, ' ')) AS text_sha FROM p""",
    "page_links": f"""WITH b AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS base, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS hs FROM pages),
        h AS (SELECT page_id, url, base, unnest([url] || hs) AS href, unnest(range(0, len(hs) + 1)) AS pos FROM b),
        l AS (SELECT *, CASE WHEN pos = 0 THEN url WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN base || href ELSE href END AS link FROM h),
        w AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE pos = 0 OR (regexp_extract(link, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) = base AND {any_of('lower(link)', TOKENS)}) GROUP BY 1, 2)
        SELECT page_id, rank, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM w) WHERE rank <= 20""",
    "trust_by_name": f"SELECT DISTINCT source, ({case(((f'contains(lower(source), {s(k)})', v) for k, v in PACK.name_trust), PACK.default_name_trust)})::DOUBLE AS trust FROM documents",
    "snippet_short": f"""SELECT doc_id, sha256({short('text', 420)}) AS short_sha,
        sha256({snippet(_t, f"list_min(list_filter([instr(lower({_t}), 'license'), instr(lower({_t}), 'token'), instr(lower({_t}), 'tion')], lambda p: p > 0))")}) AS snippet_sha FROM documents""",
    "recent_feed": f"WITH {DOCS} SELECT id, source_name, topic FROM docs ORDER BY id DESC LIMIT 25",
    "filter_values": f"WITH {DOCS} SELECT DISTINCT topic FROM docs",
}
_numbered = f"numbered AS (SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS vec_id FROM ({KEPT}))"
_scored = lambda i: SCORED.replace("WHERE vec_id = 0", f"WHERE vec_id = {i}")
ORACLES |= {
    "documents_with_sources": f"""WITH {DOCS}, {SOURCES}, d AS (SELECT *, regexp_extract(source_name, '(\\d+)$', 1)::BIGINT AS source_id FROM docs)
        SELECT d.id, d.source_id, s.name AS source_name, topic, d.trust_score::DOUBLE AS trust_score FROM d LEFT JOIN sources s ON s.id = d.source_id""",
    "signals_with_sources": f"""WITH {SIGNALS} SELECT document_id, rule, title AS description, d.source_type, CASE WHEN d.source_name NOT IN ('src5', 'src13') THEN d.source_name END AS source_name, d.url,
        s.confidence_score::DOUBLE AS confidence_score FROM signals s LEFT JOIN docs d ON d.id = s.document_id""".replace("title AS description", "s.title AS description"),
    "supporting_signals": f"""WITH {SIGNALS}, x AS (SELECT * FROM signals WHERE title IN ({', '.join(s(t) for t in PACK.blueprints[1].signals)})
        ORDER BY confidence_score DESC, impact_score DESC, urgency_score DESC, document_id, rule LIMIT 14) SELECT document_id, rule, title, confidence_score::DOUBLE AS confidence_score, {NAMED} AS source_name FROM x""",
    "evidence_explorer": f"""WITH {RECS} SELECT e.recommendation_id, b.recommendation AS recommendation_title, e.rank, e.document_id, evidence_strength, topic, source_type, {NAMED} AS source_name
        FROM evidence e JOIN blueprints b ON b.recommendation_id = e.recommendation_id JOIN docs d ON d.id = e.document_id""",
    "evidence_documents": f"""WITH {RECS}, x AS (SELECT recommendation_id, document_id, evidence_strength, row_number() OVER (PARTITION BY recommendation_id ORDER BY evidence_strength DESC, rank) AS rank FROM evidence)
        SELECT recommendation_id, x.rank, document_id, evidence_strength, topic, {NAMED} AS source_name FROM x JOIN docs d ON d.id = x.document_id WHERE x.rank <= 5""",
    "largest_sources": "SELECT source AS name, count(*) AS documents FROM documents WHERE source NOT IN ('src5', 'src13') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "source_audit": f"WITH {SOURCES} SELECT * FROM sources ORDER BY trust_score DESC, name",
    "latest_update": "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS latest_update FROM events",
    "document_lookup": f"WITH {DOCS} SELECT id, substr(clean_text, 1, 200) AS preview, topic FROM docs WHERE id = 7",
    "retrieval_hits": f"""WITH {CHUNKS}, {_numbered}, v AS (SELECT * FROM ({SCORED}) ORDER BY score DESC, vec_id LIMIT 40)
        SELECT vec_id, document_id, chunk_index::INT AS chunk_index, topic, source_type, round(score, 5) AS score FROM v JOIN numbered USING (vec_id) JOIN docs d ON d.id = document_id
        WHERE topic = 'English' ORDER BY v.score DESC, vec_id LIMIT 8""",
    "retrieval_stored_index": f"""WITH {CHUNKS}, {_numbered}, v AS (SELECT * FROM ({SCORED}) ORDER BY score DESC, vec_id LIMIT 25)
        SELECT vec_id, document_id, chunk_index::INT AS chunk_index, round(score, 5) AS score FROM v JOIN numbered USING (vec_id) ORDER BY v.score DESC, vec_id LIMIT 5""",
    "retrieval_probes": f"WITH {CHUNKS}, {_numbered} " + " UNION ALL ".join(
        f"""SELECT {i}::INT AS probe, count(*) AS results, coalesce(round(avg(score), 3), 0) AS mean_score,
        array_to_string(list_filter({array(sorted(terms))}, lambda t: contains(coalesce(string_agg(lower(chunk_text), ' '), ''), t)), ', ') AS matched,
        len(list_filter({array(sorted(terms))}, lambda t: contains(coalesce(string_agg(lower(chunk_text), ' '), ''), t))) > 0 AS passed
        FROM (SELECT * FROM ({_scored(i)}) ORDER BY score DESC, vec_id LIMIT 5) JOIN numbered USING (vec_id)""" for i, (_, terms) in enumerate(PACK.probes)
    ),
    "qa_log": f"WITH {Q}, {LOG} SELECT id, intent, topic, business_area, region, confidence_score, evidence_count FROM log",
    "qa_recent": f"WITH {LOG} SELECT id, question, intent, confidence_score FROM log ORDER BY id DESC LIMIT 20",
    "qa_metrics": f"""WITH {LOG} SELECT count(*) AS sessions, coalesce(round(avg(confidence_score), 3), 0) AS avg_confidence, coalesce(sum(evidence_count), 0)::BIGINT AS evidence,
        count(*) FILTER (coalesce(evidence_count, 0) = 0) AS weak_answers FROM log""",
    "qa_intents": f"WITH {LOG} SELECT intent, count(*) AS questions FROM log GROUP BY 1 ORDER BY 2 DESC, 1",
    "question_partners": f"""WITH {DOCS}, m(ord, name, mentions) AS (VALUES {HITS([n for n, _ in PACK.partners])}), c(name, country) AS (VALUES {', '.join(f'({s(a)}, {s(b)})' for a, b in PACK.partners)}),
        q AS (SELECT conv_id, turn, lower(text || CASE WHEN conv_id % 2 = 0 THEN ' Which partner or country?' ELSE '' END) AS low, CASE WHEN conv_id % 2 = 0 THEN 'zzzz' ELSE '' END AS given FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, name, country, mentions, least(1.0, 0.55 + 0.07 * mentions)::DOUBLE AS relevance FROM q, m JOIN c USING (name)
        WHERE {any_of('low', R.PARTNER_TERMS)} AND (contains(low, lower(name)) OR contains(given, lower(name)) OR mentions > 0)""",
    "evidence_pack": f"""WITH {LOG} SELECT id, to_json({{'question': question, 'query_route': {{'intent': intent, 'topic': topic, 'business_area': business_area, 'region': region}}, 'answer_confidence_from_pipeline': confidence_score,
        'retrieved_evidence': [{{'rank': 1, 'snippet': {short("coalesce(answer, '')", 500)}}}], 'strategic_signals': [], 'existing_recommendations': [], 'partner_options': []}})::VARCHAR AS pack FROM log""",
}
# One row at a time, with the urls and hashes taken so far.
_free = "NOT (list_contains(s.urls, r.url) OR list_contains(s.hashes, r.content_hash))"
ORACLES["dedup_url_or_hash"] = f"""WITH RECURSIVE {DOCS}, r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, id AS seq, url, {content_hash('clean_text')} AS content_hash FROM docs),
    s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS urls, []::VARCHAR[] AS hashes, false AS ok
      UNION ALL SELECT r.i, CASE WHEN {_free} THEN list_append(s.urls, r.url) ELSE s.urls END, CASE WHEN {_free} THEN list_append(s.hashes, r.content_hash) ELSE s.hashes END, {_free} FROM s JOIN r ON r.i = s.i + 1)
    SELECT seq, url, content_hash FROM r JOIN s USING (i) WHERE ok"""
