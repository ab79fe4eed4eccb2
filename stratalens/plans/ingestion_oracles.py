"""DuckDB SQL of the queries in ``ingestion``; constants are written out here, not read from the engine."""

from __future__ import annotations

from .oracles import BARE, DOCS, RECS, SEGMENT, SIGNALS, LOG, UNESCAPE, clean, content_hash

TOPIC = """CASE WHEN contains({0}, 'license') THEN 'Licensing' WHEN contains({0}, '@') OR contains({0}, 'token') THEN 'Contact'
  WHEN contains({0}, ' und ') OR contains({0}, ' der ') THEN 'German' WHEN contains({0}, ' que ') OR contains({0}, ' les ') OR contains({0}, ' del ') THEN 'Romance'
  WHEN contains({0}, 'the') OR contains({0}, 'tion') THEN 'English' ELSE 'General' END"""
HEAD = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
ENTRIES = f"""entries AS (SELECT p.page_id AS seq, 'query ' || (p.page_id % 7) AS query, p.page_id % 45 AS position, CASE WHEN p.page_id % 17 = 0 THEN 'ab' ELSE {HEAD} END AS title,
    'https://news.example/' || (p.page_id % 211) AS url, CASE WHEN p.page_id % 5 = 0 THEN NULL ELSE substr(d.text, 1, 150) END AS summary,
    CASE p.page_id % 3 WHEN 0 THEN 'Reuters ' || source WHEN 1 THEN source END AS source_name, e.ts
  FROM pages p JOIN documents d ON d.doc_id = p.page_id JOIN events e ON e.event_id = p.page_id)"""
FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position, seq) AS n FROM {0}) WHERE n <= 20)"
NEWS_TRUST = "CASE WHEN contains(lower(coalesce(source_name, '')), 'reuters') OR contains(lower(coalesce(source_name, '')), 'nato') THEN 0.88 ELSE 0.72 END::DOUBLE"
PAGE_TEXT = f"array_to_string(list_filter(list_transform(string_split_regex({BARE}, '(?i)<p\\b[^>]*>')[2:], lambda x: {SEGMENT}), lambda t: t <> ''), ' ')"
_FREE = "NOT (list_contains(s.urls, r.url) OR list_contains(s.hashes, r.content_hash))"


def admitted(rows: str) -> str:
    """One row at a time, with the urls and hashes taken so far; gives ``taken``."""
    return f"""r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, * FROM {rows}),
    s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS urls, []::VARCHAR[] AS hashes, false AS ok
      UNION ALL SELECT r.i, CASE WHEN {_FREE} THEN list_append(s.urls, r.url) ELSE s.urls END, CASE WHEN {_FREE} THEN list_append(s.hashes, r.content_hash) ELSE s.hashes END, {_FREE} FROM s JOIN r ON r.i = s.i + 1),
    taken AS (SELECT r.* FROM r JOIN s USING (i) WHERE ok)"""


TITLE = clean(UNESCAPE.format("title"))
SUMMARY = "coalesce(summary, '')"
BODY = f"'Title: ' || title || '. Source: ' || coalesce(source_name, '') || '. Query: ' || query || '. Published: ' || strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT. Summary: ' || {SUMMARY}"
LINK_HOST = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"
HREF = "(?i)href=\"([^\"]*)\""
RANKED = "confidence_score DESC, impact_score DESC, urgency_score DESC, document_id, rule"
IN_UNIT = "(topic IN ('German', 'Romance') OR contains({0}, 'ung ') OR contains({0}, 'que '))"
PRIORITY = "CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
REGISTRY = """registry(name, source_type, base_url, trust_score) AS (VALUES ('Airbus Newsroom', 'official', 'https://www.airbus.com/en/newsroom', 0.95), ('Airbus Defence', 'official', 'https://www.airbus.com/en/products-services/defence', 0.95),
  ('Reuters Aerospace and Defence', 'news', 'https://www.reuters.com/business/aerospace-defense/', 0.90), ('Defense News', 'news', 'https://www.defensenews.com', 0.82), ('Breaking Defense', 'news', 'https://breakingdefense.com', 0.82),
  ('NATO', 'policy', 'https://www.nato.int', 0.90), ('European Defence Agency', 'policy', 'https://eda.europa.eu', 0.88), ('Dassault Aviation', 'competitor', 'https://www.dassault-aviation.com', 0.85),
  ('BAE Systems', 'competitor', 'https://www.baesystems.com', 0.85), ('Boeing Defense', 'competitor', 'https://www.boeing.com/defense', 0.85))"""
THOUGHT = "'<Think>first' || chr(10) || '\"a\" & <b></think>  ' || text || chr(10) || '**so**'"
STRIPPED = "regexp_replace(regexp_replace({0}, '(?is)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
FLAT = "replace(replace(replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>'), '**', '')"

SEARCHES = " UNION ALL ".join(
    f"(SELECT {i}::INT AS search, id, topic FROM docs WHERE contains(lower(clean_text), '{k}') {t} ORDER BY id LIMIT 40)"
    for i, (k, t) in enumerate((("license", ""), ("tionen", "AND topic = 'German'"), ("xqz", ""), ("@", "AND topic = 'Contact'"), ("therre", "")))
)

# The corpus with its gaps, in place of the whole one.
GAPPY = f"""gappy AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN '' ELSE url END AS url, CASE WHEN id % 13 = 0 THEN NULL ELSE topic END AS topic),
  CASE WHEN id % 17 = 0 THEN NULL ELSE {content_hash('clean_text')} END AS content_hash FROM docs)"""
GAPPY_RECS = RECS.replace("FROM docs WHERE length(clean_text) > 40", "FROM (SELECT * REPLACE (coalesce(topic, 'General') AS topic) FROM gappy) WHERE length(clean_text) > 40").replace("\nlow AS", f"\n{GAPPY},\nlow AS")
WINDOWS = f"SELECT length(trim(substr(c, 1 + 1550 * i, 1800))) AS n FROM (SELECT c, unnest(range(0, 1 + greatest(0, ceil((length(c) - 1800) / 1550.0))::INT)) AS i FROM (SELECT {clean('clean_text')} AS c FROM docs WHERE length(clean_text) > 50) WHERE length(c) > 0)"

ORACLES = {
    "kept_summaries": f"""WITH {GAPPY_RECS},
        f AS (SELECT (SELECT count(*) FROM gappy) AS documents, (SELECT count(DISTINCT source_name) FROM gappy) AS sources, (SELECT count(*) FROM ({WINDOWS}) WHERE n >= 40) AS chunks, (SELECT count(*) FROM signals) AS signals,
          (SELECT count(*) FROM evidence) / 3.0 AS per_rec, (SELECT avg(coalesce(trust_score, 0.5::DECIMAL(9,4))) FROM gappy) AS trust, (SELECT count(DISTINCT coalesce(topic, 'Unknown')) FROM gappy) AS topics),
        t AS (SELECT topic, string_agg(DISTINCT source_type, ', ' ORDER BY source_type) AS types, count(*) AS documents FROM gappy WHERE topic IS NOT NULL GROUP BY 1),
        u AS (SELECT topic, count(*) AS n, round((sum(confidence_score)::DOUBLE / count(*))::DECIMAL(18,9), 6)::DOUBLE AS mean FROM signals GROUP BY 1),
        g AS (SELECT count(*) FILTER (url IS NULL) + count(*) FILTER (coalesce(url, '') = '') AS without_url, count(*) FILTER (topic IS NULL) + count(*) FILTER (coalesce(topic, '') = '') AS without_topic,
          count(*) FILTER (length(clean_text) < 250) AS short_text, count(*) FILTER (trust_score IS NULL) AS without_trust, count(*) - count(DISTINCT coalesce(content_hash, '')) AS duplicates FROM gappy)
        SELECT 'type' AS section, source_type AS label, count(*) AS documents, round((sum(trust_score)::DOUBLE / count(trust_score))::DECIMAL(18,9), 6)::DOUBLE AS mean, count(DISTINCT source_name) AS others FROM gappy GROUP BY ALL
        UNION ALL SELECT 'topic', t.topic || ': ' || types, documents, coalesce(mean, 0), coalesce(n, 0) FROM t LEFT JOIN u USING (topic)
        UNION ALL SELECT 'gaps', k, v, NULL, NULL FROM (SELECT unnest(['without_url', 'without_topic', 'short_text', 'without_trust', 'duplicates']) AS k, unnest([without_url, without_topic, short_text, without_trust, duplicates]) AS v FROM g)
        UNION ALL SELECT 'score', 'quality', documents, round((0.18 * least(sources / 25.0, 1.0) + 0.18 * least(documents / 100.0, 1.0) + 0.14 * least(chunks::DOUBLE / documents, 1.0) + 0.16 * least(signals::DOUBLE / documents, 1.0)
          + 0.18 * least(per_rec / 5, 1.0) + 0.08 * least(trust, 1.0) + 0.08 * least(topics / 8.0, 1.0))::DECIMAL(18,9), 3)::DOUBLE, chunks FROM f""",
    "page_archives": "SELECT page_id, url, sha256(html) AS html_sha FROM pages",
    "vector_topk_many": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank::INT AS rank, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 8""",
    "indexed_browser": f"WITH {DOCS} {SEARCHES}",
    "feed_items": f"""WITH RECURSIVE {ENTRIES}, a AS (SELECT * REPLACE ({TITLE} AS title) FROM {FIRST.format('entries')}),
        b AS (SELECT *, {content_hash(f"concat_ws(' ', title, url, {SUMMARY})")} AS content_hash FROM a WHERE length(title) >= 5), {admitted('b')}
        SELECT seq, title, 'news' AS source_type, {TOPIC.format(f"lower(concat_ws(' ', title, {SUMMARY}, query))")} AS topic,
          (CASE WHEN contains(lower(source_name), 'src1') THEN 0.90 WHEN contains(lower(source_name), 'src7') THEN 0.72 WHEN contains(lower(source_name), 'src') THEN 0.70 ELSE 0.65 END)::DOUBLE AS trust_score,
          strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, content_hash, sha256({BODY}) AS body FROM taken ORDER BY seq LIMIT 100""",
    "feed_news": f"""WITH RECURSIVE {ENTRIES}, moved AS (SELECT e.* REPLACE (CASE WHEN seq % 9 = 0 THEN 'https://gone.example/' || seq ELSE p.url END AS url) FROM entries e JOIN pages p ON p.page_id = seq - seq % 2),
        texts AS (SELECT url, {PAGE_TEXT} AS page FROM pages),
        a AS (SELECT m.* REPLACE (trim({UNESCAPE.format('title')}) AS title), coalesce(page, '') AS page FROM {FIRST.format('moved')} m LEFT JOIN texts USING (url)),
        b AS (SELECT *, {clean(f"CASE WHEN length(page) < 300 THEN title || '. ' || {SUMMARY} || '. Search query: ' || query ELSE page END")} AS body FROM a),
        c AS (SELECT *, {content_hash('body')} AS content_hash FROM b WHERE length(body) >= 250), {admitted('c')}
        SELECT seq, title, url, {TOPIC.format("lower(concat_ws(' ', title, body))")} AS topic, {NEWS_TRUST} AS trust_score, content_hash FROM taken ORDER BY seq LIMIT 90""",
    "official_crawl": f"""WITH RECURSIVE named AS (SELECT page_id, 'https://site.example' || regexp_extract(html, '{HREF}', 1) AS url, html FROM pages),
        landed AS (SELECT n.* FROM named n JOIN (SELECT min(page_id) AS page_id FROM named GROUP BY url) USING (page_id)),
        seeds AS (SELECT url, row_number() OVER (ORDER BY min(page_id)) - 1 AS seed FROM named WHERE page_id < 60 GROUP BY url),
        b AS (SELECT seed, url, regexp_extract_all(html, '{HREF}', 1) AS hs FROM landed JOIN seeds USING (url)),
        h AS (SELECT seed, url, unnest([url] || hs) AS href, unnest(range(0, len(hs) + 1)) AS pos FROM b),
        l AS (SELECT seed, pos, CASE WHEN pos = 0 THEN url WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://site.example' || href ELSE href END AS link FROM h),
        w AS (SELECT seed, link, min(pos) AS pos FROM l WHERE pos = 0 OR (regexp_extract(link, '{LINK_HOST}', 1) = 'https://site.example' AND regexp_matches(lower(link), '/th|/on|/de|/le|/un')) GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS rank FROM w),
        f AS (SELECT link AS url, min(seed * 1000 + rank)::BIGINT AS seq FROM k WHERE rank <= 20 GROUP BY 1),
        t AS (SELECT seq, url, CASE WHEN length({clean(UNESCAPE.format(HEAD))}) > 0 THEN {clean(UNESCAPE.format(HEAD))} ELSE 'Official page' END AS title, {clean(PAGE_TEXT)} AS body FROM landed JOIN f USING (url)),
        c AS (SELECT *, {content_hash('body')} AS content_hash FROM t WHERE length(body) >= 250), {admitted('c')}
        SELECT seq, title, url, {TOPIC.format("lower(concat_ws(' ', title, body))")} AS topic, content_hash FROM taken ORDER BY seq LIMIT 40""",
    "admitted_documents": f"""WITH RECURSIVE a AS (SELECT doc_id AS seq, 'https://x.example/' || (n_chars % 1701) AS url, {clean('text')} AS body FROM documents),
        b AS (SELECT *, {content_hash('body')} AS content_hash FROM a WHERE seq % 50 <> 0 AND length(body) >= 250 AND url NOT IN (SELECT url FROM a WHERE seq % 50 = 0)), {admitted('b')}
        SELECT seq, url, {TOPIC.format("lower('T ' || body)")} AS topic, content_hash FROM taken""",
    "stored_recommendations": f"""WITH {RECS}, ids AS (SELECT *, row_number() OVER (ORDER BY recommendation) AS id FROM recs)
        SELECT i.id::BIGINT AS recommendation_id, recommendation AS title, priority, i.confidence_score, document_id, evidence_strength FROM evidence e JOIN ids i USING (recommendation_id)""",
    "stored_sources": f"""WITH {REGISTRY}, own AS (SELECT DISTINCT source AS name, 'news' AS source_type, 0.72 AS trust_score FROM documents)
        SELECT row_number() OVER (ORDER BY name)::BIGINT AS id, name, source_type, base_url, trust_score::DOUBLE AS trust_score FROM registry
        UNION ALL SELECT 10 + row_number() OVER (ORDER BY name), name, source_type, NULL, trust_score FROM own""",
    "route_signals": f"""WITH {SIGNALS}, k AS (SELECT document_id, rule, signal_type, topic, confidence_score, impact_score, urgency_score FROM signals)
        SELECT route, document_id, rule, signal_type, topic, confidence_score::DOUBLE AS confidence_score FROM (
          (SELECT 0 AS route, * FROM k WHERE topic = 'English' AND signal_type = 'risk' ORDER BY {RANKED} LIMIT 10) UNION ALL
          (SELECT 1, * FROM k WHERE signal_type = 'opportunity' ORDER BY {RANKED} LIMIT 10) UNION ALL
          (SELECT 2, * FROM k WHERE topic = 'German' AND signal_type IN ('risk', 'opportunity', 'trend') ORDER BY {RANKED} LIMIT 10) UNION ALL
          (SELECT 3, * FROM k WHERE topic = 'Romance' ORDER BY {RANKED} LIMIT 10))""",
    "augmented_questions": f"""WITH {LOG} SELECT id // 1000 AS conv_id, (id % 1000)::INT AS turn,
        sha256(question || CASE WHEN (id // 1000) % 2 = 0 THEN ' Airbus ' || coalesce(topic, 'Topic') ELSE '' END || coalesce(' ' || business_area, '')) AS query_sha FROM log""",
    "answer_bands": f"""WITH {LOG} SELECT id, CASE WHEN confidence_score * 2 >= 0.75 THEN 'High' WHEN confidence_score * 2 >= 0.5 THEN 'Medium' ELSE 'Low' END AS band,
        evidence_count < 2 OR confidence_score < 0.45 AS guarded FROM log""",
    "reply_markup": f"""SELECT conv_id, turn, sha256({STRIPPED.format(THOUGHT)}) AS said, sha256({FLAT.format(THOUGHT)}) AS flat FROM conversations WHERE role = 'assistant'""",
    "answer_confidence": f"""WITH {RECS}, {LOG}, q AS (SELECT id, evidence_count, {TOPIC.format('lower(question)')} AS topic FROM log),
        best AS (SELECT * FROM (SELECT topic, confidence_score, source_name, row_number() OVER (PARTITION BY topic ORDER BY {RANKED}) AS n FROM signals) WHERE n <= 10),
        m AS (SELECT topic, round(avg(confidence_score::DOUBLE), 9) AS signal, count(DISTINCT CASE WHEN source_name IN ('src5', 'src13') THEN '-' ELSE source_name END) AS sources FROM best GROUP BY 1),
        v AS (SELECT round(avg(confidence_score), 9) AS rec FROM recs)
        SELECT id, q.topic, round(greatest(0, least(1, 0.35 * coalesce(round(evidence_count / 10, 9), 0) + 0.30 * coalesce(signal, 0) + 0.20 * coalesce(rec, 0) + 0.15 * least(coalesce(sources, 0) / 5, 1.0)))::DOUBLE, 3) AS confidence
        FROM q LEFT JOIN m USING (topic), v""",
    "unit_profile": f"""WITH {RECS}, d AS (SELECT * FROM docs WHERE {IN_UNIT.format("lower(concat_ws(' ', title, clean_text, source_name))")}), g AS (SELECT * FROM signals WHERE {IN_UNIT.format("lower(title || ' ' || evidence_text)")}),
        h AS (SELECT *, regexp_matches(lower(recommendation), 'ung |que |german|romance') AS hit, row_number() OVER (ORDER BY {PRIORITY}, confidence_score DESC, recommendation_id) AS n FROM recs),
        kinds(kind) AS (VALUES ('opportunity'), ('risk'), ('trend'))
        SELECT 'documents' AS section, topic AS label, count(*) AS amount, NULL::DOUBLE AS mean FROM d GROUP BY ALL
        UNION ALL SELECT 'kind', kind, count(signal_type), NULL FROM kinds LEFT JOIN g ON signal_type = kind GROUP BY ALL
        UNION ALL SELECT 'signals', signal_type, count(*), round(avg(confidence_score::DOUBLE), 6) FROM g GROUP BY ALL
        UNION ALL SELECT 'sources', source_type, count(*), round(avg(trust_score::DOUBLE), 6) FROM d GROUP BY ALL
        UNION ALL SELECT 'recommendations', recommendation, evidence_count, confidence_score FROM h WHERE hit OR (NOT (SELECT bool_or(hit) FROM h) AND n <= 3)""",
}
