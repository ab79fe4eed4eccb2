"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and types of the stored tables.
SCHEMAS = {
    "sources": "id long, name string not null, source_type string, base_url string, trust_score double, created_at timestamp",
    "documents": "id long, source_id long, title string, url string, published_at string, collected_at timestamp, raw_text string, clean_text string, language string, source_type string, topic string, content_hash string, trust_score double",
    "document_chunks": "id long, document_id long, chunk_index int, chunk_text string not null, token_count int, faiss_id long",
    "signals": "id long, document_id long, signal_type string not null, topic string, title string, description string, entities array<string>, impact_score double, urgency_score double, confidence_score double, evidence_text string, created_at timestamp",
    "recommendations": "id long, title string not null, recommendation string not null, priority string, expected_impact string, risk_assessment string, confidence_score double, created_at timestamp",
    "recommendation_evidence": "id long, recommendation_id long, document_id long, chunk_id long, evidence_strength double",
    "ceo_queries": "id long, question string not null, intent string, topic string, business_area string, region string, answer_markdown string not null, confidence_score double, evidence_count int, created_at timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def create_tables(spark: SparkSession) -> None:
    """Create the tables that aren't there yet."""
    for name in SCHEMAS:
        if not spark.catalog.tableExists(name):
            empty(spark, name).write.saveAsTable(name)


def reset(spark: SparkSession, *names: str) -> None:
    for name in names:
        empty(spark, name).write.mode("overwrite").saveAsTable(name)
