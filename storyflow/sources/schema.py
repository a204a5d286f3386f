"""Declared schemas of the domain tables, their keys and rules, and the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the schemas below; a stored table carries it as a property.
SCHEMA_VERSION = 1

#: Table -> columns.
_DDL = {
    "articles": "article_id bigint, guid string, canonical_url string, source_host string, lang string, title string, summary string, content string, author string, published_at string, first_seen_at string, batch_no int, content_hash string",
    "story_clusters": "cluster_id bigint, title string, category_slug string, representative_article_id bigint, embedding_model string, article_count int, first_published_at timestamp_ntz, latest_published_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, centroid_embedding_vector array<float>",
    "cluster_articles": "cluster_id bigint, article_id bigint, similarity double, role string, added_at timestamp_ntz",
    "article_embeddings": "article_id bigint, embedding_model string, embedding_dimensions int, embedding_vector array<float>, created_at timestamp_ntz",
    "cross_category_cluster_adjudications": "adjudication_id bigint, pair_type string, left_category_slug string, right_category_slug string, left_cluster_id bigint, right_cluster_id bigint, target_cluster_id bigint, source_cluster_id bigint, centroid_similarity double, max_article_similarity double, decision string, confidence double, merged boolean, created_at timestamp_ntz",
    "removed_failed_feeds": "feed_id string, name string, url string, validation_status string, frequency_status string, country string, timezone_gmt string",
}


def schema(table: str) -> T.StructType:
    """The declared schema of a table (parsed by the active session)."""
    return T.StructType.fromDDL(_DDL[table])


def conforms(df: DataFrame, table: str) -> list[str]:
    """Declared columns that ``df`` lacks or has in another type; extra columns are allowed."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema(table) if have.get(f.name) != f.dataType]


#: Table -> rule name -> condition that a good row meets (null counts as broken).
RULES = {
    "cluster_articles": {"role": "role in ('representative', 'member')", "similarity": "similarity between -1 and 1", "keys": "cluster_id is not null and article_id is not null"},
    "cross_category_cluster_adjudications": {"decision": "decision in ('same_story', 'related_but_distinct', 'distinct', 'insufficient_evidence')", "confidence": "confidence between 0 and 1"},
    "article_embeddings": {"dimensions": "embedding_vector is not null and size(embedding_vector) = embedding_dimensions"},
    "story_clusters": {"dates": "first_published_at is null or latest_published_at is null or first_published_at <= latest_published_at", "count": "article_count >= 0"},
}


def rejects(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a rule of their table, with ``broken_rules``."""
    rules = [F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)) for name, cond in sorted(RULES.get(table, {}).items())]
    broken = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)
