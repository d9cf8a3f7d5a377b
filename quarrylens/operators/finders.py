"""Lookups over the collections: filters, orders with a last key that settles ties, limits.

All take and return lazy DataFrames.  Nulls sort first ascending and last descending, which is
Spark's default.  A limit of zero or less means the default limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100


def normal_limit(limit: int) -> int:
    return limit if limit > 0 else DEFAULT_LIMIT


def required(value, name: str):
    if value is None:
        raise ValueError(f"{name} must not be null")
    return value


def all_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*columns) if columns else df


def first_where(df: DataFrame, **equal) -> DataFrame:
    """Zero or one row: equality on every named column, the smallest id if several match."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(required(value, name)))
    return df.orderBy("id").limit(1)


def by_id(df: DataFrame, id: str) -> DataFrame:
    return df.filter(F.col("id") == F.lit(required(id, "id"))).limit(1)


def article_order() -> list[Column]:
    return [F.desc("metadata.publication_date"), F.desc("provenance.extraction_time"), F.asc("id")]


def document_order() -> list[Column]:
    return [F.desc("content_timestamp"), F.desc("acquisition_time"), F.asc("id")]


def source_order() -> list[Column]:
    return [F.asc("priority"), F.asc("name"), F.asc("id")]


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(normal_limit(limit))


def any_element(array: str, field: str, value) -> Column:
    """Whether any element's field equals the value; false, not null, on null arrays."""
    return F.coalesce(F.exists(array, lambda x: x[field] == F.lit(value)), F.lit(False))


def articles_by_domain(articles: DataFrame, domain: str, limit: int = 0) -> DataFrame:
    return top(articles.filter(F.col("taxonomy.domain") == required(domain, "domain")), article_order(), limit)


def articles_by_event_type(articles: DataFrame, event_type: str, limit: int = 0) -> DataFrame:
    return top(articles.filter(any_element("events", "type", required(event_type, "event_type"))), article_order(), limit)


def articles_by_entity(articles: DataFrame, normalized_name: str, limit: int = 0) -> DataFrame:
    return top(articles.filter(any_element("entities", "normalized_name", required(normalized_name, "normalized_name"))), article_order(), limit)


def recent_articles(articles: DataFrame, limit: int = 0) -> DataFrame:
    return top(articles, article_order(), limit)


def documents_by_source(documents: DataFrame, source_id: str, limit: int = 0) -> DataFrame:
    return top(documents.filter(F.col("source_id") == required(source_id, "source_id")), document_order(), limit)


def recent_documents(documents: DataFrame, limit: int = 0) -> DataFrame:
    return top(documents, document_order(), limit)


def sources_by_status(sources: DataFrame, status: str, limit: int = 0) -> DataFrame:
    return top(sources.filter(F.col("status") == required(status, "status")), source_order(), limit)


def sources_by_type(sources: DataFrame, type: str, limit: int = 0) -> DataFrame:
    return top(sources.filter(F.col("type") == required(type, "type")), source_order(), limit)


def enabled_sources(sources: DataFrame, limit: int = 0) -> DataFrame:
    return sources_by_status(sources, "ENABLED", limit)


def sources_by_tag(sources: DataFrame, tag: str) -> DataFrame:
    return sources.filter(F.array_contains("tags", required(tag, "tag")))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(normal_limit(limit))


def asked_for(asked: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``asked`` (with a column ``key``) beside what it finds in ``df``; ``message`` says where it asks
    for null, which finds nothing."""
    return asked.withColumn("message", F.when(F.col(key).isNull(), f"{key} must not be null")).join(df, key, "left")
