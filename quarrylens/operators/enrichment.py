"""Rule-based enrichment of articles, a stage after the other: taxonomy, entities, claims and
events, assessment, embedding, provenance.  Each stage reads what those before it added; no stage
calls a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENUMS

DIMENSIONS = 8
PARSER = "rules-2"


def with_taxonomy(docs: DataFrame) -> DataFrame:
    """domain, sub_domain and up to five keywords, the longest words, of (id, text, lang, source)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 5)
    return docs.withColumn("taxonomy", F.struct(F.col("lang").alias("domain"), F.col("source").alias("sub_domain"), F.transform(longest, lambda x: x["w"]).alias("keywords")))


def with_entities(docs: DataFrame) -> DataFrame:
    """Capitalised words of four letters or more; those that are keywords too are surer."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), 0)))
    types = F.array(*[F.lit(v) for v in ENUMS["EntityType"]])

    def entity(x: Column) -> Column:
        sure = F.when(F.array_contains("taxonomy.keywords", F.lower(x)), 0.9).otherwise(0.5)
        return F.struct(F.get(types, F.length(x) % len(ENUMS["EntityType"])).alias("type"), x.alias("name"), F.lower(x).alias("normalized_name"), sure.alias("confidence"))

    return docs.withColumn("entities", F.transform(names, entity))


def with_claims_and_events(docs: DataFrame) -> DataFrame:
    """A claim for every line with a percentage or a quotation, with the line as its evidence; an
    event for every line with a year."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("body")))
    quoted, share, year = r'["\u201c\u00ab]', r"[0-9] ?%", r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)"
    claims = F.transform(
        F.filter(lines, lambda x: x["body"].rlike(quoted) | x["body"].rlike(share)),
        lambda x: F.struct(F.when(x["body"].rlike(quoted), "QUOTE").otherwise("FACTUAL_ASSERTION").alias("type"), F.get("entities", F.lit(0))["normalized_name"].alias("source_entity"), F.array(F.struct(F.lit("ARTICLE_TEXT").alias("type"), x["line"].alias("locator"))).alias("evidence")),
    )
    events = F.transform(F.filter(lines, lambda x: x["body"].rlike(year)), lambda x: F.struct(x["line"].alias("line"), F.regexp_extract(x["body"], r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).alias("year")))
    return docs.withColumns({"claims": claims, "events": events})


def with_assessment(docs: DataFrame) -> DataFrame:
    """relevance by statements, confidence by entities, and whether an article with a smaller id has the text."""
    first = docs.groupBy(F.md5("text").alias("__text")).agg(F.min("id").alias("__first"))
    n = F.size("claims") + F.size("events")
    mean = F.aggregate("entities", F.lit(0.0), lambda s, e: s + e["confidence"], lambda s: s / F.greatest(F.size("entities"), F.lit(1)))
    both = docs.withColumn("__text", F.md5("text")).join(first, "__text", "left")
    assessment = F.struct(F.round(F.least(F.lit(1.0), n / 5), 4).alias("relevance"), F.round(mean, 4).alias("confidence"), F.coalesce(F.col("id") != F.col("__first"), F.lit(False)).alias("duplicate"))
    return both.withColumn("assessment", assessment).drop("__text", "__first")


def with_embedding(docs: DataFrame) -> DataFrame:
    """Shares of words by length, a vector of DIMENSIONS; a stand-in for a model's vector."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    docs = docs.withColumn("__lengths", F.transform(words, F.length))
    share = lambda k: F.round(F.size(F.filter("__lengths", lambda n: n % DIMENSIONS == k)) / F.greatest(F.size("__lengths"), F.lit(1)), 6)
    return docs.withColumn("embedding", F.struct(F.lit("lengths").alias("model"), F.lit(DIMENSIONS).alias("dimensions"), F.array(*[share(k) for k in range(DIMENSIONS)]).alias("vector"))).drop("__lengths")


def with_provenance(docs: DataFrame, at: Column) -> DataFrame:
    return docs.withColumn("provenance", F.struct(F.lit(PARSER).alias("parser_version"), at.alias("extraction_time")))


def enriched(docs: DataFrame, at: Column) -> DataFrame:
    """(id, text, lang, source) with all stages, in their order."""
    return with_provenance(with_embedding(with_assessment(with_claims_and_events(with_entities(with_taxonomy(docs))))), at)
