"""Schemas of the three collections, and the domains of their enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, DOUBLE, BOOLEAN, INT = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
STRINGS = T.ArrayType(STRING)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


AUTHENTICATION = _struct(("type", STRING), ("username", STRING), ("password", STRING), ("api_key", STRING), ("bearer_token", STRING))

SOURCE = _struct(
    ("id", STRING), ("name", STRING), ("type", STRING), ("endpoint", STRING), ("description", STRING), ("status", STRING),
    ("priority", INT), ("polling_interval", T.DayTimeIntervalType()), ("last_successful_run", T.TimestampType()),
    ("last_execution", T.TimestampType()), ("last_content_timestamp", T.TimestampType()), ("authentication", AUTHENTICATION),
    ("configuration", STRING), ("tags", STRINGS),
)

RAW_DOCUMENT = _struct(
    ("id", STRING), ("source_id", STRING), ("original_uri", STRING), ("acquisition_time", T.TimestampType()),
    ("content_timestamp", T.TimestampType()), ("mime_type", STRING), ("raw_content", T.BinaryType()), ("content_hash", STRING), ("metadata", STRING),
)

METADATA = _struct(("title", STRING), ("subtitle", STRING), ("author", STRING), ("publication_date", T.DateType()), ("category", STRING), ("tags", STRINGS), ("images", STRINGS), ("attachments", STRINGS))
TAXONOMY = _struct(("domain", STRING), ("sub_domain", STRING), ("event_type", STRING), ("sector", STRING), ("impact_level", STRING), ("topics", STRINGS), ("keywords", STRINGS))
ENTITY = _struct(("id", STRING), ("type", STRING), ("name", STRING), ("normalized_name", STRING), ("wikidata_id", STRING), ("confidence", DOUBLE))
RELATIONSHIP = _struct(("source", STRING), ("target", STRING), ("predicate", STRING), ("confidence", DOUBLE))
EVENT = _struct(("id", STRING), ("type", STRING), ("date", T.DateType()), ("description", STRING), ("participants", STRINGS), ("locations", STRINGS))
INTELLIGENCE = _struct(
    ("geopolitical_area", STRING), ("strategic_actors", STRINGS), ("operational_actors", STRINGS), ("alliances", STRINGS),
    ("adversaries", STRINGS), ("objectives", STRINGS), ("capabilities", STRINGS), ("implications", STRINGS),
)
ASSESSMENT = _struct(("reliability", DOUBLE), ("confidence", DOUBLE), ("relevance", DOUBLE), ("duplicate", BOOLEAN), ("propaganda", BOOLEAN))
EMBEDDING = _struct(("embedding_id", STRING), ("model", STRING), ("dimensions", INT), ("vector", T.ArrayType(T.FloatType())))
PROVENANCE = _struct(("extraction_model", STRING), ("extraction_prompt", STRING), ("extraction_time", T.TimestampType()), ("parser_version", STRING))
LINKS = _struct(("related_articles", STRINGS), ("previous_events", STRINGS), ("follow_up_events", STRINGS))
EVIDENCE = _struct(("id", STRING), ("type", STRING), ("source", STRING), ("url", STRING), ("excerpt", STRING), ("locator", STRING), ("confidence", DOUBLE))
CLAIM = _struct(
    ("id", STRING), ("source_entity_id", STRING), ("statement", STRING), ("target_entity_ids", STRINGS), ("date", T.DateType()),
    ("type", STRING), ("confidence", STRING), ("evidence", T.ArrayType(EVIDENCE)),
)

ARTICLE = _struct(
    ("id", STRING), ("raw_document_id", STRING), ("metadata", METADATA), ("taxonomy", TAXONOMY), ("entities", T.ArrayType(ENTITY)),
    ("relationships", T.ArrayType(RELATIONSHIP)), ("events", T.ArrayType(EVENT)), ("intelligence_assessment", INTELLIGENCE),
    ("assessment", ASSESSMENT), ("embedding", EMBEDDING), ("provenance", PROVENANCE), ("links", LINKS), ("claims", T.ArrayType(CLAIM)),
)

# The domains of the enumerations, in their order.
ENUMS: dict[str, tuple[str, ...]] = {
    "SourceType": tuple("WEBSITE RSS SITEMAP TELEGRAM X FACEBOOK YOUTUBE PDF EMAIL API FILESYSTEM DATABASE MANUAL DISCORD MASTODON BLUESKY REDDIT DARK_WEB TOR RSS_CUSTOM".split()),
    "SourceStatus": tuple("ENABLED DISABLED ERROR".split()),
    "AuthenticationType": tuple("NONE BASIC API_KEY BEARER_TOKEN OAUTH2 SESSION_COOKIE CUSTOM".split()),
    "EntityType": tuple("PERSON ORGANIZATION COUNTRY CITY REGION LOCATION EVENT WEAPON MILITARY_UNIT COMPANY LAW AGREEMENT DOCUMENT".split()),
    "ClaimType": tuple("FACTUAL_ASSERTION ACCUSATION DENIAL THREAT INTENT ATTRIBUTION ASSESSMENT QUOTE".split()),
    "Confidence": tuple("VERY_LOW LOW MEDIUM HIGH VERY_HIGH".split()),
    "EvidenceType": tuple("ARTICLE_TEXT QUOTE LINKED_SOURCE ATTACHMENT IMAGE EXTERNAL_REFERENCE".split()),
    "ConnectionState": tuple("ONLINE OFFLINE INVALID".split()),
}
