"""Column helpers that turn wire forms into typed columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENUMS

ISO_DURATION = r"^(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def parse_duration(text: Column) -> Column:
    """ISO-8601 day-time duration (``PT30M``) to an interval; null if it isn't one."""
    part = lambda k: F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(text, ISO_DURATION, k), F.lit("")).cast("double"), F.lit(0.0))
    given = F.regexp_extract(text, r"^-?P(.*)$", 1)
    seconds = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    signed = F.when(text.startswith("-"), -seconds).otherwise(seconds)
    return F.when(text.rlike(ISO_DURATION) & (given != "") & ~text.endswith("T"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), signed.cast("decimal(18,6)")))


def duration_seconds(interval: Column) -> Column:
    return F.extract(F.lit("DAY"), interval) * 86400 + F.extract(F.lit("HOUR"), interval) * 3600 + F.extract(F.lit("MINUTE"), interval) * 60 + F.extract(F.lit("SECOND"), interval).cast("double")


def format_duration(interval: Column) -> Column:
    """An interval as an ISO-8601 duration in hours, minutes and seconds; zero is ``PT0S``."""
    total = duration_seconds(interval).cast("long")
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    piece = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    return F.when(total == 0, "PT0S").otherwise(F.concat(F.lit("PT"), piece(hours, "H"), piece(minutes, "M"), piece(seconds, "S")))


def parse_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def format_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def decode_bytes(text: Column) -> Column:
    return F.unbase64(text)


def encode_bytes(body: Column) -> Column:
    return F.base64(body)


def enum_value(value: Column, domain: str, strict: bool = False) -> Column:
    """The value if it is in the domain; otherwise null, or an error if strict."""
    known = value.isin(*ENUMS[domain])
    if strict:
        return F.when(value.isNull() | known, value).otherwise(F.raise_error(F.concat(F.lit(f"not a {domain}: "), value)))
    return F.when(known, value)


def enum_ordinal(value: Column, domain: str) -> Column:
    """Place of the value in its domain, from 0; null if unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in ENUMS[domain]]), value), F.lit(0)) - 1


def content_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def empty_lists(df: DataFrame) -> DataFrame:
    """Null arrays, at the top and inside structs, become empty ones."""

    def filled(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            inner = F.transform(column, lambda x: filled(x, kind.elementType)) if isinstance(kind.elementType, T.StructType) else column
            return F.coalesce(inner, F.array().cast(kind))
        if isinstance(kind, T.StructType):
            return F.struct(*[filled(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return column

    return df.select(*[filled(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def with_source_defaults(sources: DataFrame) -> DataFrame:
    """Status ENABLED and priority 0 where none is given; null lists become empty."""
    return empty_lists(sources).withColumns({"status": F.coalesce("status", F.lit("ENABLED")), "priority": F.coalesce("priority", F.lit(0))})


def with_document_defaults(documents: DataFrame) -> DataFrame:
    """A generated id and the present as acquisition time where none is given."""
    return documents.withColumns({"id": F.coalesce("id", F.expr("uuid()")), "acquisition_time": F.coalesce("acquisition_time", F.current_timestamp())})


def with_id(df: DataFrame, *parts: str) -> DataFrame:
    """Ids where there are none: derived from ``parts`` if given (the same on each run), else random."""
    own = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256) if parts else F.expr("uuid()")
    return df.withColumn("id", F.coalesce("id", own))


def from_json_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON text to rows of a schema; fields that the schema doesn't have are ignored."""
    return lines.select(F.from_json(column, schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]X"}).alias("x")).select("x.*")


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def probe_text(state: Column, name: Column, host: Column, port: Column) -> Column:
    return F.format_string("%s: %s %s:%d", state, name, host, port)


def endpoint_state(host: Column, port: Column) -> Column:
    """INVALID for endpoints that can't be tried; null for those that could."""
    return F.when(host.isNull() | (F.trim(host) == "") | ~port.between(1, 65535) | port.isNull(), "INVALID")
