"""Records as JSON and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import METADATA, RECORD


def wrap_record(metadata: str = "metadata") -> Column:
    """The stored form of a record: a JSON object whose metadata is a JSON text."""
    kept = F.to_json(metadata, {"ignoreNullFields": "false"})
    return F.to_json(F.struct("content", "id", "context", "description", "type", kept.alias("metadata")), {"ignoreNullFields": "false"})


def unwrap_record(value: Column) -> Column:
    """Struct of a stored record, its metadata parsed too; null for text that is no JSON object."""
    outer = F.from_json(value, RECORD)
    return F.when(is_object(value), outer.withField("metadata", F.from_json(outer["metadata"], METADATA)))


def is_object(value: Column) -> Column:
    """Whether the text is one complete JSON object; false for null."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def parse_or_text(value: Column) -> tuple[Column, Column]:
    """(content, type) of a stored record: the whole text as a text where it is no JSON object, and empty texts for missing fields."""
    known, record = is_object(value), F.from_json(value, T.StructType([f for f in RECORD if f.name in ("content", "type")]))
    content = F.when(known, F.coalesce(record["content"], F.lit(""))).otherwise(value)
    return content, F.when(known, F.coalesce(record["type"], F.lit(""))).otherwise(F.lit("text"))


def flatten_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, scalars as they are."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))
