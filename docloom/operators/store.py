"""Idempotent stores of records and of summary vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import element_id
from ..functions.models import hashing_embedding
from ..sources.readers import open_store


def with_ids(elements: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    return elements.withColumn("id", element_id(F.col(content), F.col(filename)))


def new_rows(elements: DataFrame, store: DataFrame, order: str | None = None) -> DataFrame:
    """Elements whose id is not stored yet, one for each id: the last in order, else any.

    The anti-join stands below whatever model columns a caller adds later, so stored elements are
    never summarised again.
    """
    fresh = elements.join(store.select("id"), "id", "left_anti")
    if order is None:
        return fresh.dropDuplicates(["id"])
    cols = fresh.columns
    best = fresh.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(F.col(order))).alias("r"))
    return best.select("r.*")


def union_types(**by_type: DataFrame) -> DataFrame:
    """Bag union of elements of several types, each with its type."""
    parts = [df.withColumn("type", F.lit(t)) for t, df in by_type.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def vector_rows(records: DataFrame, embed: Column | None = None) -> DataFrame:
    """Rows of the vector store: the summary is what is searched."""
    vector = embed if embed is not None else hashing_embedding(F.col("description"))
    return records.select(F.col("id").alias("doc_id"), "type", F.col("description").alias("page_content"), "metadata", vector.alias("embedding"))


def insert(spark: SparkSession, elements: DataFrame, doc_path: str, vector_path: str, order: str | None = None, embed: Column | None = None) -> dict[str, int]:
    """Append what is new to both stores, and say how many rows each got.

    Records go first and vectors are derived from both keys, so a crash between the two is repaired by the
    next run.  Rows are counted while they are written.  embed makes a vector of `description`.
    """
    records = new_rows(elements, open_store(spark, doc_path), order).select("content", "id", "context", "description", "type", "metadata")
    added = {"records": _append(records, doc_path), "vectors": 0}
    stored = spark.read.parquet(doc_path)
    if vector_path:
        from ..sources.readers import open_vectors

        have = open_vectors(spark, vector_path).select(F.col("doc_id").alias("id"))
        added["vectors"] = _append(vector_rows(stored.join(have, "id", "left_anti"), embed), vector_path)
    return added


def _append(rows: DataFrame, path: str) -> int:
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])
