"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Rows of numbers that are broadcast at most; beyond that they are joined by shuffling.
BROADCAST = 1_000_000


def arrow_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """mapInArrow over columns as Python lists.

    make() runs once in each task and returns the function for a batch, so models and caches are
    built once and shared by the batches of a task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for b in batches:
            if b.num_rows:
                step = step or make()
                got = step({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def bounded(df: DataFrame) -> DataFrame:
    """A checkpoint of rows of numbers, marked for a broadcast only where there are BROADCAST of them at most."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df


def tasks(df: DataFrame) -> int:
    """Number of partitions for work in Python that depends on rows rather than bytes: at least one a core."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(table: DataFrame) -> DataFrame:
    """A table just read, in at least one partition a core.

    Only a table of fewer scan partitions than cores is repartitioned, so nothing large is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def element_fields(elements: DataFrame, *keep: str) -> DataFrame:
    """(elem_no, field, text, *keep): content of all but images, and context, of every row.

    Null texts are left out; a null type counts as not an image.
    """
    not_image = ~F.col("type").eqNullSafe("image")
    one = F.struct(F.lit("content").alias("field"), F.when(not_image, F.col("content")).alias("text"))
    two = F.struct(F.lit("context").alias("field"), F.col("context").alias("text"))
    return (
        elements.select("elem_no", *keep, F.explode(F.array(one, two)).alias("f"))
        .select("elem_no", "f.field", "f.text", *keep)
        .where(F.col("text").isNotNull())
    )


def letters_digits(c: Column) -> Column:
    """Letters and digits of a text in lower case; null stays null."""
    return F.lower(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]+", ""))
