"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def running_sum(df: DataFrame, group: str, order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over the rows of its group up to and with the row, in order of an integer column.

    Rows are summed inside blocks of the order column, block sums are few and summed once more, so a
    group with a third of all rows is spread over many tasks.  Rows with equal order share their sum.
    """
    at = F.floor(F.col(order) / block).alias("_block")
    rows = df.withColumn("_value", value).withColumn("_block", at)
    sums = rows.groupBy(group, "_block").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(group).orderBy("_block")) - F.col("_sum")).drop("_sum")
    inside = F.sum("_value").over(Window.partitionBy(group, "_block").orderBy(order))
    return rows.withColumn("_inside", inside).join(before, [group, "_block"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_value", "_block", "_inside", "_before")
