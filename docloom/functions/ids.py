"""Content ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_id(content: Column, filename: Column) -> Column:
    """SHA-256 in hex of content, underscore, file name; null content counts as empty, no file name as `unknown`."""
    return F.sha2(F.concat(F.coalesce(content, F.lit("")), F.lit("_"), F.coalesce(filename, F.lit("unknown"))), 256)


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """One bit for the sign of each of the first components; a 64-bit hash that near vectors nearly share."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")
