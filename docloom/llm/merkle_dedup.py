"""Copies that differ in format only: bottom-up hashing of nested records.

Each leaf is normalised and hashed, the digests of an unordered node's children are sorted before
they are hashed, and records are grouped by the digest at the root.  A group counts only after its
members' canonical forms have been compared in full, so a clash of digests never joins two records.

Defined cases: a null leaf equals a null or absent one; under keys whose format is dropped a leaf without
letters and digits equals the empty text, so `+` and `-` are equal; a null record (for JSON: text that is not one complete object) belongs to no group;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, letters_digits

Leaf = Callable[[Column, Column], Column]
SALTS = 32


def exact_leaf(key: Column, value: Column) -> Column:
    return value.cast("string")


def format_free(keys: list[str]) -> Leaf:
    """Leaves under one of the keys (letters and digits, lower case) lose their format; others stay."""
    return lambda key, value: F.when(key.isin(keys), letters_digits(value)).otherwise(value.cast("string"))


class Merkle:
    """Digest and canonical form of a value of any Spark type.

    Structs and maps are unordered and their field names lose their format; arrays keep their
    order unless unordered_arrays is set.
    """

    def __init__(self, leaf: Leaf = exact_leaf, unordered_arrays: bool = False):
        self.leaf, self.unordered_arrays = leaf, unordered_arrays

    def _children(self, value: Column, kind: T.DataType, key: Column, node) -> Column:
        if isinstance(kind, T.StructType):
            return F.filter(
                F.array(*(node(value[f.name], f.dataType, letters_digits(F.lit(f.name))) for f in kind.fields)),
                lambda x: x.isNotNull(),
            )
        if isinstance(kind, T.MapType):
            entries = F.transform(
                F.map_entries(value),
                lambda e: node(e["value"], kind.valueType, letters_digits(e["key"])),
            )
            return F.filter(entries, lambda x: x.isNotNull())
        return F.transform(value, lambda x: F.coalesce(node(x, kind.elementType, key), node(F.lit(""), T.StringType(), key)))

    def _sorted(self, children: Column, kind: T.DataType) -> Column:
        return children if isinstance(kind, T.ArrayType) and not self.unordered_arrays else F.array_sort(children)

    def digest(self, value: Column, kind: T.DataType, key: Column | None = None) -> Column:
        key = F.lit("") if key is None else key
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            own = F.xxhash64(key, self._sorted(self._children(value, kind, key, self.digest), kind))
        else:
            own = F.xxhash64(key, self.leaf(key, value))
        return F.when(value.isNotNull(), own)

    def canonical(self, value: Column, kind: T.DataType, key: Column | None = None) -> Column:
        """One text per class of equal values: keys and leaves bear their lengths, so none can run into another."""
        key = F.lit("") if key is None else key
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            own = F.array_join(self._sorted(self._children(value, kind, key, self.canonical), kind), "")
        else:
            own = self.leaf(key, value)
        return F.concat(F.length(key), F.lit(":"), key, F.length(own), F.lit("="), own)


def json_object(payload: Column) -> Column:
    """Map of a complete JSON object's fields as texts; null for anything else."""
    whole = F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT")
    fields = F.from_json(payload, T.MapType(T.StringType(), T.StringType()))
    return F.when(whole, fields)


def records(df: DataFrame, number: str, record: Column, kind: T.DataType, leaf: Leaf) -> DataFrame:
    """(no, digest, canon) of each row with a record."""
    m = Merkle(leaf)
    return (
        df.select(F.col(number).alias("no"), record.alias("record"))
        .where(F.col("record").isNotNull() & F.col("no").isNotNull())
        .select("no", m.digest(F.col("record"), kind).alias("digest"), m.canonical(F.col("record"), kind).alias("canon"))
    )


def _repeated(recs: DataFrame) -> DataFrame:
    """Digests that stand twice or more: all that most rows are shuffled for."""
    return bounded(recs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))


def _classes(recs: DataFrame) -> DataFrame:
    """(digest, canon, first_no, n_copies), one row for each class of equal records.

    Counted in two steps with a salt, each with partial aggregation, so a class with a third of
    all rows is spread over many tasks.  A digest shared by two canonical forms falls apart here:
    that is the full comparison.
    """
    salted = recs.groupBy("digest", "canon", F.pmod(F.xxhash64("no"), F.lit(SALTS)).alias("salt")).agg(
        F.min("no").alias("first_no"), F.count(F.lit(1)).alias("n_copies")
    )
    return salted.groupBy("digest", "canon").agg(F.min("first_no").alias("first_no"), F.sum("n_copies").alias("n_copies"))


def groups(recs: DataFrame) -> DataFrame:
    """(first_no, n_copies), one row for each class of equal records.

    Records of a digest that stands once are classes of their own, so only the others' canonical forms are compared.
    """
    many = _repeated(recs)
    single = recs.join(many, "digest", "left_anti").select(F.col("no").alias("first_no"), F.lit(1).cast("long").alias("n_copies"))
    return single.unionByName(_classes(recs.join(many, "digest", "left_semi")).select("first_no", "n_copies"))


def copies(recs: DataFrame) -> DataFrame:
    """(first_no, copy_no): each row equal to one of a smaller number, with the smallest number of its class.

    Only rows of a digest that stands twice or more are compared; they meet their class on the digest and are
    compared with it in full.  The class side has one row per class, so adaptive execution may split a class of any
    size over tasks.
    """
    some = recs.join(_repeated(recs), "digest", "left_semi")
    many = _classes(some).where("n_copies > 1").select("digest", F.col("canon").alias("g_canon"), "first_no")
    return (
        some.join(many, "digest")
        .where((F.col("canon") == F.col("g_canon")) & (F.col("no") > F.col("first_no")))
        .select("first_no", F.col("no").alias("copy_no"))
        .distinct()
    )
