"""Near-duplicate removal in document order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def greedy_hamming(df: DataFrame, group: str, order: str, hash_: str, threshold: int = 10) -> DataFrame:
    """(group, order, hash) of the rows kept: a row goes if an earlier kept one of its group is within threshold bits.

    The first wins, and a removed row removes nothing.  The fold is sequential in a group; rows
    come sorted inside their partition and only the hashes kept of the open group are held.
    """
    kind = dict(df.dtypes)
    rows = df.select(group, order, hash_).where(F.col(hash_).isNotNull()).repartition(group).sortWithinPartitions(group, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        at, kept, n, first = None, np.zeros(64, np.uint64), 0, True
        for b in batches:
            out = np.zeros(len(b), bool)
            values = b[hash_].to_numpy(np.int64).view(np.uint64)
            for i, g in enumerate(b[group]):
                if first or g != at:
                    at, n, first = g, 0, False
                if n and (np.bitwise_count(kept[:n] ^ values[i]) <= threshold).any():
                    continue
                if n == len(kept):
                    kept = np.concatenate([kept, np.zeros_like(kept)])
                kept[n], n, out[i] = values[i], n + 1, True
            yield b[out]

    return rows.mapInPandas(run, f"`{group}` {kind[group]}, `{order}` {kind[order]}, `{hash_}` {kind[hash_]}")


def greedy_near(df: DataFrame, group: str, order: str, hash_: str, threshold: int = 10) -> DataFrame:
    """The rows of greedy_hamming, for thresholds that banding prunes at (below 12), with no group in one task.

    Of equal hashes only the first can stay.  Pairs within threshold are found by hamming_pairs; then, all groups and
    rows at a time, a row stays once no earlier near one is left, and those near a row that stays go.  Each round is
    checkpointed; rounds are as many as the longest chain of near rows that alternately stay and go.
    """
    if threshold >= 12:
        raise ValueError("hashes are not pruned by bands at this threshold: use greedy_hamming")
    own = F.xxhash64(group).alias("_g")
    rows = df.where(F.col(hash_).isNotNull()).groupBy(group, hash_).agg(F.min(order).alias(order))
    edges = cut(hamming_pairs(rows.select(own, F.col(order).alias("_k"), F.col(hash_).alias("_h")), "_g", "_k", "_h", threshold).select("_g", "a", "b"))
    gone = []
    while not edges.isEmpty():
        later = edges.select("_g", F.col("b").alias("a")).distinct()
        stay = edges.select("_g", "a").distinct().join(later, ["_g", "a"], "left_anti")
        out = cut(edges.join(stay, ["_g", "a"]).select("_g", F.col("b").alias("_k")).distinct())
        left = edges.join(stay, ["_g", "a"], "left_anti")
        for end in "ab":
            left = left.join(out.withColumnRenamed("_k", end), ["_g", end], "left_anti")
        gone.append(out)
        edges = cut(left)
    kept = rows.withColumn("_g", own).withColumn("_k", F.col(order))
    for out in gone:
        kept = kept.join(out, ["_g", "_k"], "left_anti")
    return kept.select(group, order, hash_)


def greedy_hamming_sql(df: DataFrame, group: str, order: str, hash_: str, threshold: int = 10) -> DataFrame:
    """The same fold as one expression, for groups that fit into a row."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hash_).alias("h"))))
    none = F.slice(F.col("items"), 1, 0)
    near = lambda acc, x: F.exists(acc, lambda k: F.bit_count(k["h"].bitwiseXOR(x["h"])) <= threshold)
    kept = F.aggregate("items", none, lambda acc, x: F.when(near(acc, x), acc).otherwise(F.array_append(acc, x)))
    rows = df.where(F.col(hash_).isNotNull()).groupBy(group).agg(items.alias("items")).select(group, F.explode(kept).alias("k"))
    return rows.select(group, F.col("k.o").alias(order), F.col("k.h").alias(hash_))


def hamming_pairs(df: DataFrame, group: str, key: str, hash_: str, threshold: int, bands: int | None = None) -> DataFrame:
    """(group, a, b, distance) of all pairs of a group within threshold bits, a before b.

    Below `bands` differing bits two hashes share one of `bands` bands, so they meet on group, band and
    its value; from there on the threshold is split: bands are compared by all values within
    threshold // bands bits of theirs.  Wide bands prune most as long as few values are near one: four
    of 16 bits, met by 137 values each, leave 0.8 % of unlike pairs at a threshold of 8 to 11; from 12 on
    eight narrower ones are used, which leave more the higher the threshold is.
    """
    bands = bands or (4 if threshold < 12 else 8)
    width, radius = 64 // bands, threshold // bands
    masks = [m for m in range(1 << width) if bin(m).count("1") <= radius]
    band = lambda i: F.shiftrightunsigned(F.col(hash_), i * width).bitwiseAND((1 << width) - 1)
    parts = F.array(*(F.struct(F.lit(i).alias("band"), band(i).alias("value")) for i in range(bands)))
    rows = df.select(group, F.col(key).alias("k"), F.col(hash_).alias("h"), F.explode(parts).alias("p")).select(group, "k", "h", "p.band", "p.value")
    probe = rows.withColumn("value", F.explode(F.array(*(F.col("value").bitwiseXOR(F.lit(m).cast("long")) for m in masks))))
    met = probe.alias("x").join(rows.alias("y"), [group, "band", "value"]).where("x.k < y.k")
    d = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h"))).cast("long")
    return met.select(group, F.col("x.k").alias("a"), F.col("y.k").alias("b"), d.alias("distance")).where(F.col("distance") <= threshold).distinct()


def keep_by_content(df: DataFrame, kept: DataFrame, content: str) -> DataFrame:
    """Rows whose content is among those kept: copies of a kept row all stay."""
    return df.join(kept.select(content).distinct(), content, "left_semi")
