"""A mix in which each source has its target share of all tokens.

Each record gets a random key by hashing its id with a seed.  Within each source, records are in
the order of their keys: key ranges, their number growing with the records, hold nearly equal numbers of
records of a source, because keys are uniform, so no source is ever sorted in one task.  Sums of the ranges are
few; their running sums plus running sums inside each range give every record the tokens before it,
and each source is cut where its budget ends.  Further passes over a source repeat it from its
beginning, so a record with p tokens up to and with it is taken in pass e while p + e * S is within
the budget, S being the source's tokens.  The record in which a budget ends gives its first tokens
only, so shares are exact to a token.

Defined cases: a source without targets, or null, is left out; a target without records has share 0
and is reported; records without tokens go with the first pass; targets with null or no positive
share get nothing; repeated rows are records of their own (ties in the key are ordered by the
id and share their place).  An empty table gives an empty mix and a report of zero shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least number of ranges of a source, and records of all sources for one of them beyond that.
RANGES, PER_RANGE = 256, 20_000


def keyed(counts: DataFrame, seed: int = 0) -> DataFrame:
    """counts (doc_id, source, n_tokens) with a uniform key and its range; there are more ranges the more records there are."""
    ranges = min(max(RANGES, -(-counts.count() // PER_RANGE)), 1 << 20)
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"))
    return counts.withColumn("key", key).withColumn("range", F.shiftright((F.shiftright("key", 32) + (1 << 31)) * ranges, 32).cast("int"))


def budgets(sums: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """source, target_share, max_repeats, size, budget: one row per target source.

    Without a total, it is the largest for which every source that has tokens can reach its share.
    """
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # only sources with a target, so there are no more rows than targets
    size = sums.join(t.select("source"), "source", "left_semi").groupBy("source").agg(F.sum("range_tokens").alias("size"))
    both = t.join(size, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    can = F.col("size") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    live = (F.col("target_share") > 0) & (F.col("size") > 0)
    most = F.lit(total) if total is not None else F.min(F.when(live, can / F.col("target_share"))).over(Window.partitionBy())
    return both.withColumn("total", most).withColumn(
        "budget", F.when(live, F.least(can.cast("double"), F.col("target_share") * F.col("total"))).otherwise(F.lit(0.0))
    )


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies, part_tokens): every record taken, how often it is taken
    whole, and how many of its first tokens are taken once more because the budget ends inside it.

    counts is read twice, so it should be a table or a checkpoint.
    """
    docs = keyed(counts.where("source IS NOT NULL"), seed)
    sums = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    # a row for each source and range
    before = sums.withColumn("before", F.sum("range_tokens").over(Window.partitionBy("source").orderBy("range")) - F.col("range_tokens"))
    plan = before.join(budgets(sums, targets, total), "source").select("source", "range", "before", "size", "budget", "max_repeats")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id")
    placed = docs.withColumn("own", F.sum("n_tokens").over(inside)).join(plan, ["source", "range"])
    upto = F.col("before") + F.col("own")
    budget = F.floor("budget")
    full = F.when(budget < upto, F.lit(0)).otherwise(
        F.least(F.floor((budget - upto) / F.col("size")) + 1, F.coalesce("max_repeats", F.lit(1)))
    )
    left = budget - (upto - F.col("n_tokens")) - F.col("copies") * F.col("size")
    return (
        placed.withColumn("copies", full.cast("int"))
        .withColumn("part_tokens", F.greatest(F.least(left, F.col("n_tokens")), F.lit(0)).cast("long"))
        .where("copies > 0 OR part_tokens > 0")
        .select("doc_id", "source", "n_tokens", "copies", "part_tokens")
    )


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, tokens, max_copies, actual_share of each target."""
    used = (F.col("part_tokens") > 0).cast("int")
    got = mixed.groupBy("source").agg(
        F.sum(F.col("copies") + used).cast("long").alias("records"),
        F.sum(F.col("n_tokens") * F.col("copies") + F.col("part_tokens")).cast("long").alias("tokens"),
        F.max(F.col("copies") + used).alias("max_copies"),
    )
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    rows = t.join(got, "source", "left").select("source", "target_share", "max_repeats", zero("records", "long"), zero("tokens", "long"), zero("max_copies", "int"))
    whole = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
