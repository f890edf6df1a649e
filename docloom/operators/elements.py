"""Elements of documents: metadata, labels, chunks, surrounding context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import central_crop, strip, token_count
from .running import running_sum


def metadata(filename: Column, prov: Column, image_meta: Column | None = None) -> Column:
    """Struct of file name, sorted distinct pages and boxes in order; a null prov gives empty lists."""
    prov = F.coalesce(prov, F.array().cast("array<struct<page:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"))
    pages = F.array_sort(F.array_distinct(F.filter(F.transform(prov, lambda p: p["page"]), lambda p: p.isNotNull())))
    boxes = F.transform(
        F.filter(prov, lambda p: p["bbox"].isNotNull()),
        lambda p: F.struct(p["page"].alias("page"), *(p["bbox"][c].alias(c) for c in ("l", "t", "r", "b", "coord_origin"))),
    )
    extra = [image_meta.alias("image_meta")] if image_meta is not None else []
    return F.struct(F.coalesce(filename, F.lit("unknown")).alias("filename"), pages.alias("pages"), boxes.alias("bboxes"), *extra)


def chunk_metadata(filename: Column, items: Column) -> Column:
    """Metadata of a chunk of several items: the boxes of all of them."""
    return metadata(filename, F.flatten(F.transform(items, lambda i: F.coalesce(i["prov"], F.array()))))


def with_label(items: DataFrame, label: str) -> DataFrame:
    return items.where(F.lower("label") == label)


def first_item(items: DataFrame, condition: Column) -> DataFrame:
    """First item in order of each document that meets the condition."""
    best = F.min_by(F.struct(*items.columns), F.struct("seq", F.coalesce("self_ref", F.lit("")))).alias("r")
    return items.where(condition).groupBy("filename").agg(best).select("r.*")


def split_items(items: DataFrame, budget: int) -> DataFrame:
    """Items with those of more than budget tokens cut into runs of budget tokens, in order; the runs of an item share its seq."""
    t = F.split(F.coalesce("text", F.lit("")), " ")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / budget).cast("int")), lambda i: F.array_join(F.slice(t, i * budget + 1, F.lit(budget)), " "))
    rest = [c for c in items.columns if c != "text"]
    return items.select(*rest, F.posexplode(runs).alias("part", "text"))


def pack_chunks(items: DataFrame, budget: int, count: Callable[[str], int] | None = None, headings: bool = False) -> DataFrame:
    """(filename, chunk_no, first_seq, last_seq, n_tokens, text): items packed greedily, in order, up to the budget.

    An item above the budget is a chunk of its own (see split_items).  With headings a chunk also ends
    before each item labelled as one.  Documents are sorted inside partitions and
    read as a stream, so a document of any length is never held whole.
    """
    many = count or (lambda t: len(t.split(" ")))
    heads = F.lower(F.coalesce("label", F.lit(""))).isin("title", "section_header") if headings else F.lit(False)
    part = F.col("part") if "part" in items.columns else F.lit(0)
    ordered = items.select("filename", F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), heads.alias("head"), part.alias("part")).repartition("filename").sortWithinPartitions("filename", "seq", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("filename", "chunk_no", "first_seq", "last_seq", "n_tokens", "text")
        started, open_ = False, None
        for b in batches:
            out = []
            for name, seq, text, head in zip(b["filename"], b["seq"], b["text"], b["head"]):
                n = many(text)
                if not started or name != open_[0] or open_[4] + n > budget or head:
                    if started:
                        out.append((*open_[:5], "\n".join(open_[5])))
                    open_ = [name, open_[1] + 1 if started and name == open_[0] else 0, seq, seq, n, [text]]
                    started = True
                else:
                    open_[3], open_[4] = seq, open_[4] + n
                    open_[5].append(text)
            yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame([(*open_[:5], "\n".join(open_[5]))], columns=names)

    return ordered.mapInPandas(run, "filename string, chunk_no long, first_seq long, last_seq long, n_tokens long, text string")


def with_chunk_metadata(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks with the metadata of their items: pages and boxes of all of them, in order."""
    own = items.select("filename", F.col("seq").cast("long").alias("seq"), "prov").dropDuplicates(["filename", "seq"])
    each = chunks.select("filename", "chunk_no", F.explode(F.sequence("first_seq", "last_seq")).alias("seq")).join(own, ["filename", "seq"])
    grouped = each.groupBy("filename", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("seq", "prov"))).alias("items"))
    return chunks.join(grouped.select("filename", "chunk_no", chunk_metadata(F.col("filename"), F.col("items")).alias("metadata")), ["filename", "chunk_no"], "left")


def context(items: DataFrame, targets: Column, budget: int, tok: Column | None = None, crop: Column | None = None) -> DataFrame:
    """(filename, seq, tok, prev_n, prev_tokens, next_n, next_tokens, context) of each target item.

    Neighbours before it are taken nearest first while they fit into half of what the target leaves of
    the budget, then those after it while they fit into the rest; either side ends at the first that
    doesn't fit.  The context is the texts before, the target and the texts after, by line, stripped.  A
    target that leaves nothing has no neighbours: its context is its own middle, `budget` tokens of it.

    tok counts the tokens of `text` and crop gives its middle, by spaces where no other tokenizer is given.  With
    running sums both sides are ranges, and as each neighbour costs its tokens, at most `budget`
    neighbours with tokens stand on a side: targets and items meet in buckets of the running sum,
    a document's length aside.
    """
    own = F.coalesce("text", F.lit(""))
    counted = items.select("filename", "seq", own.alias("text"), targets.alias("is_target")).withColumn("tok", token_count(F.col("text")) if tok is None else tok.cast("long"))
    cum = running_sum(counted, "filename", "seq", F.col("tok"), "cum").withColumn("bucket", F.floor(F.col("cum") / budget))
    t = cum.where(F.col("is_target") & (F.col("tok") < budget)).select("filename", F.col("seq").alias("tseq"), F.col("tok").alias("ttok"), F.col("cum").alias("tcum"), "bucket")
    t = t.withColumn("rem", budget - F.col("ttok")).withColumn("half", F.expr("rem div 2"))
    t = t.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2)))
    before = F.expr("seq < tseq AND (tcum - ttok) - (cum - tok) <= half AND (tcum - ttok) - cum < half")
    after = F.expr("seq > tseq AND cum - tcum <= rem AND cum - tok - tcum < rem")
    met = t.join(cum.select("filename", "seq", "tok", "cum", "text", "bucket"), ["filename", "bucket"]).where(before | after | F.expr("seq = tseq"))
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("seq", "tok", (F.col("cum") - F.col("tcum")).alias("upto"), "text"))))
    both = met.groupBy("filename", "tseq", "ttok", "rem").agg(some(before).alias("prev"), some(after).alias("later"), F.max(F.when(F.expr("seq = tseq"), F.col("text"))).alias("text"))
    tokens_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["tok"])
    both = both.withColumn("prev_tokens", tokens_of(F.col("prev")))
    left = F.col("rem") - F.col("prev_tokens")
    both = both.withColumn("next", F.filter("later", lambda x: (x["upto"] <= left) & (x["upto"] - x["tok"] < left)))
    lines = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n")
    head = F.when(F.size("prev") > 0, F.concat(lines("prev"), F.lit("\n"))).otherwise(F.lit(""))
    tail = F.when(F.size("next") > 0, F.concat(F.lit("\n"), lines("next"))).otherwise(F.lit(""))
    near = both.select(
        "filename", F.col("tseq").alias("seq"), F.col("ttok").alias("tok"), F.size("prev").cast("long").alias("prev_n"), "prev_tokens", F.size("next").cast("long").alias("next_n"),
        tokens_of(F.col("next")).alias("next_tokens"), strip(F.concat(head, F.lit("\n"), "text", F.lit("\n"), tail)).alias("context"),
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("prev_n", "prev_tokens", "next_n", "next_tokens")]
    middle = central_crop(F.col("text"), budget, budget) if crop is None else crop
    full = counted.where(F.col("is_target") & (F.col("tok") >= budget)).select("filename", "seq", "tok", *none, middle.alias("context"))
    return near.unionByName(full)
