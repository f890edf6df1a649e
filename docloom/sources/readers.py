"""Sources: files of a folder, document items, stores."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename
from ..schemas import ITEM, RECORD, VECTOR_ROW


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", with_content: bool = True) -> DataFrame:
    """path, filename, length, modificationTime and content of the files of one folder, not of those inside it."""
    if not folder:
        raise ValueError("a folder is needed")
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    kept = ["path", "length", "modificationTime", *(["content"] if with_content else [])]
    return df.select(*kept, basename(F.col("path")).alias("filename"))


def text_items(docs: DataFrame, filename: str = "filename", text: str = "text") -> DataFrame:
    """Lines of texts as ordered items (filename, seq, self_ref, label, text); headings are lines in capitals, tables lines of cells."""
    lines = docs.select(F.col(filename).alias("filename"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("seq", "text"))
    label = F.when(F.col("text").startswith("|"), "table").when((F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}"), "section_header").otherwise("text")
    return lines.select("filename", "seq", F.concat(F.lit("#/texts/"), F.col("seq")).alias("self_ref"), label.alias("label"), "text")


def html_items(docs: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Block elements of HTML pages as ordered items; tags inside a block are dropped."""
    block = r"(?is)<(h[1-6]|p|li|td|th|caption|pre)\b[^>]*>(.*?)</\1>"
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(block), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(block), F.lit(2)).alias("body"))
    rows = docs.select(F.col(url).alias("filename"), F.posexplode(found).alias("seq", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("b.body", "(?s)<[^>]*>", " "), r"\s+", " "))
    label = F.when(F.lower("b.tag").startswith("h"), "section_header").when(F.lower("b.tag") == "li", "list_item").when(F.lower("b.tag").isin("td", "th"), "table").otherwise("text")
    return rows.select("filename", "seq", F.concat(F.lit("#/html/"), F.col("seq")).alias("self_ref"), label.alias("label"), text.alias("text"))


def parse_files(df: DataFrame, parse, schema: T.StructType = ITEM) -> DataFrame:
    """Items of binary files by a parser of the caller: parse(filename, bytes) yields dicts of ITEM's fields."""
    import pandas as pd

    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            rows = [r for name, data in zip(b["filename"], b["content"]) for r in parse(name, bytes(data))]
            yield pd.DataFrame(rows, columns=names)

    return df.select("filename", "content").mapInPandas(run, schema)


def code_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Source code cut before each function, class or notebook cell, so definitions stay whole; adds seq and block."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^(?:async def |def |class |@\w|# %%))"), lambda p: F.trim(p) != "")
    return docs.select("*", F.posexplode(parts).alias("seq", "block"))


def open_store(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A store's rows; an empty DataFrame before its first write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    return open_store(spark, path, VECTOR_ROW)


def store_keys(store: DataFrame) -> DataFrame:
    """Keys only: the scan reads one column."""
    return store.select("id")


def multi_get(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Records of the keys, missing ones as nulls, in the keys' own columns."""
    return keys.join(store, "id", "left")


def literal_documents(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting from the session, else the environment, else the default."""
    return spark.conf.get(name, None) or os.environ.get(name.upper().replace(".", "_"), default)


def columns_or(df: DataFrame, **defaults: Column) -> DataFrame:
    """df with each named column, nulls and missing columns replaced by the default."""
    return df.withColumns({n: F.coalesce(F.col(n), d) if n in df.columns else d for n, d in defaults.items()})
