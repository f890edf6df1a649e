"""Fill the stores from a folder of documents: python -m docloom -df FOLDER [-db STORES]"""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import functions as F

from .plans import pipelines
from .sources import readers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docloom", description="Fill the stores from a folder of documents")
    p.add_argument("-df", "--document_folder", required=True, help="folder of the documents")
    p.add_argument("-db", "--data_base", default="./localdb", help="folder of the stores")
    p.add_argument("--pattern", default="*.txt", help="names of the documents")
    p.add_argument("--parser", help="module:function that yields the items of a file (name, bytes); without it files are read as text")
    p.add_argument("--budget", type=int, default=128, help="tokens of a chunk")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docloom").getOrCreate()
    files = readers.files(spark, a.document_folder, a.pattern)
    if a.parser:
        module, _, name = a.parser.partition(":")
        items = readers.parse_files(files, getattr(importlib.import_module(module), name))
    else:
        texts = files.select("filename", F.decode("content", "UTF-8").alias("text"))
        items = readers.text_items(texts).withColumn("prov", F.lit(None).cast("array<struct<page:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"))
    pipelines.populate(spark, pipelines.build_elements(items, a.budget), os.path.join(a.data_base, "docs"), os.path.join(a.data_base, "vectors"))


if __name__ == "__main__":
    main()
