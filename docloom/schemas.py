"""Schemas of the document store, the vector store, document items, triples and graphs."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType(
    [T.StructField("page", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("l", "t", "r", "b")]
    + [T.StructField("coord_origin", T.StringType())]
)
IMAGE_META = T.StructType(
    [T.StructField("mimetype", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
)
METADATA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("pages", T.ArrayType(T.IntegerType())),
        T.StructField("bboxes", T.ArrayType(BBOX)),
        T.StructField("image_meta", IMAGE_META),
    ]
)
#: A record of the document store; its metadata is JSON inside JSON.
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("content", "id", "context", "description", "type", "metadata")])
VECTOR_ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "type", "page_content", "metadata")] + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
RELATIONSHIP = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("head", "head_type", "relation", "tail", "tail_type")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("context", T.StringType()), T.StructField("language", T.StringType())]
)
NODE = T.StructType([*(T.StructField(c, T.StringType()) for c in ("node", "label", "type")), T.StructField("n", T.LongType())])
EDGE = T.StructType(
    [*(T.StructField(c, T.StringType()) for c in ("src", "rel", "dst")), T.StructField("weight", T.LongType()), T.StructField("confidence", T.DoubleType())]
)
GRAPH_ANSWER = T.StructType([T.StructField("relationships", T.ArrayType(RELATIONSHIP))])
ITEM = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("self_ref", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("prov", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("bbox", T.StructType(BBOX.fields[1:]))]))),
    ]
)
TYPES = ("text", "table", "image")
