"""Prompts for answering questions from retrieved records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import parse_or_text
from ..functions.models import Generate, generate
from ..functions.text import data_uri

SYSTEM = "Answer from the given sources only, name the sources you use, and say so if they don't hold the answer."


def route(retrieved: DataFrame, value: str = "value") -> DataFrame:
    """retrieved (qid, rank, value) with content, type and whether it is an image; all else is text."""
    content, kind = parse_or_text(F.col(value))
    return retrieved.select("qid", "rank", content.alias("content"), kind.alias("type")).withColumn("is_image", F.col("type") == "image")


def modalities(routed: DataFrame) -> DataFrame:
    """(qid, images, texts) in order of rank; a question has k records at most."""
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "content")))), lambda x: x["content"])
    return routed.groupBy("qid").agg(pick(F.col("is_image")).alias("images"), pick(~F.col("is_image")).alias("texts"))


def context_block(texts: str = "texts"):
    """Texts numbered from 0 as [Source i], blank lines between them."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[Source "), i.cast("string"), F.lit("]: "), F.coalesce(t, F.lit("")))), "\n\n")


def prompts(questions: DataFrame, found: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(qid, question, prompt, messages): every question (qid, question) with its context, with or without records."""
    both = questions.join(found, "qid", "left")
    none = F.array().cast("array<string>")
    both = both.withColumn("texts", F.coalesce("texts", none)).withColumn("images", F.coalesce("images", none))
    prompt = F.concat(F.lit("Context:\n"), context_block(), F.lit("\n\nQuestion: "), F.col("question"))
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))
    null = F.lit(None)
    user = F.concat(F.array(part("text", F.col("prompt"), null)), F.transform("images", lambda b: part("image_url", null, data_uri(b))))
    message = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("parts"))
    return both.withColumn("prompt", prompt).select(
        "qid", "question", "prompt", F.array(message("system", F.array(part("text", F.lit(system), null))), message("user", user)).alias("messages")
    )


def answer(prompted: DataFrame, model: Generate | None = None) -> DataFrame:
    """The prompts with the model's answers."""
    return generate(prompted, "answer", ["prompt"], model, SYSTEM)
