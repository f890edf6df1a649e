"""Triples: from tables without a model, from model answers, and their validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Generate, generate
from ..functions.text import screaming_snake, title_case
from ..schemas import GRAPH_ANSWER

#: Cells that state nothing, in lower case.
EMPTY_CELLS = ("", "-", "n/a", "na", "null", "none")
#: Two-letter language codes and the three-letter ones for them.
CODES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por"}


def table_triples(df: DataFrame, head: str, columns: list[str], head_type: str = "ENTITY") -> DataFrame:
    """(head, head_type, relation, tail, tail_type) of a table's rows: first column, header, cell; empty cells give none."""
    cells = F.array(*(F.struct(screaming_snake(F.lit(c)).alias("relation"), F.col(c).cast("string").alias("tail")) for c in columns))
    rows = df.select(F.col(head).cast("string").alias("head"), F.explode(cells).alias("c")).select("head", "c.relation", "c.tail")
    stated = F.col("head").isNotNull() & F.col("tail").isNotNull() & ~F.lower(F.trim("tail")).isin(*EMPTY_CELLS)
    return rows.where(stated).select("head", F.lit(head_type).alias("head_type"), "relation", "tail", F.lit("VALUE").alias("tail_type"))


def markdown_triples(df: DataFrame, key: str, markdown: str = "content") -> DataFrame:
    """(key, row_no, head, relation, tail) of Markdown tables; text around a table and separator rows are skipped."""
    lines = F.filter(F.split(F.col(markdown), "\r?\n"), lambda s: F.trim(s).startswith("|"))
    cells = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))
    rows = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{2,}:?$")))
    body = df.select(key, rows.alias("rows")).where(F.size("rows") > 1).select(key, F.element_at("rows", 1).alias("header"), F.posexplode(F.slice(F.col("rows"), 2, 1 << 30)).alias("row_no", "row"))
    cell = body.select(key, "row_no", F.element_at("row", 1).alias("head"), F.explode(F.slice(F.arrays_zip(F.col("header"), F.col("row")), 2, 1 << 30)).alias("c"))
    out = cell.select(key, F.col("row_no").cast("long").alias("row_no"), "head", screaming_snake(F.col("c.header")).alias("relation"), F.col("c.row").alias("tail"))
    empty = lambda c: F.coalesce(F.lower(c), F.lit("")).isin(*EMPTY_CELLS)
    return out.where(~empty(F.col("head")) & ~empty(F.col("tail")) & (F.col("relation") != ""))


def extraction_plan(elements: DataFrame) -> DataFrame:
    """Elements with the branch that extracts from them, or the reason why none does; content is tested before type."""
    kind = F.col("type")
    reason = F.when(F.col("content").isNull(), "no content").when(kind.isNull(), "no type").when(~kind.isin("text", "table", "image"), "unknown type")
    return elements.withColumn("reason", reason).withColumn("branch", F.when(reason.isNull(), kind))


def extract(elements: DataFrame, models: dict[str, Generate], systems: dict[str, str] | None = None, concurrency: int = 5) -> DataFrame:
    """(id, relationships, error): answers of the branch's model, parsed; failed rows keep their error, and no triples stay an empty list."""
    plan, out = extraction_plan(elements).where("branch IS NOT NULL"), None
    for branch, model in models.items():
        parts = ["content"] if branch == "text" else ["context", "description", "content"]
        got = generate(plan.where(F.col("branch") == branch), "response", parts, model, (systems or {}).get(branch, ""), concurrency)
        rel = F.from_json("response", GRAPH_ANSWER)["relationships"]
        error = F.coalesce("response_error", F.when(rel.isNull(), F.lit("not a graph")))
        rows = got.select("id", rel.alias("relationships"), error.alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


def explode_triples(raw: DataFrame) -> DataFrame:
    return raw.where("relationships IS NOT NULL").select("id", F.posexplode("relationships").alias("pos", "r")).select("id", "pos", "r.*")


def collect_triples(triples: DataFrame, key: str = "doc_id", order: str = "triple_no") -> DataFrame:
    """(key, relationships): triples of each document in order."""
    fields = ("head", "head_type", "relation", "tail", "tail_type", "confidence", "context", "language")
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("r"))))
    return triples.groupBy(key).agg(F.transform(items, lambda x: x["r"]).alias("relationships"))


def validity(confidence: str = "confidence") -> Column:
    """Reason why a triple is not valid; null for a valid one."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank("head"), "no head").when(blank("relation"), "no relation").when(blank("tail"), "no tail")
        .when(F.col(confidence).isNull() | F.isnan(confidence), "no confidence").when(~F.col(confidence).between(0.0, 1.0), "confidence out of range")
    )


def language_code(c: Column) -> Column:
    """Three-letter code in lower case of a two- or three-letter code, with or without a region; null for anything else."""
    base = F.lower(F.regexp_extract(F.trim(c), "^([A-Za-z]{2,3})(?:[-_][A-Za-z]{2,4})?$", 1))
    table = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    return F.when(base.isin(*CODES.values()), base).otherwise(table[base])


def normal_entity(c: Column) -> Column:
    """An entity's name in one form: no quotes or brackets around it, single spaces, no closing full stop, shouted words in title case."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[\s\"'(\[«“]+|[\s\"')\]»”.,;]+$", "")
    shouted = (F.upper(bare) == bare) & bare.rlike(r"\p{L}{4}")
    return F.when(shouted, title_case(bare)).otherwise(bare)
