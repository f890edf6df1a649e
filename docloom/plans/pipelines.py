"""Whole pipelines out of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images
from ..functions.models import Generate, generate
from ..operators import elements as el
from ..operators import dedup, graph, rag, search, store, triples
from ..sources.readers import open_store
from . import prompts


def build_elements(items: DataFrame, budget: int = 128, context_budget: int = 512, threshold: int = 10, table_text: Column | None = None) -> DataFrame:
    """Text chunks, tables and pictures of ordered items as elements with context and metadata.

    Tables stand in the text chunks too, as they are read in order.  table_text says how a table is
    written, by default as its text.  Items may have a column `image` (base64): a picture's content, by which pictures
    of a file within threshold bits of an earlier one, by perceptual hash, are left out.
    """
    items = items.dropDuplicates(["filename", "seq"])
    if table_text is not None:
        items = items.withColumn("text", F.when(F.lower("label") == "table", table_text).otherwise(F.col("text")))
    label = F.lower(F.coalesce("label", F.lit("")))
    parts = el.pack_chunks(el.split_items(items.where(label != "picture"), budget), budget, headings=True)
    chunks = el.with_chunk_metadata(parts, items).select("filename", F.col("text").alias("content"), F.lit("").alias("context"), F.lit("text").alias("type"), F.to_json("metadata").alias("metadata"))
    near = el.context(items, label.isin("table", "picture"), context_budget).select("filename", "seq", "context")
    kinds = F.when(label == "table", "table").otherwise("image")
    others = items.where(label.isin("table", "picture"))
    image, meta = F.lit(None).cast("string"), None
    if "image" in items.columns:
        pictures = others.where(label == "picture").withColumn("hash", images.perceptual_hash(F.col("image")))
        seen = (dedup.greedy_near if threshold < 12 else dedup.greedy_hamming)(pictures.where("hash IS NOT NULL"), "filename", "seq", "hash", threshold)
        gone = pictures.where("hash IS NOT NULL").select("filename", "seq").join(seen, ["filename", "seq"], "left_anti")
        others, image = others.join(gone, ["filename", "seq"], "left_anti"), F.when(label == "picture", F.col("image"))
        others, meta = others.withColumn("image_meta", images.info(F.col("image"))), F.col("image_meta")
    others = others.join(near, ["filename", "seq"], "left")
    others = others.select("filename", F.coalesce(image, F.col("text")).alias("content"), F.coalesce("context", F.lit("")).alias("context"), kinds.alias("type"), F.to_json(el.metadata(F.col("filename"), F.col("prov"), meta)).alias("metadata"))
    # a chunk that is one table and no more is that table's element
    return chunks.join(others.select("filename", "content"), ["filename", "content"], "left_anti").unionByName(others)


def summarise(elements: DataFrame, models: dict[str, Generate] | None = None, systems: dict[str, str] | None = None) -> DataFrame:
    """Elements with a description by the model of their type; texts are summarised without context, unknown types as texts."""
    kind, out = F.coalesce("type", F.lit("text")), None
    for name, system in (prompts.SUMMARY | (systems or {})).items():
        mine = elements.where(kind == name if name != "text" else ~kind.isin("table", "image"))
        parts = ["content"] if name == "text" else ["context", "content"]
        got = generate(mine, "description", parts, (models or {}).get(name), system)
        out = got if out is None else out.unionByName(got)
    return out


def populate(
    spark: SparkSession, elements: DataFrame, doc_path: str, vector_path: str, models: dict[str, Generate] | None = None, embed: Column | None = None, systems: dict[str, str] | None = None
) -> dict[str, int]:
    """Summarise and store what is new, and say how much that was.

    Stored elements never reach a model, and what a model fails on is left for the next run.
    """
    fresh = store.new_rows(store.with_ids(elements), open_store(spark, doc_path))
    described = summarise(fresh, models, systems).where("description_error IS NULL")
    return store.insert(spark, described, doc_path, vector_path, embed=embed)


def graph_answers(questions: DataFrame, rows: DataFrame, model: Generate | None = None) -> DataFrame:
    """(qid, question, answer) from the rows (qid, row) that a match found for each question; without rows the answer is that it is not known.

    A question's rows become one prompt, so callers limit what a match returns to what a prompt can hold.
    """
    found = rows.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("rows"))
    both = questions.join(found, "qid", "left")
    asked = generate(both.where("rows IS NOT NULL"), "answer", ["question", "rows"], model, prompts.GRAPH_ANSWER)
    none = both.where("rows IS NULL").withColumn("answer", F.lit(prompts.NOT_KNOWN))
    return asked.select("qid", "question", "answer").unionByName(none.select("qid", "question", "answer"))


def ask_graph(questions: DataFrame, edges: DataFrame, model: Generate, answer_model: Generate | None = None, most: int = 50) -> DataFrame:
    """(qid, question, answer): a model turns each question (qid, question) into a pattern, which is matched with the edges.

    A pattern is a JSON object with head, relation and tail, null or absent where any will do.  Up to `most` edges by
    weight go into the prompt for the answer; without a pattern or an edge it is that it is not known.
    """
    asked = generate(questions.select("qid", "question"), "pattern", ["question"], model, prompts.PATTERN)
    p = asked.select("qid", F.from_json("pattern", "head string, relation string, tail string").alias("p")).where("p IS NOT NULL AND coalesce(p.head, p.relation, p.tail) IS NOT NULL")
    free = lambda c: F.col(f"p.{c}").isNull()
    # one equi-join for each kind of pattern, on what it names
    names, found = {"head": "src", "relation": "rel", "tail": "dst"}, None
    for kind in range(1, 8):
        named = [n for i, n in enumerate(names) if kind >> i & 1]
        rows = p
        for n in names:
            rows = rows.where(~free(n) if n in named else free(n))
        met = rows.select("qid", *(F.col(f"p.{n}").alias(names[n]) for n in named)).join(edges.select("src", "rel", "dst", "weight"), [names[n] for n in named])
        met = met.select("qid", "src", "rel", "dst", "weight")
        found = met if found is None else found.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "src", "rel", "dst"))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= most).select("qid", F.concat_ws(" ", "src", "rel", "dst").alias("row"))
    return graph_answers(questions, rows, answer_model)


def answer_questions(questions: DataFrame, vectors: DataFrame, records: DataFrame, k: int = 4, metric: str = "l2", model: Generate | None = None) -> DataFrame:
    """questions (qid, question, qvec) with their answers from the records (id, value)."""
    hits = search.top_k(questions, vectors, k, metric)
    found = rag.modalities(rag.route(search.parents(hits, records)))
    return rag.answer(rag.prompts(questions.select("qid", "question"), found), model)


def build_graph(elements: DataFrame, models: dict[str, Generate], systems: dict[str, str] | None = None, kinds: list[tuple[str, str, str]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and mentions of what the models extract; tables without a model give their triples by rule.

    Models are asked by the prompts of EXTRACTION or the caller's; kinds (head type, relation, tail type), such as a
    graph's schema_summary gives, are put into them.
    """
    asked = {k: prompts.with_schema(v, list(kinds)) for k, v in (prompts.EXTRACTION | (systems or {})).items()}
    raw = triples.explode_triples(triples.extract(elements, models, asked)).withColumnRenamed("id", "doc_id")
    if "table" not in models:
        rule = triples.markdown_triples(elements.where("type = 'table'"), "id").withColumnRenamed("id", "doc_id").drop("row_no")
        raw = raw.unionByName(rule.withColumns({"head_type": F.lit("ENTITY"), "tail_type": F.lit("VALUE"), "confidence": F.lit(1.0)}), allowMissingColumns=True)
    return graph.nodes(raw), graph.edges(raw), graph.mentions(raw)


def summarise_communities(edges: DataFrame, rounds: int = 5, model: Generate | None = None, most: int = 50) -> DataFrame:
    """(community, n_nodes, n_edges, facts, summary) of the communities of a graph."""
    facts = graph.community_facts(edges, graph.label_propagation(edges, rounds), most)
    return generate(facts, "summary", ["facts"], model, prompts.COMMUNITY).drop("summary_error")


def filename(metadata: str = "metadata") -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.filename"), F.lit("unknown"))
