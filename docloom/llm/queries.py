"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read


def rows_of(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table for work in Python: columns only, if named, in at least one partition a core."""
    from .common import spread

    df = read(spark, sf_dir, table)
    return spread(df.select(*columns) if columns else df)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- 2: copies that differ in format only


def _relation_records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from . import merkle_dedup as m

    leaf = m.format_free(["relation", "headtype", "tailtype"])
    triples = read(spark, sf_dir, "triples").where(" AND ".join(f"{c} IS NOT NULL" for c in ("doc_id", "head", "relation", "tail")))
    triple = F.struct("doc_id", "head", "relation", "tail", "head_type", "tail_type")
    raw = read(spark, sf_dir, "raw_relations").withColumn("fields", m.json_object(F.col("payload"))).where("fields IS NOT NULL")
    answer = F.struct("doc_id", "fields")
    return {
        "triples": m.records(triples, "triple_no", triple, triples.select(triple.alias("r")).schema["r"].dataType, leaf),
        "raw_relations": m.records(raw, "raw_no", answer, raw.select(answer.alias("r")).schema["r"].dataType, leaf),
    }


@query
def p2_found(spark, sf_dir):
    """Each copy of a statement with the smallest number of its group."""
    from . import merkle_dedup as m

    found = [m.copies(r).select(F.lit(t).alias("tbl"), "first_no", "copy_no") for t, r in _relation_records(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


@query
def p2_collapsed(spark, sf_dir):
    """One record per statement with its number of copies."""
    from . import merkle_dedup as m

    found = [m.groups(r).select(F.lit(t).alias("tbl"), "first_no", "n_copies") for t, r in _relation_records(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


def _p2_classes() -> str:
    n = lambda c: f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
    return f"""
    WITH fields AS (
      SELECT raw_no, doc_id, {n('k.key')} AS key, json_extract_string(payload, '$."' || k.key || '"') AS value
      FROM raw_relations, unnest(json_keys(payload)) AS k(key) WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
    ), flat AS (
      SELECT raw_no, doc_id, max(value) FILTER (key = 'head') AS head, max(value) FILTER (key = 'relation') AS relation,
             max(value) FILTER (key = 'tail') AS tail, max(value) FILTER (key = 'headtype') AS head_type,
             max(value) FILTER (key = 'tailtype') AS tail_type
      FROM fields GROUP BY ALL
    ), stmts AS (
      SELECT 'triples' AS tbl, triple_no AS no, doc_id, head, relation, tail, head_type, tail_type FROM triples
      WHERE doc_id IS NOT NULL AND head IS NOT NULL AND relation IS NOT NULL AND tail IS NOT NULL
      UNION ALL SELECT 'raw_relations', raw_no, doc_id, head, relation, tail, head_type, tail_type FROM flat
    ), classes AS (
      SELECT tbl, no, min(no) OVER w AS first_no, count(*) OVER w AS n_copies FROM stmts
      WINDOW w AS (PARTITION BY tbl, doc_id, head, tail, {n('relation')}, {n('head_type')}, {n('tail_type')})
    )"""


SQL["p2_found"] = _p2_classes() + " SELECT DISTINCT tbl, first_no, no AS copy_no FROM classes WHERE no > first_no"
SQL["p2_collapsed"] = _p2_classes() + " SELECT tbl, first_no, n_copies FROM classes WHERE no = first_no"


# --- 3: long texts in pieces


@query
def p3_pieces(spark, sf_dir):
    """Pieces of at most 2,000 characters, each after the first repeating the last 200 of the one before."""
    from .common import element_fields
    from .splitting import split_long

    return split_long(element_fields(rows_of(spark, sf_dir, "elements", "elem_no", "type", "content", "context")), {"elem_no": "long", "field": "string"})


@query
def p3_found(spark, sf_dir):
    """Fields that came out in more than one piece."""
    return p3_pieces(spark, sf_dir).where("piece_no = 1").select("elem_no", "field").distinct()


SQL["p3_found"] = """
    SELECT DISTINCT elem_no, field FROM (
      SELECT elem_no, 'content' AS field, content AS text FROM elements WHERE type IS DISTINCT FROM 'image'
      UNION ALL SELECT elem_no, 'context', context FROM elements) WHERE length(text) > 2000"""


# --- 8: ids of a public tokenizer


@query
def p8_ids(spark, sf_dir):
    """doc_id and ids of every document by byte_bpe_50k, without special tokens."""
    from .token_ids import token_ids

    return token_ids(rows_of(spark, sf_dir, "documents", "doc_id", "text"))


# --- 9: mixing sources


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import cut
    from .mixing import mix
    from .token_ids import token_counts

    counts = cut(token_counts(rows_of(spark, sf_dir, "documents", "doc_id", "source", "text"), {"doc_id": "long", "source": "string"}))
    return mix(counts, read(spark, sf_dir, "mix_targets"))


@query
def p9_mix(spark, sf_dir):
    """The mix: each document taken, with its number of copies."""
    return _mix(spark, sf_dir)


@query
def p9_shares(spark, sf_dir):
    """Share reached by each source of mix_targets."""
    from .mixing import report

    return report(_mix(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


# --- 7: languages


def _language_trees(spark: SparkSession, sf_dir: str):
    from . import language as g

    rows = g.labelled_sample(read(spark, sf_dir, "documents"), "doc_id", "text", "lang", g.SAMPLE // 4)
    rows += g.labelled_sample(read(spark, sf_dir, "triples"), "triple_no", "context", "language")
    return spark.sparkContext.broadcast(g.train(rows))


def _triple_labels(spark, sf_dir, trees) -> DataFrame:
    from .language import label_texts

    rows = rows_of(spark, sf_dir, "triples", "triple_no", "language", "context").where("trim(context) <> ''").select("triple_no", F.col("language").alias("given"), F.col("context").alias("text"))
    return label_texts(rows, {"triple_no": "long", "given": "string"}, trees)


def _element_segments(spark, sf_dir, trees) -> DataFrame:
    from .language import segment_texts

    rows = rows_of(spark, sf_dir, "elements", "elem_no", "type", "content").where("NOT type <=> 'image'").select("elem_no", F.col("content").alias("text"))
    return segment_texts(rows, {"elem_no": "long"}, trees)


@query
def p7_triples(spark, sf_dir):
    """Language and confidence of every triple's context."""
    return _triple_labels(spark, sf_dir, _language_trees(spark, sf_dir))


@query
def p7_segments(spark, sf_dir):
    """Segments of every content in one language each, with a confidence."""
    return _element_segments(spark, sf_dir, _language_trees(spark, sf_dir))


@query
def p7_found(spark, sf_dir):
    """Triples with a missing or wrong language, and the languages of contents in several."""
    from .language import OTHER

    trees = _language_trees(spark, sf_dir)
    wrong = _triple_labels(spark, sf_dir, trees).where(f"lang <> '{OTHER}' AND NOT given <=> lang")
    parts = _element_segments(spark, sf_dir, trees).where(F.col("lang") != OTHER).groupBy("elem_no").agg(F.collect_set("lang").alias("langs"))
    mixed = parts.where("size(langs) > 1").select("elem_no", F.explode("langs").alias("lang"))
    return (
        wrong.select(F.lit("triple").alias("kind"), F.col("triple_no").alias("row_no"), "lang")
        .unionByName(mixed.select(F.lit("element").alias("kind"), F.col("elem_no").alias("row_no"), "lang"))
        .distinct()
    )


# --- 6: descriptions that don't answer


def _answer_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import answers as a
    from .language import labelled_sample

    rows = labelled_sample(read(spark, sf_dir, "documents"), "doc_id", "text", "lang", a.SAMPLE // 4)
    rows += labelled_sample(read(spark, sf_dir, "triples"), "triple_no", "context", "language", a.SAMPLE)
    models = a.train_languages(rows)
    pairs = rows_of(spark, sf_dir, "elements", "elem_no", "type", "content", "description").select(
        "elem_no", F.col("content").alias("prompt"), F.col("description").alias("response"), (~F.col("type").eqNullSafe("image")).alias("compare")
    )
    return a.defects(pairs, {"elem_no": "long"}, spark.sparkContext.broadcast(models))


@query
def p6_defects(spark, sf_dir):
    """Every element with the defect of its description, null where there is none."""
    return _answer_defects(spark, sf_dir)


@query
def p6_found(spark, sf_dir):
    """Defective pairs of content and description."""
    return _answer_defects(spark, sf_dir).where("defect IS NOT NULL").distinct()


# --- 10: abusive, hateful and sexual language


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as t

    rows = read(spark, sf_dir, "review_samples").where("text IS NOT NULL").orderBy("sample_no").limit(t.LABELLED).select("text", "label").collect()
    chain = spark.sparkContext.broadcast(t.Chain([(r[0], r[1]) for r in rows]))
    return t.scores(rows_of(spark, sf_dir, "documents", "doc_id", "source", "text"), {"doc_id": "long", "source": "string"}, chain)


@query
def p10_found(spark, sf_dir):
    """Documents with abusive, hateful or sexual language, one row for each category."""
    from .toxicity import AT_LEAST

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in ("abusive", "hateful", "sexual"))))
    return _toxicity(spark, sf_dir).select("doc_id", pairs.alias("p")).where(F.col("p.score") >= AT_LEAST).select("doc_id", "p.category").distinct()


@query
def p10_scores(spark, sf_dir):
    """Scores of every document."""
    return _toxicity(spark, sf_dir)


@query
def p10_rates(spark, sf_dir):
    """Rates of every source."""
    from .toxicity import rates

    return rates(_toxicity(spark, sf_dir))


# --- 4: variant spellings of names


@query
def p4_links(spark, sf_dir):
    """Distinct variants with the entity they mean and the cosine to its registered name."""
    from .names import link_names, names_of

    return link_names(names_of(read(spark, sf_dir, "triples")), read(spark, sf_dir, "entity_ref"))


@query
def p4_found(spark, sf_dir):
    """Heads and tails that mean a registered entity under another spelling."""
    from .names import names_of

    return names_of(read(spark, sf_dir, "triples")).join(p4_links(spark, sf_dir), "name").select("triple_no", "side", "entity_no").distinct()


# --- 5: near-duplicate contents and descriptions


def _near_duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .near_dups import similar_pairs

    one = F.struct(F.lit("content").alias("field"), F.when(~F.col("type").eqNullSafe("image"), F.col("content")).alias("text"))
    two = F.struct(F.lit("description").alias("field"), F.col("description").alias("text"))
    rows = rows_of(spark, sf_dir, "elements", "elem_no", "id", "type", "content", "description").select("elem_no", "id", F.explode(F.array(one, two)).alias("f"))
    return similar_pairs(rows.select("elem_no", "id", "f.field", "f.text").where("text IS NOT NULL"))


@query
def p5_found(spark, sf_dir):
    """Pairs of contents, or of descriptions, that are alike by one half at least."""
    from .near_dups import all_pairs

    return all_pairs(*_near_duplicates(spark, sf_dir)).distinct()


@query
def p5_classes(spark, sf_dir):
    """Every text long enough with the representative of its equals and that one's number of near-duplicates."""
    pairs, members = _near_duplicates(spark, sf_dir)
    links = pairs.select("field", F.explode(F.array("a", "b")).alias("rep")).groupBy("field", "rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, ["field", "rep"], "left").select("field", "elem_no", F.col("rep").alias("class_no"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _p5_sets() -> str:
    return r"""
    WITH rows_ AS (
      SELECT min(elem_no) AS elem_no, arg_min(type, elem_no) AS type, arg_min(content, elem_no) AS content, arg_min(description, elem_no) AS description
      FROM elements GROUP BY coalesce(id, 'row ' || elem_no)
    ), texts AS (
      SELECT elem_no, 'content' AS field, content AS text FROM rows_ WHERE type IS DISTINCT FROM 'image'
      UNION ALL SELECT elem_no, 'description', description FROM rows_
    ), spoken AS (
      SELECT elem_no, field, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL
    ), sets AS (
      SELECT elem_no, field, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM spoken WHERE len(w) >= 25
    ), run AS (
      SELECT elem_no, field, len(runs) AS n, unnest(runs) AS r FROM sets
    ), pairs AS (
      SELECT x.field, x.elem_no AS a, y.elem_no AS b FROM run x JOIN run y ON x.field = y.field AND x.r = y.r AND x.elem_no < y.elem_no
      GROUP BY x.field, x.elem_no, y.elem_no HAVING 2 * count(*) >= max(x.n) + max(y.n) - count(*)
    )"""


SQL["p5_found"] = _p5_sets() + " SELECT field, a AS elem_a, b AS elem_b FROM pairs"
SQL["p5_classes"] = _p5_sets() + """, classes AS (
      SELECT elem_no, field, min(elem_no) OVER (PARTITION BY field, list_sort(runs)) AS class_no FROM sets
    ), links AS (
      SELECT field, class_no, count(*) AS n FROM (
        SELECT p.field, p.a AS class_no FROM pairs p JOIN classes x ON x.field = p.field AND x.elem_no = p.a AND x.class_no = p.a JOIN classes y ON y.field = p.field AND y.elem_no = p.b AND y.class_no = p.b
        UNION ALL SELECT p.field, p.b FROM pairs p JOIN classes x ON x.field = p.field AND x.elem_no = p.a AND x.class_no = p.a JOIN classes y ON y.field = p.field AND y.elem_no = p.b AND y.class_no = p.b
      ) GROUP BY ALL)
    SELECT c.field, c.elem_no, c.class_no, coalesce(l.n, 0) AS n_links FROM classes c LEFT JOIN links l ON l.field = c.field AND l.class_no = c.class_no"""


# --- 1: text from scanned pages


@query
def p1_repaired(spark, sf_dir):
    """Contents and contexts as continuous paragraphs, with the damages they had."""
    from .common import element_fields
    from .scan_repair import repaired

    elements = rows_of(spark, sf_dir, "elements", "elem_no", "type", "content", "context", "metadata").withColumn("file", F.get_json_object("metadata", "$.filename"))
    return repaired(element_fields(elements, "file"), {"elem_no": "long", "field": "string"})


@query
def p1_found(spark, sf_dir):
    """Damages of contents and contexts that scanning does."""
    from .scan_repair import DAMAGES

    return p1_repaired(spark, sf_dir).select("elem_no", "field", F.explode("damages").alias("damage")).where(F.col("damage").isin(*DAMAGES)).distinct()
