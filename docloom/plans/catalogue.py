"""The catalogue of queries over the project's tables, and the SQL that checks them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, jsons, text
from ..operators import dedup, elements, graph, rag, search, store, triples
from ..session import checkpoint_dir, read
from ..sources import readers
from .pipelines import filename

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FILE = "coalesce(json_extract_string(metadata, '$.filename'), 'unknown')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_items").dropDuplicates(["filename", "seq"])


_ITEMS = "SELECT DISTINCT ON (filename, seq) filename, seq, self_ref, label, coalesce(text, '') AS text, prov FROM doc_items"

# --- ids and stores


@query(f"SELECT elem_no, sha256(coalesce(content, '') || '_' || {_FILE}) AS element_id FROM elements")
def element_ids(spark, d):
    return read(spark, d, "elements").select("elem_no", ids.element_id(F.col("content"), filename()).alias("element_id"))


@query("SELECT DISTINCT id FROM elements e WHERE NOT EXISTS (SELECT 1 FROM elements s WHERE s.elem_no % 2 = 0 AND s.id = e.id)")
def id_insert_new(spark, d):
    e = read(spark, d, "elements")
    return store.new_rows(e, e.where("elem_no % 2 = 0")).select("id")


@query("SELECT id, count(*) AS n FROM elements GROUP BY id HAVING count(*) > 1")
def id_batch_dups(spark, d):
    return read(spark, d, "elements").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT id, max(elem_no) AS elem_no FROM elements GROUP BY id")
def last_delivery(spark, d):
    e = read(spark, d, "elements")
    return store.new_rows(e, e.limit(0), "elem_no").select("id", "elem_no")


@query("SELECT id FROM elements")
def key_scan(spark, d):
    return readers.store_keys(read(spark, d, "elements"))


@query("""SELECT v.id, e.type FROM (SELECT DISTINCT doc_id AS id FROM vector_rows WHERE doc_id IS NOT NULL) v LEFT JOIN (SELECT id, max(elem_no) AS elem_no, arg_max(type, elem_no) AS type FROM elements WHERE type IS NOT NULL GROUP BY id) e ON e.id = v.id""")
def multi_get(spark, d):
    keys = read(spark, d, "vector_rows").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    e = read(spark, d, "elements").where("type IS NOT NULL").groupBy("id").agg(F.max_by("type", "elem_no").alias("type"))
    return readers.multi_get(keys, e)


@query("SELECT type, count(*) AS n FROM (SELECT 'text' AS type FROM documents UNION ALL SELECT 'table' FROM nation UNION ALL SELECT 'image' FROM embeddings) GROUP BY type")
def type_union(spark, d):
    one = lambda t, c: read(spark, d, t).select(F.col(c).cast("string").alias("content"))
    return store.union_types(text=one("documents", "text"), table=one("nation", "n_name"), image=one("embeddings", "vec_id")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'element without vector' AS what, count(*) AS n FROM (SELECT DISTINCT id FROM elements) e WHERE NOT EXISTS (SELECT 1 FROM vector_rows v WHERE v.doc_id = e.id)
    UNION ALL SELECT 'vector without element', count(*) FROM (SELECT DISTINCT doc_id FROM vector_rows) v WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.id = v.doc_id)""")
def store_orphans(spark, d):
    e, v = read(spark, d, "elements").select("id").distinct(), read(spark, d, "vector_rows").select(F.col("doc_id").alias("id")).distinct()
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(e.join(v, "id", "left_anti"), "element without vector").unionByName(n(v.join(e, "id", "left_anti"), "vector without element"))


@query(f"SELECT elem_no, id, type, {_FILE} AS filename, CAST(coalesce(len(json_extract(metadata, '$.pages')::BIGINT[]), -1) AS BIGINT) AS n_pages FROM elements")
def record_roundtrip(spark, d):
    from ..schemas import METADATA

    e = read(spark, d, "elements").withColumn("metadata", F.from_json("metadata", METADATA))
    back = e.select("elem_no", jsons.unwrap_record(jsons.wrap_record()).alias("r"))
    return back.select("elem_no", "r.id", "r.type", F.coalesce("r.metadata.filename", F.lit("unknown")).alias("filename"), F.size("r.metadata.pages").cast("long").alias("n_pages"))


@query("""SELECT raw_no, CASE WHEN json_valid(payload) THEN 'object' ELSE 'text' END AS kind,
    CASE WHEN json_valid(payload) THEN coalesce(json_extract_string(payload, '$.head'), '') ELSE payload END AS content FROM raw_relations""")
def json_fallback(spark, d):
    p = F.col("payload")
    known = jsons.is_object(p)
    head = F.coalesce(F.get_json_object(p, "$.head"), F.lit(""))
    return read(spark, d, "raw_relations").select("raw_no", F.when(known, "object").otherwise("text").alias("kind"), F.when(known, head).otherwise(p).alias("content"))


@query("SELECT filename, seq, count(*) AS n, count(prov) AS with_prov FROM doc_items GROUP BY filename, seq")
def flatten_meta(spark, d):
    flat = jsons.flatten_nested(read(spark, d, "doc_items"))
    return flat.groupBy("filename", "seq").agg(F.count(F.lit(1)).alias("n"), F.count("prov").alias("with_prov"))


@query("""SELECT e.elem_no, coalesce(v.page_content, '') AS page_content, coalesce(e.type, 'unknown') AS type FROM elements e
    LEFT JOIN (SELECT doc_id, max(page_content) AS page_content FROM vector_rows GROUP BY doc_id) v ON v.doc_id = e.id""")
def default_fill(spark, d):
    v = read(spark, d, "vector_rows").groupBy(F.col("doc_id").alias("id")).agg(F.max("page_content").alias("page_content"))
    e = read(spark, d, "elements").select("elem_no", "id", "type").join(v, "id", "left")
    return readers.columns_or(e, page_content=F.lit(""), type=F.lit("unknown")).select("elem_no", "page_content", "type")


# --- items, metadata, context


@query("SELECT doc_id, CAST(len(regexp_split_to_array(text, '\\r?\\n')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def text_lines(spark, d):
    return readers.text_items(read(spark, d, "documents"), "doc_id").groupBy(F.col("filename").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT filename, seq, label FROM doc_items WHERE lower(label) IN ('table', 'picture')")
def label_filter(spark, d):
    i = read(spark, d, "doc_items")
    return elements.with_label(i, "table").unionByName(elements.with_label(i, "picture")).select("filename", "seq", "label")


@query("SELECT filename, min(seq) AS seq FROM doc_items WHERE lower(label) = 'table' GROUP BY filename")
def find_first_item(spark, d):
    return elements.first_item(read(spark, d, "doc_items"), F.lower("label") == "table").select("filename", "seq")


@query(f"""SELECT i.filename, i.seq, coalesce((SELECT string_agg(DISTINCT CAST(p.page AS VARCHAR), ',' ORDER BY CAST(p.page AS VARCHAR)) FROM unnest(i.prov) AS u(p)), '') AS pages,
    CAST(coalesce(len(i.prov), 0) AS BIGINT) AS n_boxes FROM ({_ITEMS}) i""")
def metadata_pages(spark, d):
    m = elements.metadata(F.col("filename"), F.col("prov"))
    rows = _items(spark, d).select("filename", "seq", m.alias("m"))
    pages = F.array_join(F.array_sort(F.transform("m.pages", lambda p: p.cast("string"))), ",")
    return rows.select("filename", "seq", pages.alias("pages"), F.size("m.bboxes").cast("long").alias("n_boxes"))


_SPANS = f"""it AS ({_ITEMS}), tk AS (SELECT *, len(string_split(text, ' ')) AS tok FROM it),
    c AS (SELECT *, sum(tok) OVER (PARTITION BY filename ORDER BY seq) AS cum FROM tk),
    tg AS (SELECT filename, seq AS tseq, tok AS ttok, cum AS tcum, 256 - tok AS rem, (256 - tok) // 2 AS half FROM c WHERE lower(label) IN ('table', 'picture') AND tok < 256),
    prv AS (SELECT tg.filename, tseq, coalesce(sum(c.tok), 0) AS pt, count(c.seq) AS pn FROM tg LEFT JOIN c ON c.filename = tg.filename AND c.seq < tseq
      AND (tcum - ttok) - (c.cum - c.tok) <= half AND (tcum - ttok) - c.cum < half GROUP BY ALL),
    t2 AS (SELECT tg.*, pt, pn FROM tg JOIN prv USING (filename, tseq)),
    nxt AS (SELECT t2.filename, tseq, ttok, pn, pt, count(c.seq) AS nn, coalesce(sum(c.tok), 0) AS nt FROM t2 LEFT JOIN c ON c.filename = t2.filename AND c.seq > tseq
      AND c.cum - tcum <= rem - pt AND (c.cum - c.tok - tcum) + pt < rem GROUP BY ALL)"""


def _context(spark, d) -> DataFrame:
    return elements.context(_items(spark, d), F.lower("label").isin("table", "picture"), 256)


@query(f"""WITH {_SPANS} SELECT filename, tseq AS seq, CAST(ttok AS BIGINT) AS tok, CAST(pn AS BIGINT) AS prev_n, CAST(pt AS BIGINT) AS prev_tokens, CAST(nn AS BIGINT) AS next_n, CAST(nt AS BIGINT) AS next_tokens FROM nxt
    UNION ALL SELECT filename, seq, tok, 0, 0, 0, 0 FROM c WHERE lower(label) IN ('table', 'picture') AND tok >= 256""")
def context_window(spark, d):
    return _context(spark, d).drop("context")


@query(f"""WITH {_SPANS}, pos AS (SELECT filename, seq, text, row_number() OVER (PARTITION BY filename ORDER BY seq) AS p FROM it),
    sp AS (SELECT nxt.*, pos.p AS tp FROM nxt JOIN pos ON pos.filename = nxt.filename AND pos.seq = tseq)
    SELECT sp.filename, tseq AS seq, regexp_replace(regexp_replace(
      coalesce(string_agg(text, chr(10) ORDER BY p) FILTER (p < tp) || chr(10), '') || chr(10) || max(text) FILTER (p = tp) || chr(10) || coalesce(chr(10) || string_agg(text, chr(10) ORDER BY p) FILTER (p > tp), ''),
      '^\\s+', ''), '\\s+$', '') AS context
    FROM sp JOIN pos ON pos.filename = sp.filename AND p BETWEEN tp - pn AND tp + nn GROUP BY sp.filename, tseq
    UNION ALL SELECT filename, seq, array_to_string(list_slice(string_split(text, ' '), (tok - 256) // 2 + 1, (tok - 256) // 2 + 256), ' ') FROM c WHERE lower(label) IN ('table', 'picture') AND tok >= 256""")
def context_text(spark, d):
    return _context(spark, d).select("filename", "seq", "context")


@query(r"""WITH i AS (SELECT doc_id, text, len(string_split(text, ' ')) AS tok FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, tok, CASE WHEN tok < 32 THEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') ELSE array_to_string(list_slice(string_split(text, ' '), (tok - 32) // 2 + 1, (tok - 32) // 2 + 32), ' ') END AS context FROM i""")
def context_oversize(spark, d):
    """Documents as targets that stand alone: those of 32 tokens or more are cut to their middle."""
    i = read(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("filename"), F.lit(0).alias("seq"), "text")
    return elements.context(i, F.lit(True), 32).select(F.col("filename").alias("doc_id"), "tok", "context")


@query("""SELECT doc_id, CASE WHEN len(string_split(text, ' ')) > 128 THEN array_to_string(list_slice(string_split(text, ' '), (len(string_split(text, ' ')) - 64) // 2 + 1, (len(string_split(text, ' ')) - 64) // 2 + 64), ' ') ELSE text END AS crop FROM documents""")
def central_crop(spark, d):
    return read(spark, d, "documents").select("doc_id", text.central_crop(F.col("text"), 64, 128).alias("crop"))


@query(f"""WITH RECURSIVE n AS (SELECT filename, CAST(seq AS BIGINT) AS seq, text, len(string_split(text, ' ')) AS tok, row_number() OVER (PARTITION BY filename ORDER BY seq) AS p FROM ({_ITEMS})),
    w AS (SELECT filename, p, seq, text, tok, CAST(0 AS BIGINT) AS chunk_no, CAST(tok AS BIGINT) AS used FROM n WHERE p = 1
      UNION ALL SELECT n.filename, n.p, n.seq, n.text, n.tok, CASE WHEN w.used + n.tok > 128 THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.used + n.tok > 128 THEN n.tok ELSE w.used + n.tok END FROM w JOIN n ON n.filename = w.filename AND n.p = w.p + 1)
    SELECT filename, chunk_no, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(tok) AS BIGINT) AS n_tokens, string_agg(text, chr(10) ORDER BY p) AS text FROM w GROUP BY filename, chunk_no""")
def chunk_pack(spark, d):
    return elements.pack_chunks(_items(spark, d), 128)


# --- near-duplicates


def _hashes(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", ids.sign_hash(F.col("embedding")).alias("h"))


_BITS = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"


@query(f"""WITH e AS (SELECT vec_id, label, {_BITS} AS h FROM embeddings)
    SELECT a.label, a.vec_id AS a, b.vec_id AS b, CAST(hamming(a.h, b.h) AS BIGINT) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND hamming(a.h, b.h) <= 20""")
def hash_hamming_pairs(spark, d):
    return dedup.hamming_pairs(_hashes(spark, d), "label", "vec_id", "h", 20)


@query(f"""WITH e AS (SELECT vec_id, label, {_BITS} AS h FROM embeddings)
    SELECT a.label, a.vec_id AS a, b.vec_id AS b, CAST(hamming(a.h, b.h) AS BIGINT) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND hamming(a.h, b.h) <= 11""")
def hash_hamming_near(spark, d):
    return dedup.hamming_pairs(_hashes(spark, d), "label", "vec_id", "h", 11)


@query(f"""WITH e AS (SELECT label, list({{'id': vec_id, 'h': {_BITS}}} ORDER BY vec_id) AS l FROM embeddings GROUP BY label),
    k AS (SELECT label, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: hamming(y.h, x.h) <= 24)) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(id BIGINT, h VARCHAR)[]) AS kept FROM e)
    SELECT label, u.id AS vec_id FROM (SELECT label, unnest(kept) AS u FROM k)""")
def greedy_dedup(spark, d):
    return dedup.greedy_hamming(_hashes(spark, d), "label", "vec_id", "h", 24).select("label", "vec_id")


@query(f"""WITH e AS (SELECT label, list({{'id': vec_id, 'h': {_BITS}}} ORDER BY vec_id) AS l FROM embeddings GROUP BY label),
    k AS (SELECT label, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: hamming(y.h, x.h) <= 11)) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(id BIGINT, h VARCHAR)[]) AS kept FROM e)
    SELECT label, u.id AS vec_id FROM (SELECT label, unnest(kept) AS u FROM k)""")
def greedy_dedup_near(spark, d):
    return dedup.greedy_near(_hashes(spark, d), "label", "vec_id", "h", 11).select("label", "vec_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND k.text = d.text)")
def dedup_semi(spark, d):
    docs = read(spark, d, "documents")
    return dedup.keep_by_content(docs, docs.where("doc_id % 2 = 0"), "text").select("doc_id")


# --- retrieval

_QUESTIONS = "SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0"
_TOP = f"""hits AS (SELECT qid, doc_id, score, rank FROM (SELECT qid, v.vec_id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: (q[i] - v.embedding[i]::DOUBLE) * (q[i] - v.embedding[i]::DOUBLE))), 6) AS score,
    row_number() OVER (PARTITION BY qid ORDER BY round(list_sum(list_transform(range(1, 65), lambda i: (q[i] - v.embedding[i]::DOUBLE) * (q[i] - v.embedding[i]::DOUBLE))), 9), v.vec_id) AS rank
    FROM ({_QUESTIONS}) CROSS JOIN embeddings v) WHERE rank <= 4)"""


def _hits(spark, d, metric="l2") -> DataFrame:
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return search.top_k(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), 4, metric)


@query(f"WITH {_TOP} SELECT qid, doc_id, score, rank FROM hits")
def vector_topk(spark, d):
    return _hits(spark, d).withColumn("score", F.round("score", 6))


@query(f"""SELECT qid, doc_id, score, rank FROM (SELECT qid, v.vec_id AS doc_id, round(list_dot_product(q, v.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(q, v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM ({_QUESTIONS}) CROSS JOIN embeddings v) WHERE rank <= 4""")
def vector_cosine_topk(spark, d):
    return _hits(spark, d, "dot").withColumn("score", F.round("score", 6))


def _records(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.struct(F.col("text").alias("content"), "type")).alias("value"))
    return search.parents(_hits(spark, d), docs)


@query(f"WITH {_TOP} SELECT qid, hits.doc_id, rank, type FROM hits JOIN documents USING (doc_id)")
def retrieve_parents(spark, d):
    return rag.route(_records(spark, d).withColumn("rank", F.struct("rank", "doc_id"))).select("qid", F.col("rank.doc_id").alias("doc_id"), F.col("rank.rank").alias("rank"), "type")


@query(f"WITH {_TOP} SELECT qid, count(*) FILTER (type = 'image') AS n_images, count(*) FILTER (type <> 'image') AS n_texts FROM hits JOIN documents USING (doc_id) GROUP BY qid")
def route_modalities(spark, d):
    m = rag.modalities(rag.route(_records(spark, d)))
    return m.select("qid", F.size("images").cast("long").alias("n_images"), F.size("texts").cast("long").alias("n_texts"))


@query(f"""WITH {_TOP}, t AS (SELECT qid, coalesce(text, '') AS text, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS i FROM hits JOIN documents USING (doc_id) WHERE type <> 'image')
    SELECT q.qid, 'Context:' || chr(10) || coalesce(string_agg('[Source ' || i || ']: ' || t.text, chr(10) || chr(10) ORDER BY i), '') || chr(10) || chr(10) || 'Question: What is near vector ' || q.qid || '?' AS prompt
    FROM ({_QUESTIONS}) q LEFT JOIN t USING (qid) GROUP BY q.qid""")
def rag_prompt(spark, d):
    found = rag.modalities(rag.route(_records(spark, d)))
    questions = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.concat(F.lit("What is near vector "), "vec_id", F.lit("?")).alias("question"))
    return rag.prompts(questions, found).select("qid", "prompt")


@query(f"""WITH {_TOP}, g AS (SELECT h.qid, c.type AS item, 1.0 * count(*) / 4 AS score FROM hits h JOIN documents c USING (doc_id) GROUP BY ALL),
    b AS (SELECT qid, 'local' AS kind, CAST(doc_id AS VARCHAR) AS item, round(1.0 / (1.0 + score), 5) AS score FROM hits UNION ALL SELECT qid, 'global', item, round(score, 5) FROM g)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, item) AS rank FROM b) WHERE rank <= 5""")
def hybrid_retrieval(spark, d):
    hits = _hits(spark, d).withColumn("score", F.round("score", 6))
    local = hits.select("qid", F.col("doc_id").cast("string").alias("item"), F.round(1.0 / (1.0 + F.col("score")), 5).alias("score"))
    types = hits.join(read(spark, d, "documents").select("doc_id", "type"), "doc_id").groupBy("qid", F.col("type").alias("item")).agg(F.round(F.count(F.lit(1)) / 4, 5).alias("score"))
    return graph.hybrid(local, types, 5)


# --- tables and triples


@query("SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS row FROM nation")
def table_markdown(spark, d):
    return read(spark, d, "nation").select("n_nationkey", text.markdown_row([F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")]).alias("row"))


@query("""SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def table_text(spark, d):
    return text.markdown_table(read(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_regionkey"], "n_nationkey")


@query("""SELECT head, upper(relation) AS relation, tail FROM (UNPIVOT (SELECT p_name AS head, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part) ON p_brand, p_type, p_size INTO NAME relation VALUE tail) WHERE tail <> ''""")
def table_triples(spark, d):
    return triples.table_triples(read(spark, d, "part"), "p_name", ["p_brand", "p_type", "p_size"]).select("head", "relation", "tail")


@query(r"""WITH l AS (SELECT elem_no, list_filter(regexp_split_to_array(content, '\r?\n'), lambda x: starts_with(trim(x), '|')) AS lines FROM elements WHERE type = 'table'),
    c AS (SELECT elem_no, list_filter(list_transform(lines, lambda x: list_transform(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|'), lambda y: trim(y))), lambda r: len(list_filter(r, lambda y: NOT regexp_full_match(y, ':?-{2,}:?'))) > 0) AS rows FROM l),
    b AS (SELECT elem_no, rows[1] AS header, i - 1 AS row_no, rows[i + 1] AS row FROM c, unnest(range(1, len(rows))) AS u(i)),
    t AS (SELECT elem_no, row_no, row[1] AS head, upper(regexp_replace(regexp_replace(header[j], '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')) AS relation, row[j] AS tail FROM b, unnest(range(2, greatest(len(header), len(row)) + 1)) AS u(j))
    SELECT * FROM t WHERE coalesce(lower(head), '') NOT IN ('', '-', 'n/a', 'na', 'null', 'none') AND coalesce(lower(tail), '') NOT IN ('', '-', 'n/a', 'na', 'null', 'none') AND relation <> ''""")
def markdown_triples(spark, d):
    return triples.markdown_triples(read(spark, d, "elements").where("type = 'table'"), "elem_no")


@query("""SELECT triple_no, CASE WHEN coalesce(trim(head), '') = '' THEN 'no head' WHEN coalesce(trim(relation), '') = '' THEN 'no relation' WHEN coalesce(trim(tail), '') = '' THEN 'no tail'
    WHEN confidence IS NULL OR isnan(confidence) THEN 'no confidence' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' END AS reason FROM triples""")
def triple_filter(spark, d):
    return read(spark, d, "triples").select("triple_no", triples.validity().alias("reason"))


@query("SELECT elem_no, CASE WHEN content IS NULL THEN 'no content' WHEN type IS NULL THEN 'no type' WHEN type NOT IN ('text', 'table', 'image') THEN 'unknown type' END AS reason FROM elements")
def extraction_routes(spark, d):
    return triples.extraction_plan(read(spark, d, "elements")).select("elem_no", "reason")


@query("""SELECT triple_no, CASE WHEN b IN ('eng', 'fra', 'deu', 'spa', 'ita', 'por') THEN b WHEN b = 'en' THEN 'eng' WHEN b = 'fr' THEN 'fra' WHEN b = 'de' THEN 'deu' WHEN b = 'es' THEN 'spa' WHEN b = 'it' THEN 'ita' WHEN b = 'pt' THEN 'por' END AS code
    FROM (SELECT triple_no, lower(regexp_extract(trim(language), '^([A-Za-z]{2,3})(?:[-_][A-Za-z]{2,4})?$', 1)) AS b FROM triples)""")
def language_codes(spark, d):
    return read(spark, d, "triples").select("triple_no", triples.language_code(F.col("language")).alias("code"))


@query("SELECT doc_id, count(*) AS n, round(avg(confidence), 6) AS confidence FROM triples WHERE doc_id IS NOT NULL GROUP BY doc_id")
def triples_by_document(spark, d):
    c = triples.collect_triples(read(spark, d, "triples").where("doc_id IS NOT NULL"))
    e = triples.explode_triples(c.withColumnRenamed("doc_id", "id"))
    return e.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(r"""WITH b AS (SELECT triple_no, regexp_replace(regexp_replace(head, '\\s+', ' ', 'g'), '^[\\s"''(\\[«“]+|[\\s"'')\\]»”.,;]+$', '', 'g') AS bare FROM triples)
    SELECT triple_no, CASE WHEN upper(bare) = bare AND regexp_matches(bare, '\\p{L}{4}') THEN array_to_string(list_transform(regexp_extract_all(bare, '\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE bare END AS entity FROM b""".replace("\\\\", "\\"))
def entity_forms(spark, d):
    return read(spark, d, "triples").select("triple_no", triples.normal_entity(F.col("head")).alias("entity"))


# --- graph

_T = "(SELECT * FROM triples WHERE head IS NOT NULL AND tail IS NOT NULL AND relation IS NOT NULL)"
_ENDS = f"(SELECT head AS node, head_type AS type, doc_id FROM {_T} UNION ALL SELECT tail, tail_type, doc_id FROM {_T})"
_BOTH = f"(SELECT DISTINCT src, dst FROM (SELECT head AS src, tail AS dst FROM {_T} UNION ALL SELECT tail, head FROM {_T}) WHERE src <> dst)"


@query(f"SELECT node, 'Entity' AS label, arg_max(type, (CASE WHEN type IS NULL THEN 0 ELSE 1 END, n, -length(type), type)) AS type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT node, type, count(*) AS n FROM {_ENDS} GROUP BY ALL) GROUP BY node")
def kg_nodes(spark, d):
    return graph.nodes(read(spark, d, "triples"))


@query(f"SELECT head AS src, relation AS rel, tail AS dst, count(*) AS weight, max(confidence) AS confidence FROM {_T} GROUP BY ALL")
def kg_edges(spark, d):
    return graph.edges(read(spark, d, "triples"))


@query(f"SELECT DISTINCT doc_id, node FROM {_ENDS} WHERE doc_id IS NOT NULL")
def kg_mentions(spark, d):
    return graph.mentions(read(spark, d, "triples"))


@query(f"SELECT DISTINCT node, node AS name FROM {_ENDS}")
def kg_set_name(spark, d):
    return graph.set_property(graph.nodes(read(spark, d, "triples")), "name", F.col("node")).select("node", "name")


@query(f"SELECT head_type, relation, tail_type, count(*) AS n FROM {_T} GROUP BY ALL")
def kg_schema(spark, d):
    return graph.schema_summary(read(spark, d, "triples"))


@query("SELECT r_name AS n2, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def kg_match_2hop(spark, d):
    named = lambda t, s, rel, o: t.select(s.cast("string").alias("src"), F.lit(rel).alias("rel"), o.cast("string").alias("dst"))
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    e = named(c.join(n, c.c_nationkey == n.n_nationkey), F.col("c_custkey"), "LIVES_IN", F.col("n_name"))
    e = e.unionByName(named(n.join(r, n.n_regionkey == r.r_regionkey), F.col("n_name"), "PART_OF", F.col("r_name")))
    return graph.match(e, "LIVES_IN", "PART_OF").groupBy("n2").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src AS node, dst AS neighbour FROM {_BOTH} WHERE src IN (SELECT name FROM entity_ref)")
def kg_neighbors(spark, d):
    return graph.neighbours(graph.edges(read(spark, d, "triples")), read(spark, d, "entity_ref").select(F.col("name").alias("node")))


@query(f"""WITH deg AS (SELECT src AS node FROM {_BOTH} GROUP BY src HAVING count(*) >= 2) SELECT DISTINCT head AS src, relation AS rel, tail AS dst FROM {_T} WHERE head IN (SELECT node FROM deg) AND tail IN (SELECT node FROM deg)""")
def kg_degree_prune(spark, d):
    return graph.prune_leaves(graph.edges(read(spark, d, "triples"))).select("src", "rel", "dst")


@query(f"SELECT src AS node, count(*) AS degree FROM {_BOTH} GROUP BY src")
def kg_degrees(spark, d):
    return graph.degrees(graph.edges(read(spark, d, "triples")))


_KIND = "lower(regexp_replace({0}_type, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) IN ('person', 'org')"
_NAMED = " UNION ".join(f"SELECT {s} AS a FROM triples WHERE {_KIND.format(s)} AND length({s}) > 2" for s in ("head", "tail"))
_ORGS = f"({_NAMED})"
# that function counts bytes; here each letter beyond ASCII is one
_LETTERS = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÉÖÜ"
_EDITS = f"levenshtein(translate(x.a, '{_LETTERS}', {' || '.join(f'chr({i + 1})' for i in range(len(_LETTERS)))}), translate(y.a, '{_LETTERS}', {' || '.join(f'chr({i + 1})' for i in range(len(_LETTERS)))}))"


def _close_names(spark, d) -> DataFrame:
    """Near names among all heads and tails of persons and organisations, however their types are formatted."""
    t = read(spark, d, "triples")
    kind = lambda s: F.lower(F.regexp_replace(f"{s}_type", r"[^\p{L}\p{N}]+", "")).isin("person", "org")
    named = lambda s: t.where(kind(s)).select(F.col(s).alias("name"))
    return graph.resolve_names(named("head").unionByName(named("tail")), "name")


@query(f"SELECT x.a, y.a AS b, CAST({_EDITS} AS BIGINT) AS distance FROM {_ORGS} x JOIN {_ORGS} y ON x.a < y.a AND abs(length(x.a) - length(y.a)) <= 2 AND {_EDITS} <= 2")
def entity_resolution(spark, d):
    return _close_names(spark, d)


@query(f"""WITH RECURSIVE l AS (SELECT x.a, y.a AS b FROM {_ORGS} x JOIN {_ORGS} y ON x.a <> y.a AND abs(length(x.a) - length(y.a)) <= 2 AND {_EDITS} <= 2),
    r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a) SELECT node, min(other) AS component FROM r GROUP BY node""")
def name_components(spark, d):
    return graph.components(_close_names(spark, d))


def _labels(rounds: int) -> str:
    """Rounds of votes of the neighbours' labels and a node's own, ties to the smaller label."""
    steps = ["l0 AS (SELECT DISTINCT src AS node, src AS c FROM b)"]
    for i in range(rounds):
        votes = f"SELECT b.src AS node, l.c FROM b JOIN l{i} l ON l.node = b.dst UNION ALL SELECT node, c FROM l{i}"
        steps.append(f"l{i + 1} AS (SELECT node, arg_min(c, (-n, c)) AS c FROM (SELECT node, c, count(*) AS n FROM ({votes}) GROUP BY ALL) GROUP BY node)")
    return f"WITH b AS {_BOTH}, {', '.join(steps)} SELECT node, c AS community FROM l{rounds}"


@query(_labels(3))
def communities(spark, d):
    return graph.label_propagation(graph.edges(read(spark, d, "triples")), 3)


@query()
def community_summaries(spark, d):
    from .pipelines import summarise_communities

    return summarise_communities(graph.edges(read(spark, d, "triples")), 3)


@query()
def picture_hashes(spark, d):
    from ..functions import images

    return read(spark, d, "elements").where("type = 'image'").select("elem_no", images.perceptual_hash(F.col("content")).alias("hash"), F.length(images.from_base64(F.col("content"))).alias("n_bytes"))


@query("SELECT elem_no, CASE WHEN regexp_full_match(content, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') THEN CAST(octet_length(try(from_base64(content))) AS BIGINT) ELSE -1 END AS n_bytes FROM elements WHERE type = 'image'")
def picture_bytes(spark, d):
    from ..functions import images

    whole = F.col("content").rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return read(spark, d, "elements").where("type = 'image'").select("elem_no", F.when(whole, F.length(images.from_base64(F.col("content")))).otherwise(F.lit(-1)).cast("long").alias("n_bytes"))


# --- streaming


@query("SELECT type, count(DISTINCT sha256(coalesce(text, '') || '_' || coalesce(filename, 'unknown'))) AS n FROM documents GROUP BY type")
def stream_ingest(spark, d):
    from ..streaming.ingest import ingest, watch

    at = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    schema = read(spark, d, "documents").schema
    path = f"{d}/documents.parquet"
    folder, pattern = (path, None) if os.path.isdir(path) else (d, "documents.parquet")
    to = lambda b: b.select(F.col("text").alias("content"), "filename", F.lit("").alias("context"), F.lit("").alias("description"), "type", F.to_json(F.struct("filename")).alias("metadata"))
    ingest(watch(spark, folder, "parquet", schema, pattern), to, f"{at}/docs", f"{at}/vectors", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/docs").groupBy("type").agg(F.countDistinct("id").alias("n"))
