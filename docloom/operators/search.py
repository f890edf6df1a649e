"""Vector search: exact top-k for any number of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries broadcast at once; more are searched in blocks.
BLOCK = 2_000


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 4, metric: str = "l2", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(qid, key, score, rank) of the k nearest vectors of each query (qid, qvec); ties go to the smaller key.

    metric is l2 (squared distance), dot or cosine.  A stated set of queries is broadcast, `block` at a time, as one
    matrix; each batch of vectors is multiplied with it, and each partition keeps k rows a query before
    the shuffle.  Null vectors, and those of another length than the query's, are no hits; a
    vector of zeros has cosine 0.
    """
    if metric not in ("l2", "dot", "cosine"):
        raise ValueError("metric must be l2, dot or cosine")
    spark, n = vectors.sparkSession, queries.count()
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)[key]
    blocks, out = -(-n // block), None
    for i in range(max(1, blocks)):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else queries
        asked = part.where("qvec IS NOT NULL").select("qid", "qvec").collect()
        best = vectors.where("embedding IS NOT NULL").select(key, "embedding").mapInArrow(_nearest(spark.sparkContext.broadcast([(r[0], list(r[1])) for r in asked]), k, metric), f"qid {kinds[0]}, `{key}` {kinds[1]}, score double")
        out = best if out is None else out.unionByName(best)
    order = F.col("score") if metric == "l2" else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, key)).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(asked, k: int, metric: str):
    """A function over batches (key, embedding) that yields (qid, key, score) of the k best of each query met."""

    def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        if metric == "l2":
            return ((v - q) ** 2).sum(axis=1)
        dots = (v * q).sum(axis=1)
        if metric == "cosine":
            norms = np.sqrt((v * v).sum(axis=1) * (q * q).sum())
            dots = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        return dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[int]] = {}
        for i, (_, q) in enumerate(asked.value):
            by_size.setdefault(len(q), []).append(i)
        matrices = {d: np.array([asked.value[i][1] for i in own], float) for d, own in by_size.items()}
        sign = 1.0 if metric == "l2" else -1.0
        best: dict[int, list[tuple[float, object]]] = {}
        schema = None
        for b in batches:
            keys, lists = b.column(0), b.column(1)
            schema = schema or keys.type
            sizes = np.diff(lists.offsets.to_numpy())
            for d, own in by_size.items():
                rows = np.flatnonzero(sizes == d)
                if not len(rows) or not d:
                    continue
                v = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                q = matrices[d]
                near = q @ v.T
                if metric == "l2":
                    near = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None] - 2 * near
                elif metric == "cosine":
                    near = -near / np.maximum(np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None], 1e-300)
                else:
                    near = -near
                at = min(k, len(rows)) - 1
                limit = np.partition(near, at, axis=1)[:, at]
                slack = 1e-6 * np.maximum(1.0, np.abs(limit))
                for j, i in enumerate(own):
                    close = np.flatnonzero(near[j] <= limit[j] + slack[j])
                    scores = np.round(exact(q[j], v[close]), 9) * sign
                    mine = [(s, keys[int(rows[c])].as_py()) for s, c in zip(scores.tolist(), close) if not np.isnan(s)]
                    best[i] = sorted(best.get(i, []) + mine)[:k]
        rows_ = [(asked.value[i][0], key, s * sign) for i, own in best.items() for s, key in own]
        if rows_:
            qids, ids, scores = zip(*rows_)
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids, schema), pa.array(scores, pa.float64())], names=["qid", "key", "score"])

    return run


def parents(hits: DataFrame, store: DataFrame, key: str = "doc_id", store_key: str = "id") -> DataFrame:
    """Records of the hits: each record once for a query, at its best rank; hits without a record are dropped."""
    best = hits.groupBy("qid", key).agg(F.min("rank").alias("rank"))
    return best.join(store, F.col(key) == F.col(store_key))
