"""Model hooks.  Each is a batch function that callers may replace; the defaults need no network and always answer alike."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Generate = Callable[[list[str], list[list[str]]], list[str | None]]
DIMENSIONS = 64


def hashing_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of signed word counts by hash, in one pass over the words.  Null and wordless texts have the zero vector."""

    def embed(texts: pd.Series) -> pd.Series:
        import re

        import numpy as np
        import xxhash

        word, known, out = re.compile(r"[^\W_]+"), {}, []
        for t in texts:
            v = np.zeros(dimensions)
            for w in word.findall((t or "").lower()):
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                v[h % dimensions] += 1.0 if (h >> 32) % 2 == 0 else -1.0
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(embed, "array<float>")(text)


def leading_sentences(text: Column, n: int = 2) -> Column:
    """Extractive default of a summary: the first sentences of a text."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n), " ")


def generate(df: DataFrame, out: str, parts: list[str], model: Generate | None = None, system: str = "", concurrency: int | None = None) -> DataFrame:
    """df with the model's answer to the text columns `parts` in column `out`, and the error in `out`_error.

    A failed batch is retried row by row, and a failed row keeps its error instead of ending the job.
    concurrency is the number of calls that a task has open at a time; rows stay where they are.
    Without a model the answer is the leading sentences of the last non-null part.
    """
    if model is None:
        return df.withColumn(out, leading_sentences(F.coalesce(*(F.col(p) for p in reversed(parts))))).withColumn(f"{out}_error", F.lit(None).cast("string"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def ask(asked):
        try:
            return [(a, None) for a in model([system] * len(asked), asked)]
        except Exception:  # noqa: BLE001
            got = []
            for a in asked:
                try:
                    got.append((model([system], [a])[0], None))
                except Exception as e:  # noqa: BLE001
                    got.append((None, str(e)[:500]))
            return got

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        many = max(1, concurrency or 1)
        for b in batches:
            asked = [[str(x) for x in row if x is not None] for row in b[parts].itertuples(index=False)]
            size = max(1, -(-len(asked) // many))
            with ThreadPoolExecutor(many) as pool:
                got = [g for part in pool.map(ask, [asked[i : i + size] for i in range(0, len(asked), size)]) for g in part]
            answers, errors = [a for a, _ in got], [e for _, e in got]
            yield b.assign(**{out: pd.Series(answers, index=b.index, dtype=object), f"{out}_error": pd.Series(errors, index=b.index, dtype=object)})

    return df.mapInPandas(run, schema)
