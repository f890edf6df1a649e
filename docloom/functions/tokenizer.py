"""Tokens of a public tokenizer, for budgets, crops and chunks: the path of its file is a parameter.

Files of the `tokenizers` library (.json) are read; nothing needs a network.  Null texts have no tokens.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def load(path: str):
    """The tokenizer of a file, once a process; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def counter(path: str):
    """A function from a text to its number of tokens, for pack_chunks."""
    return lambda text: len(load(path).encode(text, add_special_tokens=False).ids)


def count(text: Column, path: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e.ids) for e in load(path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def encode(text: Column, path: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in load(path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return F.pandas_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else load(path).decode(list(map(int, r)), skip_special_tokens=False) for r in rows])

    return F.pandas_udf(run, "string")(ids)


def central_crop(text: Column, budget: int, path: str) -> Column:
    """The text of the middle `budget` tokens; unchanged where there are no more."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ids = load(path).encode(t, add_special_tokens=False).ids if t is not None else []
            at = (len(ids) - budget) // 2
            out.append(t if at <= 0 and len(ids) <= budget else load(path).decode(ids[at : at + budget], skip_special_tokens=False))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text)
