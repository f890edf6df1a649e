"""Column functions on text: stripping, tokens, centre crop, predicates, Markdown, data URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def tokens(c: Column) -> Column:
    """Space-separated tokens; the tokenizer used wherever no other is given."""
    return F.split(c, " ")


def token_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def central_crop(c: Column, budget: int, model_limit: int) -> Column:
    """The middle `budget` tokens; unchanged unless there are more than both limits."""
    t = tokens(c)
    n = F.size(t)
    start = F.floor((n - budget) / 2).cast("int") + 1
    return F.when((n > budget) & (n > model_limit), F.array_join(F.slice(t, F.greatest(start, F.lit(1)), F.lit(budget)), " ")).otherwise(c)


def screaming_snake(c: Column) -> Column:
    """Column header to predicate: `Revenue (Q1)` to `REVENUE_Q1`."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""))


def title_case(c: Column) -> Column:
    """Each run of letters with its first letter in upper case and the rest in lower case, also after signs."""
    return F.array_join(F.transform(F.split(c, r"(?<=[^\p{L}])(?=\p{L})"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))


def markdown_header(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n|" + "---|" * len(names)


def markdown_table(rows: DataFrame, columns: list[str], group: list[str], order: str) -> DataFrame:
    """(*group, markdown): a table for each group with a header, a separator and the rows in order.

    A table becomes one text, so a group is what one prompt can hold.
    """
    row = F.struct(F.col(order).alias("o"), markdown_row([F.col(c) for c in columns]).alias("r"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]), "\n")
    return rows.groupBy(*group).agg(F.concat(F.lit(markdown_header(columns) + "\n"), lines).alias("markdown"))


def data_uri(b64: Column, mimetype: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mimetype};base64,"), b64)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
