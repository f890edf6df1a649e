"""Every query with SQL gives what DuckDB gives on the same tables."""

from collections import Counter

import pytest

from docloom.operators import graph
from docloom.plans.catalogue import QUERIES, SQL

from .conftest import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_communities_of_all_nodes(spark, small):
    """Labels of every head and tail of any type, against a literal loop."""
    t = [r for r in spark.read.parquet(f"{small}/triples.parquet").collect() if None not in (r["head"], r["tail"], r["relation"])]
    links = graph.both_ways(graph.edges(spark.read.parquet(f"{small}/triples.parquet"))).collect()
    near: dict = {}
    for r in links:
        near.setdefault(r["src"], []).append(r["dst"])
    labels = {n: n for n in near}
    for _ in range(3):
        votes = {n: Counter([labels[n], *(labels[m] for m in around)]) for n, around in near.items()}
        labels = {n: min(v, key=lambda x: (-v[x], x.encode())) for n, v in votes.items()}
    got = {r["node"]: r["community"] for r in QUERIES["communities"](spark, small).collect()}
    assert got == labels and set(got) == {r[s] for r in t for s in ("head", "tail")}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
