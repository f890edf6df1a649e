"""Property graphs of triples: merge, match, neighbours, degree, weights, resolution, components, communities, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import EDGE, NODE
from ..session import cut
from ..sources.readers import open_store


def _named(triples: DataFrame) -> DataFrame:
    return triples.where("head IS NOT NULL AND tail IS NOT NULL AND relation IS NOT NULL")


def ends(triples: DataFrame, *keep: str) -> DataFrame:
    """(node, type, *keep): one row for each head and each tail."""
    sides = F.array(F.struct(F.col("head").alias("node"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("node"), F.col("tail_type").alias("type")))
    return _named(triples).select(*keep, F.explode(sides).alias("e")).select("e.node", "e.type", *keep)


def nodes(triples: DataFrame, label: str = "Entity") -> DataFrame:
    """(node, label, type, n): nodes merged by name; the type given most often, ties to the smaller one."""
    by = ends(triples).groupBy("node", "type").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("type", F.struct(F.col("type").isNotNull(), "n", F.expr("-length(type)"), "type")).alias("type")
    return by.groupBy("node").agg(best, F.sum("n").alias("n")).select("node", F.lit(label).alias("label"), "type", "n")


def edges(triples: DataFrame) -> DataFrame:
    """(src, rel, dst, weight, confidence): edges merged; how often each was stated, and its best confidence."""
    t = _named(triples).select(F.col("head").alias("src"), F.col("relation").alias("rel"), F.col("tail").alias("dst"), "confidence")
    return t.groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("weight"), F.max("confidence").alias("confidence"))


def mentions(triples: DataFrame, key: str = "doc_id") -> DataFrame:
    return ends(triples, key).where(F.col(key).isNotNull()).select(key, "node").distinct()


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of new that are not stored yet, each once."""
    keys = ["src", "rel", "dst"]
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of new that are not stored yet, each once."""
    return new.dropDuplicates(["node"]).join(stored.select("node"), "node", "left_anti")


def store_graph(spark: SparkSession, nodes_: DataFrame, edges_: DataFrame, path: str) -> None:
    """Add nodes and edges to the graph stored in a folder; those it has already stay as they are, so storing twice adds nothing."""
    have_nodes, have_edges = open_graph(spark, path)
    for new, at in ((upsert_nodes(have_nodes, nodes_), "nodes"), (upsert_edges(have_edges, edges_), "edges")):
        new.write.mode("append").parquet(f"{path}/{at}")


def open_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph, empty before its first write."""
    return open_store(spark, f"{path}/nodes", NODE), open_store(spark, f"{path}/edges", EDGE)


def set_property(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def schema_summary(triples: DataFrame) -> DataFrame:
    """(head_type, relation, tail_type, n) of all triples."""
    return _named(triples).groupBy("head_type", "relation", "tail_type").agg(F.count(F.lit(1)).alias("n"))


def match(edges_: DataFrame, *hops: str | None) -> DataFrame:
    """Paths of the given relations, null for any: columns n0, n1 and so on.  Each hop is one equi-join."""
    out = None
    for i, rel in enumerate(hops):
        e = edges_ if rel is None else edges_.where(F.col("rel") == rel)
        step = e.select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
        out = step if out is None else out.join(step, f"n{i}")
    return out.select(*(f"n{i}" for i in range(len(hops) + 1)))


def both_ways(edges_: DataFrame) -> DataFrame:
    return edges_.select("src", "dst").unionByName(edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degrees(edges_: DataFrame) -> DataFrame:
    """(node, degree): number of distinct neighbours."""
    return both_ways(edges_).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def prune_leaves(edges_: DataFrame, least: int = 2) -> DataFrame:
    """Edges whose ends both have `least` neighbours."""
    kept = degrees(edges_).where(F.col("degree") >= least).select("node")
    return edges_.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def neighbours(edges_: DataFrame, start: DataFrame) -> DataFrame:
    """(node, neighbour) of the nodes of start (node)."""
    return both_ways(edges_).join(start.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component): connected components, each under its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which end after about log^2 rounds
    whatever the diameter; every round is checkpointed, and only its sum of labels reaches the driver.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        two = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(low, "u")
        e = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def label_propagation(edges_: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the commonest label of its neighbours and its own, ties to the smaller one.

    Its own label votes too, so two sides of a bipartite graph don't swap labels for ever; ends where no label changes,
    after `rounds` at the latest.
    """
    two = cut(both_ways(edges_))
    labels = two.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = two.join(labels, two["dst"] == labels["node"]).select("src", "community").unionByName(labels.select(F.col("node").alias("src"), "community"))
        counted = votes.groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        new = cut(best.select(F.col("src").alias("node"), F.col("b.community").alias("community")))
        changed = not new.join(labels.withColumnRenamed("community", "before"), "node").where("community <> before").isEmpty()
        labels = new
        if not changed:
            break
    return labels


def community_facts(edges_: DataFrame, communities: DataFrame, most: int = 50) -> DataFrame:
    """(community, n_nodes, n_edges, facts): the facts inside each community by weight, as many as a prompt shall hold."""
    c = lambda end: communities.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    inside = edges_.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst").withColumn("community", F.col("c_src"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "src", "rel", "dst"))
    fact = F.concat_ws(" ", "src", "rel", "dst")
    top = inside.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", fact.alias("f")))), lambda x: x["f"]), "\n").alias("facts"))
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    edges_in = inside.groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"))
    return sizes.join(edges_in, "community", "left").join(top, "community", "left").select("community", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("facts", F.lit("")).alias("facts"))


def resolve_names(names: DataFrame, name: str, distance: int = 2) -> DataFrame:
    """(a, b, distance) of distinct names within `distance` edits: they share one of distance + 1 parts at nearly its place, so candidates meet on parts."""
    parts = distance + 1
    n = names.select(F.col(name).alias("a")).where(F.length(name) > distance).distinct().withColumn("len", F.length("a"))
    begin = lambda full, part: f"cast(floor({full} * ({part}) / {parts}) as int)"
    each = lambda c, lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(c)
    split = n.select("a", "len", each("part", 0, distance))
    index = split.selectExpr("a AS b", "part", "len AS full", f"substring(a, {begin('len', 'part')} + 1, {begin('len', 'part + 1')} - {begin('len', 'part')}) AS seg")
    spots = split.select("*", each("d", -distance, distance)).select("*", each("shift", -distance, distance)).selectExpr("a", "part", "len + d AS full", "shift")
    spots = spots.selectExpr("a", "part", "full", f"{begin('full', 'part')} + shift AS at", f"{begin('full', 'part + 1')} - {begin('full', 'part')} AS size").where("at >= 0")
    probe = spots.selectExpr("a", "part", "full", "substring(a, at + 1, size) AS seg")
    met = probe.join(index, ["part", "full", "seg"]).where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b").cast("long")).where(F.col("distance") <= distance)


def render(nodes_: DataFrame, edges_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON texts of nodes and edges for a network view, nodes grouped by type."""
    n = nodes_.select(F.to_json(F.struct(F.col("node").alias("id"), F.col("node").alias("label"), F.col("type").alias("group"), F.col("type").alias("title"))).alias("json"))
    e = edges_.select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("rel").alias("label"), F.lit("to").alias("arrows"))).alias("json"))
    return n, e


def hybrid(local: DataFrame, global_: DataFrame, k: int, local_weight: float = 1.0, global_weight: float = 1.0) -> DataFrame:
    """(qid, kind, item, score, rank): local and global hits (qid, item, score) in one ranking of k a question."""
    both = local.select("qid", F.lit("local").alias("kind"), "item", (F.col("score") * local_weight).alias("score")).unionByName(
        global_.select("qid", F.lit("global").alias("kind"), "item", (F.col("score") * global_weight).alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "kind", "item")).cast("long")
    return both.withColumn("rank", rank).where(F.col("rank") <= k)
