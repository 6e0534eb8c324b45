"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import hot_split_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is a node of the component.

    Each round every node hooks onto its least neighbour (in hash order, so that
    a chain of nodes breaks up in few rounds), chains of two hooks are cut to one,
    and the edges are rewritten to the nodes that are left. Least neighbours are found by partial
    aggregates, and the hooks are joined back with hot nodes split off. Rounds are
    written to the shared folder.
    """
    edges = written(edges.where("a <> b").distinct(), "cc-edges")
    roots = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    roots = roots.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")))
        hook = both.groupBy("a").agg(least["n"].alias("p")).withColumnRenamed("a", "n")
        hook = written(hook, "cc-hooks")
        up = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
        hook = written(hot_split_join(hook, up, ["p"]).select("n", F.col("q").alias("p")), "cc-hooks")
        to_a, to_b = hook.select(F.col("n").alias("a"), F.col("p").alias("x")), hook.select(F.col("n").alias("b"), F.col("p").alias("y"))
        moved = hot_split_join(hot_split_join(edges, to_a, ["a"]), to_b, ["b"])
        edges = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        up = hook.select(F.col("n").alias("root"), F.col("p").alias("to"))
        roots = written(hot_split_join(roots, up, ["root"], "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
    return roots
