"""Strongly connected components of a directed graph by colouring, as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import checkpointed


def _min_reach(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The least id that reaches each vertex: label propagation along the edges to a fixpoint.

    colour: branch, id, c. edges: branch, src, dst. Only vertices whose label
    fell in the last round send it on, so a round costs the edges of the front.
    """
    front = colour
    while True:
        sent = (
            front.alias("f").join(edges.alias("e"), (F.col("f.branch") == F.col("e.branch")) & (F.col("f.id") == F.col("e.src")))
            .groupBy(F.col("e.branch").alias("branch"), F.col("e.dst").alias("id")).agg(F.min("f.c").alias("n"))
        )
        merged = checkpointed(
            colour.join(sent, ["branch", "id"], "left").select(
                "branch", "id", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("fell")
            )
        )
        colour = merged.select("branch", "id", "c")
        front = merged.where("fell").select("branch", "id", "c")
        if front.isEmpty():
            return colour


def strong_components(edges: DataFrame) -> DataFrame:
    """Component of each vertex that lies on a cycle. Columns: branch, id, component.

    edges: branch, src, dst; rows with nulls are left out, repeats count once.
    component is the least id of the strongly connected component. Vertices on
    no cycle are left out; an edge to itself makes a component of one.

    Each round trims vertices without a way in or out, colours every vertex
    with the least id that reaches it, and takes of each colour the vertices
    that reach back to that id inside the colour. Those form components and
    leave the graph. Nothing is collected; each round ends with a checkpoint.
    """
    e = checkpointed(
        edges.select("branch", "src", "dst").where("branch is not null and src is not null and dst is not null").distinct()
    )
    loops = e.where("src = dst").select("branch", F.col("src").alias("id"), F.col("src").alias("component"))
    rest = e.where("src <> dst")
    found: DataFrame | None = None
    while True:
        rest = trim(rest)
        if rest.isEmpty():
            break
        v = rest.select("branch", F.col("src").alias("id")).union(rest.select("branch", F.col("dst").alias("id"))).distinct()
        colour = _min_reach(v.withColumn("c", F.col("id")), rest)
        src = colour.select("branch", F.col("id").alias("src"), F.col("c").alias("cs"))
        dst = colour.select("branch", F.col("id").alias("dst"), F.col("c").alias("cd"))
        inner = checkpointed(rest.join(src, ["branch", "src"]).join(dst, ["branch", "dst"]).where("cs = cd").select("branch", "src", "dst", "cs"))
        # backwards from each colour's own id, within the colour
        back = checkpointed(colour.where("id = c"))
        front = back
        while True:
            nxt = (
                inner.alias("e").join(front.alias("f"), (F.col("e.branch") == F.col("f.branch")) & (F.col("e.dst") == F.col("f.id")))
                .select(F.col("e.branch").alias("branch"), F.col("e.src").alias("id"), F.col("e.cs").alias("c")).distinct()
                .join(back, ["branch", "id"], "left_anti")
            )
            front = checkpointed(nxt)
            if front.isEmpty():
                break
            back = checkpointed(back.unionByName(front))
        sizes = back.groupBy("branch", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        comp = back.join(sizes, ["branch", "c"]).select("branch", "id", F.col("c").alias("component"))
        found = comp if found is None else found.unionByName(comp)
        done = back.select("branch", "id")
        rest = checkpointed(
            rest.join(done.withColumnRenamed("id", "src"), ["branch", "src"], "left_anti")
            .join(done.withColumnRenamed("id", "dst"), ["branch", "dst"], "left_anti").select("branch", "src", "dst")
        )
    if found is None:
        return loops
    return found.unionByName(loops.join(found.select("branch", "id"), ["branch", "id"], "left_anti"))


def trim(edges: DataFrame) -> DataFrame:
    """Edges left after removing, again and again, those whose end has no way out or whose start has no way in."""
    n = edges.count()
    while n:
        srcs = edges.select("branch", F.col("src").alias("x")).distinct()
        dsts = edges.select("branch", F.col("dst").alias("x")).distinct()
        edges = checkpointed(
            edges.join(srcs.withColumnRenamed("x", "dst"), ["branch", "dst"], "left_semi")
            .join(dsts.withColumnRenamed("x", "src"), ["branch", "src"], "left_semi").select("branch", "src", "dst")
        )
        m = edges.count()
        if m == n:
            break
        n = m
    return edges
