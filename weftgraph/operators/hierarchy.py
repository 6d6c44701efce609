"""Full hierarchies from parent-child links: paths, depths, roots, descendants and cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import strong_components
from weftgraph.session import checkpointed

#: A frontier of at most so many rows is broadcast, so that the links need no shuffle on that level.
BROADCAST_FRONT = 50_000


def _links(edges: DataFrame, kind: str) -> DataFrame:
    return (
        edges.where((F.col("kind") == kind) & F.col("branch").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select("branch", "src", "dst").distinct()
    )


def _on_cycles(stuck: DataFrame) -> DataFrame:
    """branch, id on a cycle, from the links among ids that no root settles.

    Where each id has one such parent, the map to the parent is squared until
    its image no longer shrinks; the image then is the cycles. This takes the
    logarithm of the longest tail. Otherwise the general component search runs.
    """
    several = stuck.groupBy("branch", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not several.isEmpty():
        return strong_components(stuck).select("branch", "id")
    jump = stuck.select("branch", F.col("dst").alias("id"), F.col("src").alias("up"))
    size = -1
    while True:
        image = jump.select("branch", F.col("up").alias("id")).distinct()
        n = image.count()
        if n == size:
            return image
        size = n
        second = jump.select("branch", F.col("id").alias("up"), F.col("up").alias("up2"))
        jump = checkpointed(jump.join(second, ["branch", "up"]).select("branch", "id", F.col("up2").alias("up")))


def hierarchy(edges: DataFrame, kind: str = "contains", with_path: bool = True) -> DataFrame:
    """Root, depth and path of every id on each branch; ids on or below a cycle are named.

    Columns: branch, id, status ('tree', 'cycle', 'below'), root_id,
    node_depth, and path (array from the root to the id) if wanted. For
    'cycle' and 'below' the root is 'CYCLE' or 'BELOW', the depth -1 and the
    path null.

    Level by level, the frontier joins the links from the roots down and
    extends depths and paths. An id with several parents waits until all of
    them are settled and then takes the path of the parent with the greatest
    depth, ties the smallest root and path; if the parents have different
    roots, one row for each root comes out. Ids that are never reached that
    way are on a cycle or below one. Repeated links count once, links with a
    null end are left out, an edge to itself is a cycle, and an empty table
    gives no rows. A parent with any number of children is no single task's
    work: a small frontier is broadcast to the links where they lie, and a
    large one is joined by shuffle, where adaptive execution splits hot keys.
    """
    links = checkpointed(_links(edges, kind))
    parents = links.groupBy("branch", "dst").agg(F.count(F.lit(1)).alias("n_parents"))
    multi = checkpointed(parents.where("n_parents > 1"))
    has_multi = not multi.isEmpty()
    if has_multi:
        links = checkpointed(links.join(multi, ["branch", "dst"], "left").select("branch", "src", "dst", F.coalesce("n_parents", F.lit(1)).alias("n_parents")))
    else:
        links = links.withColumn("n_parents", F.lit(1).cast("bigint"))

    state = ["branch", "id", "root_id", "node_depth"] + (["path"] if with_path else [])
    starts = (
        links.select("branch", F.col("src").alias("id")).distinct()
        .join(parents.select("branch", F.col("dst").alias("id")), ["branch", "id"], "left_anti")
        .withColumn("root_id", F.col("id")).withColumn("node_depth", F.lit(0).cast("bigint"))
    )
    if with_path:
        starts = starts.withColumn("path", F.array("id"))
    front = checkpointed(starts.select(*state))
    settled = [front]
    waiting: DataFrame | None = None
    n = front.count()
    while n:
        f = F.broadcast(front) if n <= BROADCAST_FRONT else front
        f = f.select(F.col("branch").alias("b"), F.col("id").alias("p"), *state[2:])
        kids = links.join(f, (links["branch"] == f["b"]) & (links["src"] == f["p"])).select(
            links["branch"], F.col("dst").alias("id"), "root_id", (F.col("node_depth") + 1).alias("node_depth"),
            *([F.concat("path", F.array("dst")).alias("path")] if with_path else []), "n_parents", F.col("p").alias("parent"),
        )
        kids = checkpointed(kids)
        ready = kids.where("n_parents = 1").select(*state)
        n, held = kids.agg(F.count_if(F.col("n_parents") == 1), F.count_if(F.col("n_parents") > 1)).first()
        if held:
            waiting = kids.where("n_parents > 1") if waiting is None else checkpointed(waiting.unionByName(kids.where("n_parents > 1")))
            full = checkpointed(
                waiting.groupBy("branch", "id").agg(F.count_distinct("parent").alias("got"), F.max("n_parents").alias("n_parents"))
                .where("got = n_parents").select("branch", "id")
            )
            best = F.min(F.struct(-F.col("node_depth"), *([F.col("path")] if with_path else [F.lit(0)])))
            took = waiting.join(full, ["branch", "id"], "left_semi").groupBy("branch", "id", "root_id").agg(best.alias("best"))
            took = took.select(
                "branch", "id", "root_id", (-F.col("best")["col1"]).alias("node_depth"), *([F.col("best")["path"].alias("path")] if with_path else [])
            )
            ready = checkpointed(ready.unionByName(took))
            n = ready.count()
            waiting = checkpointed(waiting.join(full, ["branch", "id"], "left_anti"))
        front = ready
        settled.append(front)

    tree = reduce(DataFrame.unionByName, settled)
    known = tree.select("branch", "id").distinct() if has_multi else tree.select("branch", "id")
    stuck_dst = parents.select("branch", F.col("dst").alias("id")).join(known, ["branch", "id"], "left_anti")
    stuck_dst = checkpointed(stuck_dst)
    out = tree.select("branch", "id", F.lit("tree").alias("status"), *state[2:])
    if stuck_dst.isEmpty():
        return out
    stuck = checkpointed(
        links.select("branch", "src", "dst").join(stuck_dst.withColumnRenamed("id", "dst"), ["branch", "dst"], "left_semi")
        .join(stuck_dst.withColumnRenamed("id", "src"), ["branch", "src"], "left_semi")
    )
    cyc = _on_cycles(stuck).withColumn("on", F.lit(1))
    bad = stuck_dst.join(cyc, ["branch", "id"], "left").select(
        "branch", "id", F.when(F.col("on") == 1, "cycle").otherwise("below").alias("status"),
        F.when(F.col("on") == 1, "CYCLE").otherwise("BELOW").alias("root_id"), F.lit(-1).cast("bigint").alias("node_depth"),
        *([F.lit(None).cast("array<string>").alias("path")] if with_path else []),
    )
    return out.unionByName(bad)


def descendants(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """All pairs of ancestor and descendant in the trees, with the most hops between them. Columns: branch, ancestor, descendant, hops.

    Where each id up to the root has one parent, its path is all its ancestors,
    and the pairs need no further join. From ids with several parents and those
    below them the links are walked up level by level, through every parent.
    Ids on or below a cycle have no pairs.
    """
    h = checkpointed(hierarchy(edges, kind, with_path=True).where("status = 'tree' and node_depth > 0"))
    links = checkpointed(_links(edges, kind).join(h.select("branch", F.col("id").alias("dst")).distinct(), ["branch", "dst"], "left_semi"))
    several = checkpointed(links.groupBy("branch", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("branch", F.col("dst").alias("at_id")))
    key = ["branch", "ancestor", "descendant"]
    some = not several.isEmpty()
    if some:
        on_path = h.select("branch", "id", F.explode("path").alias("at_id")).join(several, ["branch", "at_id"], "left_semi")
        mixed = checkpointed(on_path.select("branch", "id").distinct())
        h = h.join(mixed, ["branch", "id"], "left_anti")
    pairs = h.select(
        "branch", F.col("id").alias("descendant"), "node_depth", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("at", "ancestor")
    ).select(*key, (F.col("node_depth") - F.col("at")).cast("bigint").alias("hops"))
    if not some:
        return pairs
    up = links.select("branch", F.col("dst").alias("ancestor"), F.col("src").alias("parent"))
    front = mixed.select("branch", F.col("id").alias("ancestor"), F.col("id").alias("descendant"))
    walked = []
    while True:
        front = front.join(up, ["branch", "ancestor"]).select("branch", F.col("parent").alias("ancestor"), "descendant").distinct()
        front = checkpointed(front)
        if front.isEmpty():
            break
        walked.append(front.withColumn("hops", F.lit(len(walked) + 1).cast("bigint")))
    most = reduce(DataFrame.unionByName, walked).groupBy(*key).agg(F.max("hops").alias("hops"))
    return pairs.unionByName(most)


def deep_or_cyclic(edges: DataFrame, kind: str = "contains", min_depth: int = 10) -> DataFrame:
    """Ids on a cycle, below one, or at least ``min_depth`` hops below their root."""
    h = hierarchy(edges, kind, with_path=False)
    return h.where((F.col("status") != "tree") | (F.col("node_depth") >= min_depth)).select("branch", "id", "root_id", "node_depth").distinct()
