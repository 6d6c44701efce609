"""Aggregates and graph analytics: degrees, hubs, components, cycles, clusters, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators.components import strong_components
from weftgraph.operators.lookup import unused_symbols
from weftgraph.session import checkpointed
from weftgraph.sources.graph import Graph


def graph_stats(g: Graph) -> DataFrame:
    """Rows by kind, of nodes and edges, and their totals: branch, what, kind, n."""
    n = g.nodes.groupBy("branch", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("nodes"))
    e = g.edges.groupBy("branch", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edges"))
    by = n.unionByName(e)
    total = by.groupBy("branch", "what").agg(F.sum("n").cast("bigint").alias("n")).withColumn("kind", F.lit("*"))
    return by.select("branch", "what", "kind", "n").unionByName(total.select("branch", "what", "kind", "n"))


def in_degrees(g: Graph) -> DataFrame:
    """Callers of each node: branch, id, in_degree. Edges are unique, and counting combines on the map side."""
    return g.kind("calls").groupBy("branch", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def hubs(g: Graph, least: int = 10, limit: int | None = 20) -> DataFrame:
    """Nodes with many callers. Without a limit all of them, else the first by degree and qualified name (at most 100)."""
    h = in_degrees(g).where(F.col("in_degree") >= least).join(g.nodes.select("branch", "id", "kind", "name", "qualified_name", "file"), ["branch", "id"])
    return h if limit is None else h.orderBy(F.desc("in_degree"), "qualified_name", "branch", "id").limit(min(limit, 100))


def group_hits_by_file(hits: DataFrame) -> DataFrame:
    """Hits (file, name, score) by file: file, n, names (the first three by score)."""
    w = Window.partitionBy("file").orderBy(F.desc("score"), "name")
    top = hits.withColumn("r", F.row_number().over(w))
    names = F.expr("transform(array_sort(collect_list(case when r <= 3 then struct(r, name) end)), x -> x.name)")
    return top.groupBy("file").agg(F.count(F.lit(1)).alias("n"), names.alias("names"))


def architecture(g: Graph, limit: int | None = None) -> DataFrame:
    """Components (directories) by their weight: branch, component, n_files, score, key_symbols, depends_on.

    Two key symbols and five dependencies are shown; dependencies are those of
    calls, uses and imports that are not inferred.
    """
    n = g.nodes.where(C.agent_relevant(F.col("kind"), F.col("file"), F.col("visibility")))
    n = n.select("branch", "id", "kind", "name", "file", "start_line", C.component_of(F.col("file")).alias("component"))
    n = n.join(in_degrees(g), ["branch", "id"], "left").withColumn("weight", C.tour_score(F.col("kind"), F.coalesce("in_degree", F.lit(0))))
    label = F.concat(F.col("name"), F.lit(" — "), F.col("file"), F.lit(":"), F.col("start_line").cast("string"))
    best = n.groupBy("branch", "component", label.alias("label")).agg(F.max("weight").alias("w"))
    w = Window.partitionBy("branch", "component").orderBy(F.desc("w"), "label")
    top = best.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("branch", "component").agg(
        F.expr("concat_ws(' | ', transform(array_sort(collect_list(struct(r, label))), x -> x.label))").alias("key_symbols")
    )
    of = n.select("branch", "id", "component")
    e = g.kind("calls", "uses", "imports").where(F.coalesce("confidence", F.lit("extracted")) != "inferred").select("branch", "src", "dst")
    deps = (
        e.join(of.select("branch", F.col("id").alias("src"), F.col("component")), ["branch", "src"])
        .join(of.select("branch", F.col("id").alias("dst"), F.col("component").alias("far")), ["branch", "dst"])
        .where("component <> far").select("branch", "component", "far").distinct()
    )
    wd = Window.partitionBy("branch", "component").orderBy("far")
    five = deps.withColumn("r", F.row_number().over(wd)).where("r <= 5").groupBy("branch", "component").agg(F.concat_ws(" | ", F.array_sort(F.collect_list("far"))).alias("depends_on"))
    out = (
        n.groupBy("branch", "component").agg(F.count_distinct("file").alias("n_files"), F.sum("weight").cast("bigint").alias("score"))
        .join(top, ["branch", "component"], "left").join(five, ["branch", "component"], "left")
        .select("branch", "component", "n_files", "score", "key_symbols", F.coalesce("depends_on", F.lit("")).alias("depends_on"))
    )
    return out if limit is None else out.orderBy(F.desc("score"), "component").limit(limit)


def global_tour(g: Graph, limit: int = 8) -> DataFrame:
    """Public production symbols other than methods by their weight, at most eight a branch: branch, step, id, score."""
    n = g.nodes.where(C.agent_relevant(F.col("kind"), F.col("file"), F.col("visibility")) & (F.col("kind") != "method"))
    n = n.join(in_degrees(g), ["branch", "id"], "left").withColumn("score", C.tour_score(F.col("kind"), F.coalesce("in_degree", F.lit(0))))
    w = Window.partitionBy("branch").orderBy(F.desc("score"), "qualified_name", "id")
    # two stages of top-k by salt, so that one branch is not one task
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    ws = Window.partitionBy("branch", salt).orderBy(F.desc("score"), "qualified_name", "id")
    most = min(limit, 8)
    return n.withColumn("r", F.row_number().over(ws)).where(F.col("r") <= most).withColumn("step", F.row_number().over(w)).where(F.col("step") <= most).select("branch", "step", "id", "score")


def group_summary(g: Graph) -> DataFrame:
    """Groups of files by package or first directory: branch, name, nodes, loc, relations, boundary_relations."""
    n = g.nodes.where("file is not null").select("branch", "id", "loc", C.cluster_for_file(F.col("file")).alias("name"))
    size = n.groupBy("branch", "name").agg(F.count(F.lit(1)).alias("nodes"), F.sum("loc").alias("loc"))
    of = n.select("branch", "id", "name")
    e = g.edges.select("branch", "src", "dst")
    ends = (
        e.join(of.select("branch", F.col("id").alias("src"), F.col("name").alias("s")), ["branch", "src"], "left")
        .join(of.select("branch", F.col("id").alias("dst"), F.col("name").alias("d")), ["branch", "dst"], "left")
        .groupBy("branch", "s", "d").agg(F.count(F.lit(1)).alias("n"))
    )
    crossing = F.col("s").isNotNull() & F.col("d").isNotNull() & (F.col("s") != F.col("d"))
    by_src = ends.where("s is not null").select("branch", F.col("s").alias("name"), F.col("n").alias("rel"), F.when(crossing, F.col("n")).otherwise(0).alias("cross"))
    by_dst = ends.where("d is not null and (s is null or s <> d)").select("branch", F.col("d").alias("name"), F.col("n").alias("rel"), F.col("n").alias("cross"))
    rel = by_src.unionByName(by_dst).groupBy("branch", "name").agg(F.sum("rel").alias("relations"), F.sum("cross").alias("boundary_relations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return size.join(rel, ["branch", "name"], "left").select("branch", "name", "nodes", zero("loc"), zero("relations"), zero("boundary_relations"))


def boundary_edges(g: Graph) -> DataFrame:
    """Edges whose ends fall into different groups: branch, src, dst, kind, src_group, dst_group."""
    of = g.nodes.where("file is not null").select("branch", "id", C.cluster_for_file(F.col("file")).alias("grp"))
    return (
        g.edges.join(of.select("branch", F.col("id").alias("src"), F.col("grp").alias("src_group")), ["branch", "src"])
        .join(of.select("branch", F.col("id").alias("dst"), F.col("grp").alias("dst_group")), ["branch", "dst"])
        .where("src_group <> dst_group").select("branch", "src", "dst", "kind", "src_group", "dst_group")
    )


def complexity_score(g: Graph) -> DataFrame:
    """0.55 of the logarithm of lines and 0.45 of that of degree, each against the branch's greatest: branch, id, score."""
    ends = g.edges.select("branch", F.explode(F.array("src", "dst")).alias("id"))
    deg = ends.groupBy("branch", "id").agg(F.count(F.lit(1)).alias("deg"))
    n = g.nodes.select("branch", "id", F.coalesce("loc", F.lit(0)).alias("loc")).join(deg, ["branch", "id"], "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    most = n.groupBy("branch").agg(F.greatest(F.max("loc"), F.lit(1)).alias("ml"), F.greatest(F.max("deg"), F.lit(1)).alias("md"))
    score = F.lit(0.55) * F.log2(F.col("loc") + 1) / F.log2(F.col("ml") + 1) + F.lit(0.45) * F.log2(F.col("deg") + 1) / F.log2(F.col("md") + 1)
    return n.join(most, "branch").select("branch", "id", F.round(score, 6).alias("score"))


def hot_files(log: DataFrame, limit: int | None = 25) -> DataFrame:
    """Touches, lines added and deleted, and last change of each path of a log (path, additions, deletions, ts), without vendored paths."""
    kept = log.where(~F.col("path").rlike(r"(^|/)(target|node_modules|dist|vendor)/"))
    out = kept.groupBy("path").agg(
        F.count(F.lit(1)).alias("touches"), F.sum("additions").cast("bigint").alias("additions"), F.sum("deletions").cast("bigint").alias("deletions"), F.max("ts").alias("last_changed")
    )
    return out if limit is None else out.orderBy(F.desc("touches"), F.desc(F.col("additions") + F.col("deletions")), "path").limit(min(limit, 200))


def hotspot_scores(g: Graph, history: DataFrame) -> DataFrame:
    """Touches of a node's file against the greatest number of touches: branch, id, heat."""
    most = history.agg(F.max("touches")).first()[0] or 1
    return g.nodes.select("branch", "id", F.col("file").alias("path")).join(history.select("path", "touches"), "path").select("branch", "id", F.round(F.col("touches") / F.lit(float(most)), 6).alias("heat"))


def import_cycles(g: Graph) -> DataFrame:
    """Components of more than one node that import each other: branch, component, id."""
    e = g.kind("imports").where("src <> dst")
    return strong_components(e).select("branch", "component", "id")


def health(g: Graph) -> DataFrame:
    """branch, unused, cycles, hubs (of at least 5 callers, counted to 10), severity."""
    u = unused_symbols(g).groupBy("branch").agg(F.count(F.lit(1)).alias("unused"))
    c = import_cycles(g).groupBy("branch").agg(F.count_distinct("component").alias("cycles"))
    h = hubs(g, 5, None).groupBy("branch").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("hubs"))
    b = g.nodes.select("branch").distinct()
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    out = b.join(u, "branch", "left").join(c, "branch", "left").join(h, "branch", "left").select("branch", zero("unused"), zero("cycles"), zero("hubs"))
    return out.withColumn("severity", F.when((F.col("cycles") > 0) | (F.col("hubs") > 5), "HIGH").when((F.col("unused") > 20) | (F.col("hubs") > 0), "MEDIUM").otherwise("LOW"))


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """Clusters by synchronous label propagation over contains and calls, without direction: branch, id, label.

    All nodes change at once, by the labels of the round before, and keep their
    own label in case of its tie; the reference order of sequential updates is
    ``sequential_clusters``. Votes are counted by (node, label), which combines
    on the map side, so a hub is not one task's work.
    """
    e = g.kind("contains", "calls")
    adj = checkpointed(e.select("branch", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select("branch", F.col("dst").alias("a"), F.col("src").alias("b"))))
    labels = checkpointed(g.nodes.select("branch", "id", F.col("id").alias("label")))
    names = checkpointed(g.nodes.select("branch", F.col("id").alias("label"), "qualified_name"))
    for _ in range(rounds):
        votes = (
            adj.join(labels.select("branch", F.col("id").alias("b"), "label"), ["branch", "b"])
            .groupBy("branch", F.col("a").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
            .join(names, ["branch", "label"])
        )
        best = votes.groupBy("branch", "id").agg(F.min(F.struct(-F.col("n"), F.col("qualified_name"), F.col("label")))["label"].alias("new"))
        moved = checkpointed(labels.join(best, ["branch", "id"], "left").select("branch", "id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        labels = moved.select("branch", "id", "label")
        if moved.where("moved").isEmpty():
            break
    return labels


def sequential_clusters(g: Graph, rounds: int = 20) -> DataFrame:
    """Clusters by label propagation in place, node after node by qualified name: branch, id, label.

    The order of updates decides the result, so a branch is one task's work;
    use ``label_propagation`` for branches beyond a task's memory.
    """
    n = g.nodes.select("branch", F.lit(0).alias("t"), F.col("id").alias("a"), F.col("qualified_name").alias("b"))
    e = g.kind("contains", "calls").select("branch", F.lit(1).alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["t"] == 0]
        name = dict(zip(nodes["a"], nodes["b"].fillna(""), strict=True))
        adj: dict[str, list[str]] = {}
        for a, b in pdf.loc[pdf["t"] == 1, ["a", "b"]].itertuples(index=False):
            adj.setdefault(a, []).append(b)
            adj.setdefault(b, []).append(a)
        label = {k: k for k in name}
        order = sorted(name, key=lambda k: (name[k], k))
        for _ in range(rounds):
            changed = False
            for k in order:
                votes: dict[str, int] = {}
                for o in adj.get(k, ()):
                    if o in label:
                        votes[label[o]] = votes.get(label[o], 0) + 1
                if votes:
                    best = min(votes, key=lambda x: (-votes[x], name[x], x))
                    if best != label[k]:
                        label[k], changed = best, True
            if not changed:
                break
        return pd.DataFrame({"branch": pdf["branch"].iloc[0], "id": list(label), "label": list(label.values())})

    return n.unionByName(e).groupBy("branch").applyInPandas(run, "branch string, id string, label string")


def cluster_report(g: Graph, labels: DataFrame, least: int = 3) -> DataFrame:
    """Clusters of at least ``least`` nodes, named by their most called member: branch, label, size."""
    n = g.nodes.select("branch", "id", "qualified_name").join(in_degrees(g), ["branch", "id"], "left")
    key = F.struct(-F.coalesce("in_degree", F.lit(0)), F.col("qualified_name"), F.col("id"))
    return (
        labels.withColumnRenamed("label", "cl").join(n, ["branch", "id"]).groupBy("branch", "cl")
        .agg(F.count(F.lit(1)).alias("size"), F.min(key)["qualified_name"].alias("label"))
        .where(F.col("size") >= max(2, least)).select("branch", "label", "size")
    )


def cluster_members(g: Graph, labels: DataFrame, least: int = 3, most: int = 25) -> DataFrame:
    """The first ``most`` members of each cluster by in-degree and qualified name: branch, cluster, place, id, file.

    Two stages of top-k by salt, so a cluster of any size is no single task's work.
    """
    n = g.nodes.select("branch", "id", "qualified_name", "file").join(in_degrees(g), ["branch", "id"], "left")
    m = labels.select("branch", "id", F.col("label").alias("cluster")).join(n, ["branch", "id"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.coalesce("in_degree", F.lit(0)).desc(), F.col("qualified_name"), F.col("id")]
    big = labels.groupBy("branch", F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, least)).select("branch", "cluster")
    salted = Window.partitionBy("branch", "cluster", "salt").orderBy(*order)
    first = m.join(big, ["branch", "cluster"], "left_semi").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= most)
    whole = Window.partitionBy("branch", "cluster").orderBy(*order)
    return first.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= most).select("branch", "cluster", "place", "id", "file")


def empty_branches(g: Graph) -> DataFrame:
    """Whether each branch that edges or nodes name has no nodes: branch, empty."""
    has = g.nodes.select("branch").distinct().withColumn("has", F.lit(True))
    return g.edges.select("branch").union(g.nodes.select("branch")).distinct().join(has, "branch", "left").select("branch", F.col("has").isNull().alias("empty"))


def scale_tier(nodes: int) -> str:
    """Size class of a graph for drawing."""
    return "small" if nodes <= 1_000 else "medium" if nodes <= 10_000 else "large" if nodes <= 40_000 else "huge"


def relevance(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Reciprocal rank, precision at 5 and file recall of ranked evidence.

    ranked: query, place, file; truth: query, file. A place is relevant if its
    file is among the true files. Columns: query, mrr, precision_at_5, file_recall.
    """
    t = truth.select("query", F.col("file").alias("tf")).distinct()
    r = ranked.join(t.withColumnRenamed("query", "tq"), (F.col("query") == F.col("tq")) & (F.col("file") == F.col("tf")), "left").select("query", "place", "tf")
    n = t.groupBy("query").agg(F.count(F.lit(1)).alias("n_true"))
    s = r.groupBy("query").agg(
        F.min(F.when(F.col("tf").isNotNull(), F.col("place"))).alias("first"),
        F.sum(F.when(F.col("tf").isNotNull() & (F.col("place") <= 5), 1).otherwise(0)).alias("at5"), F.count_distinct("tf").alias("found"),
    )
    return n.join(s, "query", "left").select(
        "query", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("at5", F.lit(0)) / 5.0, 6).alias("precision_at_5"),
        F.round(F.coalesce("found", F.lit(0)) / F.col("n_true"), 6).alias("file_recall"),
    )


def geometric_mean(df: DataFrame, value: str) -> DataFrame:
    """Geometric mean and median of positive values: geomean, median."""
    return df.where(F.col(value) > 0).agg(F.round(F.exp(F.avg(F.log(value))), 6).alias("geomean"), F.round(F.percentile(value, 0.5), 6).alias("median"))
