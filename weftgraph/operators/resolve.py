"""References resolved by name, branch differences, and graphs written and updated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.schema import RESOLVE_FANOUT
from weftgraph.sources.graph import Graph

# The kinds of node that each kind of reference may mean.
ALLOWED = {
    "calls": ["function", "method", "macro", "struct"], "uses": ["struct", "enum", "trait", "interface", "type_alias"],
    "implements": ["trait", "interface", "struct"], "inherits": ["struct", "interface", "trait"],
    "imports": ["function", "method", "struct", "enum", "trait", "interface", "type_alias", "constant", "macro", "module"],
    "annotated": ["function", "method", "struct", "annotation", "macro", "interface"], "throws": ["struct"], "references": [],
}


def resolve_references(refs: DataFrame, nodes: DataFrame, fanout: int = RESOLVE_FANOUT) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): references met with nodes of their name, kind and language.

    A name with more than ``fanout`` candidates gives no edge. The candidates
    are counted by (branch, name, kind, language) before the join, so a common
    name never multiplies rows. Edges are 'resolved' where the source's file
    imports the name, else 'inferred'. Null names and built-in types of the
    language give nothing; repeated references count once, with their least line.
    """
    fam = C.language_family(F.col("src_file"))
    r = (
        refs.where("target_name is not null and src is not null")
        .withColumn("family", fam)
        .where((F.col("ref_kind") == "references") | ~C.is_builtin(F.col("target_name"), F.col("family")))
        .groupBy("branch", "src", "src_file", "target_name", "ref_kind", "family").agg(F.min("line").alias("line"))
    )
    cand = nodes.where(~F.col("kind").isin("file", "folder", "section")).select("branch", F.col("id").alias("dst"), "kind", F.col("name").alias("target_name"), C.language_family(F.col("file")).alias("nf"))
    allowed = F.lit(False)
    for k, v in ALLOWED.items():
        allowed = allowed | ((F.col("ref_kind") == k) & (F.col("kind").isin(v) if v else F.lit(True)))
    scoped = F.col("family").isNull() | F.col("nf").isNull() | (F.col("family") == F.col("nf")) | (F.col("ref_kind") == "references")
    groups = cand.groupBy("branch", "target_name", "kind", "nf").agg(F.count(F.lit(1)).alias("c"))
    asked = r.select("branch", "target_name", "ref_kind", "family").distinct()
    few = (
        asked.join(groups, ["branch", "target_name"]).where(allowed & scoped)
        .groupBy("branch", "target_name", "ref_kind", "family").agg(F.sum("c").alias("c"))
    )
    key = ["branch", "target_name", "ref_kind"]
    few = few.withColumn("family", F.coalesce("family", F.lit("*")))
    r = r.withColumn("fkey", F.coalesce("family", F.lit("*")))
    counted = r.join(few.withColumnRenamed("family", "fkey"), [*key, "fkey"], "left")
    unresolved = counted.where("c is null").select("branch", "src", "src_file", "target_name", "ref_kind", "line")
    live = counted.where(F.col("c") <= fanout)
    imported = refs.where("ref_kind = 'imports' and target_name is not null").select("branch", "src_file", "target_name").distinct().withColumn("ok", F.lit(1))
    e = live.join(cand, ["branch", "target_name"]).where(allowed & scoped & (F.col("src") != F.col("dst")))
    e = e.join(imported, ["branch", "src_file", "target_name"], "left")
    conf = F.when(F.col("ok") == 1, "resolved").otherwise("inferred")
    edges = e.groupBy("branch", "src", "dst", F.col("ref_kind").alias("kind")).agg(F.min("line").alias("line"), F.max(conf).alias("confidence"))
    return edges, unresolved


def verified_imports(refs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (branch, src, target_name) whose file has a node that imports a node of that name."""
    n = nodes.select("branch", "id", "name", "file")
    has = (
        edges.where("kind = 'imports'").join(n.select("branch", F.col("id").alias("src"), F.col("file").alias("src_file")), ["branch", "src"])
        .join(n.select("branch", F.col("id").alias("dst"), F.col("name").alias("target_name")), ["branch", "dst"])
        .select("branch", "src_file", "target_name")
    )
    return refs.join(has, ["branch", "src_file", "target_name"], "left_semi").select("branch", "src", "target_name").distinct()


def diff_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Ids that only one of two branches has: id, change ('added' or 'removed')."""
    a, b = base.select("id").distinct(), head.select("id").distinct()
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "id", "left_anti").withColumn("change", F.lit("removed")))


def removed_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """The nodes of ``base`` whose ids ``head`` lacks: id, kind, name, qualified_name, file, start_line."""
    return base.join(head.select("id").distinct(), "id", "left_anti").select("id", "kind", "name", "qualified_name", "file", "start_line")


def diff_edges(base: DataFrame, head: DataFrame) -> DataFrame:
    """Edges that one branch lacks or has with another line or confidence: src, dst, kind, change. A changed edge is added and removed."""
    cols = ["src", "dst", "kind", "line", "confidence"]
    a, b = base.select(*cols), head.select(*cols)
    added = b.exceptAll(a).select("src", "dst", "kind").distinct().withColumn("change", F.lit("added"))
    removed = a.exceptAll(b).select("src", "dst", "kind").distinct().withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def apply_diff(g: Graph, added_nodes: DataFrame, removed_files: DataFrame, added_edges: DataFrame, refs: DataFrame | None = None) -> Graph:
    """A graph with the nodes of changed files replaced.

    removed_files: branch, file. Nodes of those files go with their edges, new
    nodes and edges come in, and references (all that are stored, if given)
    are resolved anew, so edges from unchanged files into changed ones come
    back and an update equals a full build. Dangling edges are dropped.
    """
    from weftgraph.sources.graph import induced_edges

    gone = removed_files.select("branch", "file")
    kept = g.nodes.join(gone, ["branch", "file"], "left_anti").select(g.nodes.columns)
    nodes = kept.unionByName(added_nodes.select(g.nodes.columns)).dropDuplicates(["branch", "id"])
    old = g.edges.join(kept.select("branch", F.col("id").alias("src")), ["branch", "src"], "left_semi")
    cols = ["branch", "src", "dst", "kind", "line", "confidence"]
    edges = old.select(*cols).unionByName(added_edges.select(*cols))
    if refs is not None:
        edges = edges.unionByName(resolve_references(refs, nodes)[0].select(*cols))
    first = F.min(F.struct(C.confidence_rank(F.col("confidence")), F.col("line"), F.col("confidence")))
    edges = edges.groupBy("branch", "src", "dst", "kind").agg(first.alias("f")).select("branch", "src", "dst", "kind", "f.line", "f.confidence")
    return Graph(nodes, induced_edges(edges, nodes))
