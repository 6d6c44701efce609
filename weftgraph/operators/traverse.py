"""Traversals by frontier: one join for each hop, for any number of seeds at once.

Each seed is a key of its own: rows are (branch, seed, id, hop). A hop joins
the frontier with the edges, drops what the seed has already reached, and ends
with a checkpoint, so lost executors cost one hop at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators import bitreach as B
from weftgraph.schema import MAX_DEPTH, TRACE_MAX_HOPS
from weftgraph.session import checkpointed
from weftgraph.sources.graph import Graph, induced_edges

#: A frontier of at most so many rows is broadcast.
BROADCAST_FRONT = 50_000


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """branch, a, b: an edge is walked from a to b."""
    out = edges.select("branch", F.col("src").alias("a"), F.col("dst").alias("b"))
    into = edges.select("branch", F.col("dst").alias("a"), F.col("src").alias("b"))
    return (out if direction == "out" else into if direction == "in" else out.unionByName(into)).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "in", exclude: DataFrame | None = None) -> DataFrame:
    """Breadth-first search by id: branch, seed, id, hop; hop 0 is the seed itself.

    seeds: branch, seed, id. ``exclude`` (branch, id) is never entered. Each id
    comes once for each seed, at its least hop. Null ends are left out.
    """
    steps = checkpointed(_steps(edges, direction))
    seen = checkpointed(seeds.select("branch", "seed", "id").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        small = front.limit(BROADCAST_FRONT + 1).count() <= BROADCAST_FRONT
        f = front.select(F.col("branch").alias("fb"), "seed", F.col("id").alias("fi"))
        f = F.broadcast(f) if small else f
        nxt = steps.join(f, (F.col("branch") == F.col("fb")) & (F.col("a") == F.col("fi"))).select("branch", "seed", F.col("b").alias("id")).distinct()
        nxt = nxt.join(seen.select("branch", "seed", "id"), ["branch", "seed", "id"], "left_anti")
        if exclude is not None:
            nxt = nxt.join(exclude.select("branch", "id"), ["branch", "id"], "left_anti")
        front = checkpointed(nxt.select("branch", "seed", "id", F.lit(hop).alias("hop")))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def reach_by_name(g: Graph, seeds: DataFrame, depth: int = MAX_DEPTH, direction: str = "in", most: int = B.STEPS) -> DataFrame:
    """Breadth-first search whose frontier holds names: branch, seed, id, hop.

    seeds: branch, name. A hop leads from all nodes that share a name of the
    frontier; visited are ids. So nodes of one name are never told apart, which
    differs from ``reach`` where names collide. The seed's own nodes may be
    reached again and then count. Depth is at most 5. Up to ``most`` steps are
    searched by bits in memory, more by joins of the frontier.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    steps, nodes, names = _numbered_calls(g, direction)
    if steps.count() > most:
        return _reach_by_name_joined(g, seeds, depth, direction)
    own = seeds.select("branch", "name").distinct().join(names, ["branch", "name"]).select("branch", "x", F.col("name").alias("s"))
    return B.search(steps, nodes.select("branch", "x", "y", F.col("id").alias("s")), own, depth, named=True)


def _numbered_calls(g: Graph, direction: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps (branch, x of a name, y of a node), nodes (branch, id, x, y of its name) and names (branch, name, x)."""
    n = B.numbered(g.nodes.select("branch", "id", "name"), "x")
    names = B.numbered(n.where("name is not null").select("branch", "name").distinct(), "x")
    n = checkpointed(n.join(names.withColumnRenamed("x", "y"), ["branch", "name"], "left").select("branch", "id", "x", "y"))
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    steps = (
        g.kind("calls").select("branch", "src", "dst")
        .join(n.where("y is not null").select("branch", F.col("id").alias(a), F.col("y").alias("__a")), ["branch", a])
        .join(n.select("branch", F.col("id").alias(b), F.col("x").alias("__b")), ["branch", b])
        .select("branch", F.col("__a").alias("x"), F.col("__b").alias("y")).distinct()
    )
    return checkpointed(steps), n, names


def _reach_by_name_joined(g: Graph, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    n = g.nodes.select("branch", "id", "name")
    e = g.kind("calls").select("branch", "src", "dst")
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    named = (
        e.join(n.select("branch", F.col("id").alias(a), F.col("name").alias("a_name")), ["branch", a])
        .join(n.select("branch", F.col("id").alias(b), F.col("name").alias("b_name")), ["branch", b])
        .select("branch", "a_name", F.col(b).alias("id"), "b_name").distinct()
    )
    named = checkpointed(named)
    names = seeds.select("branch", F.col("name").alias("seed"), "name").distinct()
    seen: DataFrame | None = None
    for hop in range(1, depth + 1):
        f = names.select(F.col("branch").alias("fb"), "seed", F.col("name").alias("fn"))
        nxt = named.join(f, (F.col("branch") == F.col("fb")) & (F.col("a_name") == F.col("fn"))).select("branch", "seed", "id", F.col("b_name").alias("name")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select("branch", "seed", "id"), ["branch", "seed", "id"], "left_anti")
        nxt = checkpointed(nxt.withColumn("hop", F.lit(hop)))
        if nxt.isEmpty():
            break
        seen = nxt if seen is None else checkpointed(seen.unionByName(nxt))
        names = nxt.select("branch", "seed", "name").distinct()
    if seen is None:
        return seeds.select("branch", F.col("name").alias("seed"), F.col("name").alias("id"), F.lit(0).alias("hop")).limit(0)
    return seen.select("branch", "seed", "id", "hop")


def summary(reached: DataFrame, risk: Column | None = None) -> DataFrame:
    """Affected nodes and risk of each seed, from hops of 1 and more."""
    out = reached.where("hop > 0").groupBy("branch", "seed").agg(F.count(F.lit(1)).alias("affected"), F.max("hop").alias("deepest"))
    return out.withColumn("risk", C.risk_callers(F.col("affected")) if risk is None else risk)


def callers_exact(g: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Callers of exact nodes with the best confidence of the edge that reached them, and their rank: TRV-3 with SRT-1.

    seeds: branch, id. Columns: branch, seed, id, hop, confidence, is_test, place.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    calls = checkpointed(g.kind("calls"))
    r = checkpointed(reach(calls, seeds.select("branch", F.col("id").alias("seed"), "id"), depth, "in"))
    prev = r.select("branch", "seed", F.col("id").alias("dst"), (F.col("hop") + 1).alias("hop"))
    hit = r.where("hop > 0").withColumnRenamed("id", "src")
    best = (
        hit.join(calls, ["branch", "src"]).join(prev, ["branch", "seed", "dst", "hop"])
        .groupBy("branch", "seed", F.col("src").alias("id"), "hop").agg(F.min(C.confidence_rank(F.col("confidence"))).alias("cr"))
    )
    n = g.nodes.select("branch", "id", "file", "qualified_name", "visibility")
    shown = best.join(n, ["branch", "id"]).withColumn("is_test", C.is_test_file(F.col("file")))
    from pyspark.sql import Window

    w = Window.partitionBy("branch", "seed", "hop").orderBy("cr", "is_test", C.visibility_rank(F.col("visibility")), "file", "qualified_name", "id")
    label = F.when(F.col("cr") == 0, "extracted").when(F.col("cr") == 1, "resolved").otherwise("inferred")
    return shown.select("branch", "seed", "id", "hop", label.alias("confidence"), "is_test", F.row_number().over(w).alias("place"))


def subgraph_nodes(g: Graph, seeds: DataFrame, depth: int = 2, direction: str = "both", most: int = B.STEPS) -> DataFrame:
    """Nodes reached from seeds (branch, id) over all kinds of edges: branch, seed, id, hop.

    Ends of edges that are no nodes are passed through and left out. Up to
    ``most`` steps are searched by bits in memory, more by joins of the frontier.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    own = checkpointed(seeds.select("branch", F.col("id").alias("seed"), "id").where("id is not null").distinct())
    e = checkpointed(g.edges.select("branch", "src", "dst").where("src is not null and dst is not null"))
    if e.count() > most:
        return reach(e, own, depth, direction).join(g.nodes.select("branch", "id"), ["branch", "id"], "left_semi").select("branch", "seed", "id", "hop")
    there = lambda df, c, node: df.select("branch", F.col(c).alias("id"), F.lit(node).alias("node"))
    u = there(g.nodes, "id", True).unionByName(there(own, "id", False)).unionByName(there(e, "src", False)).unionByName(there(e, "dst", False))
    u = B.numbered(u.where("branch is not null and id is not null").groupBy("branch", "id").agg(F.max("node").alias("node")), "x")
    at = lambda c, x: u.select("branch", F.col("id").alias(c), F.col("x").alias(x))
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    steps = e.join(at(a, "__a"), ["branch", a]).join(at(b, "__b"), ["branch", b]).select("branch", F.col("__a").alias("x"), F.col("__b").alias("y"))
    nodes = u.select("branch", "x", F.lit(None).cast("int").alias("y"), F.when(F.col("node"), F.col("id")).alias("s"))
    own = own.join(u, ["branch", "id"]).select("branch", "x", F.col("seed").alias("s"))
    return B.search(steps, nodes, own, depth, both_ways=direction == "both")


def subgraph(g: Graph, seeds: DataFrame, depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes reached over all kinds of edges, and the edges between the nodes of each seed."""
    r = checkpointed(subgraph_nodes(g, seeds, depth, direction))
    a = r.select("branch", "seed", F.col("id").alias("src"))
    b = r.select("branch", "seed", F.col("id").alias("dst"))
    e = g.edges.join(a, ["branch", "src"]).join(b, ["branch", "seed", "dst"]).select("branch", "seed", "src", "dst", "kind", "line", "confidence")
    return r, e


RELATIONS = {
    ("calls", "out"): "calls", ("calls", "in"): "called_by", ("uses", "out"): "uses", ("uses", "in"): "used_by", ("implements", "out"): "implements",
    ("implements", "in"): "implemented_by", ("imports", "out"): "imports", ("imports", "in"): "imported_by", ("contains", "out"): "contains", ("contains", "in"): "contained_by",
    ("inherits", "out"): "inherits", ("inherits", "in"): "inherited_by", ("references", "out"): "references", ("references", "in"): "referenced_by",
}
RELATION_RANKS = {
    "called_by": 0, "calls": 0, "used_by": 1, "uses": 1, "implemented_by": 2, "implements": 2, "inherited_by": 2, "inherits": 2,
    "imported_by": 3, "imports": 3, "contained_by": 4, "contains": 4,
}


def relations(g: Graph, seeds: DataFrame) -> DataFrame:
    """Direct relations of seeds (branch, id) with code nodes, one for each label and other node, ranked.

    Columns: branch, seed, relation, other_id, confidence, is_test, place. Of
    several edges behind one relation the best confidence stands.
    """
    s = seeds.select(F.col("branch").alias("sb"), F.col("id").alias("seed"))
    out = g.edges.join(s, (F.col("branch") == F.col("sb")) & (F.col("src") == F.col("seed"))).select(
        "branch", "seed", F.lit("out").alias("dir"), F.col("dst").alias("other_id"), "kind", "confidence"
    )
    into = g.edges.join(s, (F.col("branch") == F.col("sb")) & (F.col("dst") == F.col("seed")) & (F.col("src") != F.col("dst"))).select(
        "branch", "seed", F.lit("in").alias("dir"), F.col("src").alias("other_id"), "kind", "confidence"
    )
    label = F.lit("related")
    for (k, d), name in RELATIONS.items():
        label = F.when((F.col("kind") == k) & (F.col("dir") == d), name).otherwise(label)
    n = g.nodes.where(C.is_code(F.col("kind"))).select("branch", F.col("id").alias("other_id"), "file", "qualified_name")
    r = (
        out.unionByName(into).withColumn("relation", label).groupBy("branch", "seed", "relation", "other_id")
        .agg(F.min(C.confidence_rank(F.col("confidence"))).alias("cr")).join(n, ["branch", "other_id"])
        .withColumn("is_test", C.is_test_file(F.col("file")))
    )
    from pyspark.sql import Window

    w = Window.partitionBy("branch", "seed").orderBy(C.case(F.col("relation"), RELATION_RANKS, 5), "cr", "is_test", "file", "qualified_name", "relation", "other_id")
    conf = F.when(F.col("cr") == 0, "extracted").when(F.col("cr") == 1, "resolved").otherwise("inferred")
    return r.select("branch", "seed", "relation", "other_id", conf.alias("confidence"), "is_test", F.row_number().over(w).alias("place"))


def call_paths(g: Graph, pairs: DataFrame, max_hops: int = TRACE_MAX_HOPS) -> DataFrame:
    """Shortest call path by names for pairs (branch, from_name, to_name): branch, from_name, to_name, hops, path.

    Of several shortest paths the smallest by order of names stands. A pair of
    equal names has a path only through a cycle. No path: no row. The search
    runs once for each source, whatever the number of its targets, and keeps
    one path for each source and name. A source ends when all its targets are
    found; the last hop goes to targets only.
    """
    n = g.nodes.select("branch", "id", "name")
    e = g.kind("calls").select("branch", "src", "dst")
    step = checkpointed(
        e.join(n.select("branch", F.col("id").alias("src"), F.col("name").alias("a")), ["branch", "src"])
        .join(n.select("branch", F.col("id").alias("dst"), F.col("name").alias("b")), ["branch", "dst"]).select("branch", "a", "b").distinct()
    )
    source, key = ["branch", "from_name"], ["branch", "from_name", "to_name"]
    open_ = checkpointed(pairs.select(*key).distinct())
    targets = open_.select("branch", F.col("to_name").alias("b")).distinct()
    front = open_.select(*source).distinct().select(*source, F.col("from_name").alias("at"), F.array("from_name").alias("path"))
    seen: DataFrame | None = None
    found = open_.limit(0).select(*key, F.lit(0).alias("hops"), F.array("from_name").alias("path"))
    for hop in range(1, max_hops + 1):
        f = front.withColumnRenamed("branch", "fb")
        s = step if hop < max_hops else step.join(targets, ["branch", "b"], "left_semi")
        nxt = (
            s.join(f, (F.col("branch") == F.col("fb")) & (F.col("a") == F.col("at")))
            .groupBy(*source, F.col("b").alias("at")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        )
        nxt = checkpointed(nxt if seen is None else nxt.join(seen, [*source, "at"], "left_anti"))
        if nxt.isEmpty():
            break
        hit = nxt.withColumnRenamed("at", "to_name").join(open_, key, "left_semi").select(*key, F.lit(hop).alias("hops"), "path")
        hit = checkpointed(hit)
        found = found.unionByName(hit)
        open_ = checkpointed(open_.join(hit.select(*key), key, "left_anti"))
        if open_.isEmpty():
            break
        at = nxt.select(*source, "at")
        seen = at if seen is None else seen.unionByName(at)
        front = nxt.join(open_.select(*source).distinct(), source, "left_semi")
    return found


def paths_among(g: Graph, ends: DataFrame, max_hops: int = TRACE_MAX_HOPS, most: int = B.STEPS, sep: str | None = None) -> DataFrame:
    """``call_paths`` for all pairs of the names ``ends`` (branch, name) of a branch, without a row for each pair in advance.

    With ``sep`` a path is one text, joined by it. Up to ``most`` steps are
    searched in memory, more by joins of the frontier.
    """
    ends = checkpointed(ends.select("branch", "name").distinct())
    steps, nodes, names = _numbered_calls(g, "out")
    named = nodes.where("y is not null").select("branch", F.col("x").alias("y"), F.col("y").alias("to"))
    steps = checkpointed(steps.join(named, ["branch", "y"]).select("branch", "x", F.col("to").alias("y")).distinct())
    if steps.count() > most:
        pairs = ends.select("branch", F.col("name").alias("from_name")).join(ends.select("branch", F.col("name").alias("to_name")), "branch")
        found = call_paths(g, pairs, max_hops)
        return found if sep is None else found.withColumn("path", F.concat_ws(sep, "path"))
    own = ends.join(names, ["branch", "name"])
    is_end = own.select("branch", "x", F.lit(1).alias("y"))
    nodes = names.join(is_end, ["branch", "x"], "left").select("branch", "x", "y", F.col("name").alias("s"))
    return B.paths(steps, nodes, own.select("branch", "x", F.col("name").alias("s")), max_hops, sep)


def blast_radius(base: Graph, head: Graph, depth: int = 2) -> DataFrame:
    """Nodes of head that call, over at most ``depth`` hops, what head adds to base: id, hop.

    Added are ids of head that base lacks; they are excluded from the result.
    """
    h, b = head.nodes.select("id").distinct(), base.nodes.select("id").distinct()
    changed = checkpointed(h.join(b, "id", "left_anti"))
    seeds = changed.select(F.lit("*").alias("branch"), F.lit("*").alias("seed"), "id")
    calls = head.kind("calls").select(F.lit("*").alias("branch"), "src", "dst")
    r = reach(calls, seeds, depth, "in")
    return r.where("hop > 0").join(h, "id", "left_semi").select("id", "hop")


def affected_by_id(g: Graph, seeds: DataFrame, depth: int = MAX_DEPTH, most: int = 500) -> DataFrame:
    """Reverse call reach with the number affected, whether more than ``most`` were, and the risk: branch, seed, affected, truncated, risk."""
    r = reach(g.kind("calls"), seeds.select("branch", F.col("id").alias("seed"), "id"), min(depth, MAX_DEPTH), "in")
    n = r.where("hop > 0").groupBy("branch", "seed").agg(F.count(F.lit(1)).alias("all"))
    shown = F.least("all", F.lit(most))
    return n.select("branch", "seed", shown.alias("affected"), (F.col("all") > most).alias("truncated"), C.risk_by_id(shown).alias("risk"))


def seeded_tour(g: Graph, seeds: DataFrame, limit: int = 6) -> DataFrame:
    """Steps of a walk along calls from seeds (branch, id), by hop and qualified name: branch, seed, step, id, hop."""
    r = reach(g.kind("calls"), seeds.select("branch", F.col("id").alias("seed"), "id"), MAX_DEPTH, "out")
    from pyspark.sql import Window

    n = g.nodes.select("branch", "id", "qualified_name")
    w = Window.partitionBy("branch", "seed").orderBy("hop", "qualified_name", "id")
    return r.join(n, ["branch", "id"]).withColumn("step", F.row_number().over(w)).where(F.col("step") <= min(limit, 20)).select("branch", "seed", "step", "id", "hop")


def resolve_symbol(g: Graph, query: str, candidates: int = 5) -> tuple[str, list[dict]]:
    """('exact' | 'ambiguous' | 'not_found', rows): an exact name among code nodes; qualified names first if the query looks like one."""
    code = g.nodes.where(C.is_code(F.col("kind")))
    shown = ["id", "name", "qualified_name", "kind", "file", "start_line"]
    order = [C.is_test_file(F.col("file")), C.visibility_rank(F.col("visibility")), F.col("file"), F.col("qualified_name"), F.col("id")]
    if "::" in query or "." in query:
        rows = code.where(F.lower("qualified_name") == query.lower()).orderBy(*order).select(*shown).limit(candidates + 1).collect()
        if rows:
            return ("exact" if len(rows) == 1 else "ambiguous"), [r.asDict() for r in rows[:candidates]]
    rows = code.where(F.col("name") == query).orderBy(*order).select(*shown).limit(candidates + 1).collect()
    if rows:
        return ("exact" if len(rows) == 1 else "ambiguous"), [r.asDict() for r in rows[:candidates]]
    from weftgraph.operators.search import lexical

    near = lexical(code, query, candidates).select(*shown).collect()
    return "not_found", [r.asDict() for r in near]


def resolve_names(g: Graph) -> DataFrame:
    """``resolve_symbol`` for every name among code nodes: branch, name, status ('exact' or 'ambiguous'), candidates, id of the first.

    The best is the minimum of a struct, which combines on the map side.
    """
    n = g.nodes.where(C.is_code(F.col("kind")) & F.col("name").isNotNull())
    best = F.min(F.struct(C.is_test_file(F.col("file")).alias("t"), C.visibility_rank(F.col("visibility")).alias("v"), "file", "qualified_name", "id"))
    out = n.groupBy("branch", "name").agg(F.count(F.lit(1)).alias("candidates"), best["id"].alias("id"))
    return out.select("branch", "name", F.when(F.col("candidates") == 1, "exact").otherwise("ambiguous").alias("status"), "candidates", "id")


def name_seeds(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The node from which a subgraph by name (branch, name) starts: one that is no section before one that is, then the first by file and id."""
    n = nodes.join(names.select("branch", "name").distinct(), ["branch", "name"], "left_semi")
    best = F.min(F.struct((F.col("kind") == "section").alias("s"), "file", "id"))
    return n.groupBy("branch", "name").agg(best["id"].alias("id"))


def change_risk(base: Graph, head: Graph, depth: int = 2) -> DataFrame:
    """What a branch changes against another, in one row: changed and affected nodes and the risk by their number."""
    new = head.nodes.select("id").distinct().join(base.nodes.select("id").distinct(), "id", "left_anti").select(F.lit(1).alias("c"), F.lit(0).alias("a"))
    hit = blast_radius(base, head, depth).select(F.lit(0).alias("c"), F.lit(1).alias("a"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    n = new.unionByName(hit).agg(zero("c").alias("changed"), zero("a").alias("affected"))
    return n.withColumn("risk", C.risk_changes(F.col("affected")))


def induced_nodes_edges(g: Graph, ids: DataFrame) -> Graph:
    n = g.nodes.join(ids, ["branch", "id"], "left_semi")
    return Graph(n, induced_edges(g.edges, n))
