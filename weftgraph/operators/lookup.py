"""Symbol lookups, filters and one-hop relations, for one name or for all names at once.

The relations take ``targets`` (branch, name), or no targets for every name;
they are plain equi-joins, so the optimizer picks the strategy and adaptive
execution splits hot symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.schema import NODE_KINDS, STRUCTURAL_KINDS, VISIBILITIES
from weftgraph.sources.graph import Graph

SHOWN = ["branch", "id", "kind", "name", "qualified_name", "file", "start_line"]


def lookup(nodes: DataFrame, name: str, fuzzy: bool = False) -> DataFrame:
    """Nodes of a name, or whose name contains it (case matters), definitions first."""
    hit = F.col("name").contains(name) if fuzzy else F.col("name") == name
    return nodes.where(hit).orderBy(C.symbol_rank(F.col("kind")), "start_line", "id")


def search_nodes(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name or qualified name contains a text, case ignored, in a fixed order."""
    low = text.lower()
    found = nodes.where(F.lower("name").contains(low) | F.lower("qualified_name").contains(low))
    return found if limit is None else found.orderBy("qualified_name", "branch", "id").limit(limit)


def attribute_filter(
    kind: str | None = None, is_async: bool | None = None, visibility: str | None = None, min_complexity: int | None = None,
    max_complexity: int | None = None, name_contains: str | None = None, annotation: str | None = None,
) -> Column:
    """The conjunction of the given predicates. Unknown kinds and visibilities and an empty filter are errors.

    A null complexity never matches a bound.
    """
    if kind is not None and kind not in NODE_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if visibility is not None and visibility not in VISIBILITIES:
        raise ValueError(f"unknown visibility {visibility!r}")
    parts: list[Column] = []
    if kind is not None:
        parts.append(F.col("kind") == kind)
    if is_async is not None:
        parts.append(F.coalesce("is_async", F.lit(False)) == is_async)
    if visibility is not None:
        parts.append(F.coalesce("visibility", F.lit("private")) == visibility)
    if min_complexity is not None:
        parts.append(F.col("complexity") >= min_complexity)
    if max_complexity is not None:
        parts.append(F.col("complexity") <= max_complexity)
    if name_contains is not None:
        parts.append(F.lower("name").contains(name_contains.lower()))
    if annotation is not None:
        parts.append(F.exists("annotations", lambda x: F.lower(x).contains(annotation.lower())))
    if not parts:
        raise ValueError("the filter is empty")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def search_by_attributes(nodes: DataFrame, limit: int | None = None, **filters: object) -> DataFrame:
    found = nodes.where(attribute_filter(**filters))  # type: ignore[arg-type]
    return found if limit is None else found.orderBy("branch", "file", "start_line", "id").limit(min(limit, 200))


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of a set of (branch, id); missing ids are skipped."""
    return nodes.join(ids, ["branch", "id"], "left_semi")


def definitions_in_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file).orderBy("start_line", "id")


def overlaps(start: Column, end: Column) -> Column:
    return (F.col("start_line") <= end) & (F.col("end_line") >= start)


def symbols_in_range(nodes: DataFrame, file: str, start: int, end: int) -> DataFrame:
    return nodes.where((F.col("file") == file) & overlaps(F.lit(start), F.lit(end))).orderBy("start_line", "id")


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines overlap changed ranges: hunks (branch, file, h_start, h_end). Each symbol once.

    An equi-join on the file with the ranges as residual predicate.
    """
    h = hunks.select(F.col("branch").alias("hb"), F.col("file").alias("hf"), "h_start", "h_end")
    return (
        nodes.where(~F.col("kind").isin(STRUCTURAL_KINDS))
        .join(h, (F.col("branch") == F.col("hb")) & (F.col("file") == F.col("hf")) & overlaps(F.col("h_start"), F.col("h_end")), "left_semi")
    )


def _named(g: Graph, targets: DataFrame | None) -> DataFrame:
    t = g.nodes.select("branch", F.col("id").alias("dst"), F.col("name").alias("target"))
    if targets is not None:
        t = t.join(targets.select("branch", F.col("name").alias("target")), ["branch", "target"], "left_semi").select("branch", "dst", "target")
    return t


def _sources(g: Graph, kinds: list[str], targets: DataFrame | None, extra: list[str]) -> DataFrame:
    e = g.kind(*kinds).select("branch", "src", "dst", *extra)
    n = g.nodes.select("branch", F.col("id").alias("src"), "kind", "name", "qualified_name", "file", "start_line", "visibility")
    return e.join(_named(g, targets), ["branch", "dst"]).join(n, ["branch", "src"])


def callers(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """Distinct callers of all nodes of a name: branch, target, id and what is shown of a node."""
    return _sources(g, ["calls"], targets, []).select("branch", "target", F.col("src").alias("id"), *SHOWN[2:]).distinct()


def callers_with_confidence(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """One row for each calling edge, with its confidence."""
    return _sources(g, ["calls"], targets, ["confidence"]).select("branch", "target", F.col("src").alias("id"), "dst", "confidence")


def callers_by_id(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """Callers of exact nodes (branch, id): branch, dst, id, confidence, name."""
    e = g.kind("calls")
    if ids is not None:
        e = e.join(ids.select("branch", F.col("id").alias("dst")), ["branch", "dst"], "left_semi")
    n = g.nodes.select("branch", F.col("id").alias("src"), "name")
    return e.join(n, ["branch", "src"]).select("branch", "dst", F.col("src").alias("id"), "confidence", "name")


def implementors(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    return _sources(g, ["implements", "inherits"], targets, []).select("branch", "target", F.col("src").alias("id"), *SHOWN[2:]).distinct()


def type_usages(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    return _sources(g, ["uses"], targets, []).select("branch", "target", F.col("src").alias("id"), *SHOWN[2:]).distinct()


def call_sites(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """Caller and line of each calling edge."""
    return _sources(g, ["calls"], targets, ["line"]).select("branch", "target", F.col("src").alias("id"), "dst", "name", "line")


def importers(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    return _sources(g, ["imports"], targets, []).select("branch", "target", F.col("src").alias("id"), *SHOWN[2:]).distinct()


def type_hierarchy(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """Super- and subtypes one step away: branch, target, direction, id, name."""
    e = g.kind("implements", "inherits").select("branch", "src", "dst")
    named = _named(g, targets)
    other = g.nodes.select("branch", "id", "name")
    down = e.join(named, ["branch", "dst"]).select("branch", "target", F.lit("subtype").alias("direction"), F.col("src").alias("id"))
    up = e.join(named.withColumnRenamed("dst", "src"), ["branch", "src"]).select("branch", "target", F.lit("supertype").alias("direction"), F.col("dst").alias("id"))
    return down.unionByName(up).distinct().join(other, ["branch", "id"]).select("branch", "target", "direction", "id", "name")


def best_definition(nodes: DataFrame) -> DataFrame:
    """The best-ranked definition of each (branch, name): one row each, by a minimum that combines on the map side."""
    key = F.struct(C.symbol_rank(F.col("kind")).alias("r"), F.coalesce("start_line", F.lit(2**31 - 1)).alias("l"), "id")
    return nodes.where("name is not null").groupBy("branch", "name").agg(F.min(key)["id"].alias("id"))


def symbol_context(g: Graph, targets: DataFrame | None = None) -> DataFrame:
    """Callers (distinct), callees and users of the best definition of each name: branch, name, role, other_id, n."""
    best = best_definition(g.nodes)
    if targets is not None:
        best = best.join(targets.select("branch", "name"), ["branch", "name"], "left_semi")
    ids = g.nodes.select("branch", F.col("id").alias("other_id"))
    e = g.edges.where(F.col("kind").isin("calls", "uses")).select("branch", "src", "dst", "kind")
    inward = e.join(best.withColumnRenamed("id", "dst"), ["branch", "dst"]).select(
        "branch", "name", F.when(F.col("kind") == "calls", "caller").otherwise("used_by").alias("role"), F.col("src").alias("other_id")
    )
    outward = e.where("kind = 'calls'").join(best.withColumnRenamed("id", "src"), ["branch", "src"]).select(
        "branch", "name", F.lit("callee").alias("role"), F.col("dst").alias("other_id")
    )
    return inward.unionByName(outward).join(ids, ["branch", "other_id"]).select("branch", "name", "role", "other_id").distinct()


def module_dependencies(g: Graph) -> DataFrame:
    """Modules that a module imports from, found by the files of the imported symbols; never itself. branch, module, depends_on."""
    n = g.nodes
    mod = n.where("kind = 'module'").select("branch", F.col("id").alias("src"), F.col("name").alias("module"), F.col("file").alias("own"))
    sym = n.select("branch", F.col("id").alias("dst"), F.col("file").alias("far"))
    far = n.where("kind = 'module'").select("branch", F.col("file").alias("far"), F.col("id").alias("depends_on_id"), F.col("name").alias("depends_on"))
    e = g.kind("imports").select("branch", "src", "dst")
    return (
        e.join(mod, ["branch", "src"]).join(sym, ["branch", "dst"]).where("own <> far").select("branch", "module", "far").distinct()
        .join(far, ["branch", "far"]).select("branch", "module", "depends_on_id", "depends_on").distinct()
    )


def unused_symbols(g: Graph, kind: str | None = None) -> DataFrame:
    """Nodes that nothing calls or uses, without files, folders and modules."""
    used = g.kind("calls", "uses").select("branch", F.col("dst").alias("id"))
    n = g.nodes.where(~F.col("kind").isin(STRUCTURAL_KINDS))
    if kind is not None:
        n = n.where(F.col("kind") == kind)
    return n.join(used, ["branch", "id"], "left_anti")


def neighbourhood(g: Graph, seeds: DataFrame, direction: str = "both", limit: int | None = 500) -> DataFrame:
    """Edges that touch seeds (branch, id); an unknown direction means both."""
    s = seeds.select("branch", F.col("id").alias("__s"))
    out = g.edges.join(s.withColumnRenamed("__s", "src"), ["branch", "src"], "left_semi").select(g.edges.columns)
    into = g.edges.join(s.withColumnRenamed("__s", "dst"), ["branch", "dst"], "left_semi").select(g.edges.columns)
    e = out if direction == "out" else into if direction == "in" else out.unionByName(into).distinct()
    return e if limit is None else e.orderBy("branch", "kind", "src", "dst", "line").limit(min(limit, 5000))


def dense_view(g: Graph, mode: str = "connected") -> Graph:
    """Nodes to draw: 'all', 'pub' (public only) or 'connected' (with a semantic edge); edges between them."""
    from weftgraph.sources.graph import induced_edges

    n = g.nodes
    if mode == "pub":
        n = n.where("visibility = 'pub'")
    elif mode == "connected":
        e = g.kind("calls", "implements", "inherits", "uses", "throws")
        ends = e.select("branch", F.col("src").alias("id")).unionByName(e.select("branch", F.col("dst").alias("id")))
        n = n.where(~F.col("kind").isin(STRUCTURAL_KINDS)).join(ends, ["branch", "id"], "left_semi")
    return Graph(n, induced_edges(g.edges, n))


def view(
    g: Graph, hide_kinds: tuple[str, ...] = (), hide_visibilities: tuple[str, ...] = (), hide_edge_kinds: tuple[str, ...] = (),
    hide_confidences: tuple[str, ...] = (), only_async: bool = False, only_unsafe: bool = False,
) -> Graph:
    """Hides kinds, visibilities, edge kinds and confidences; the async and unsafe marks are joined by OR."""
    from weftgraph.sources.graph import induced_edges

    n = g.nodes.where(~F.col("kind").isin(*hide_kinds) if hide_kinds else F.lit(True))
    if hide_visibilities:
        n = n.where(~F.coalesce("visibility", F.lit("private")).isin(*hide_visibilities))
    if only_async or only_unsafe:
        n = n.where((F.col("is_async") if only_async else F.lit(False)) | (F.col("is_unsafe") if only_unsafe else F.lit(False)))
    e = g.edges
    if hide_edge_kinds:
        e = e.where(~F.col("kind").isin(*hide_edge_kinds))
    if hide_confidences:
        e = e.where(~F.coalesce("confidence", F.lit("extracted")).isin(*hide_confidences))
    return Graph(n, induced_edges(e, n))
