"""One object for all queries on a graph, with the defaults and caps of the tool surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import analytics, export, lookup, resolve, search, traverse
from weftgraph.session import ship_package
from weftgraph.sources.graph import Graph


class Engine:
    """Queries on one branch of a graph."""

    def __init__(self, graph: Graph, branch: str) -> None:
        self.all, self.name = graph, branch
        self.g = graph.branch(branch)
        self.spark: SparkSession = graph.nodes.sparkSession
        ship_package(self.spark)

    def _names(self, *names: str) -> DataFrame:
        return self.spark.createDataFrame([(self.name, n) for n in names], "branch string, name string")

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(self.name, i) for i in ids], "branch string, id string")

    # lookups
    def lookup_symbol(self, name: str, fuzzy: bool = False) -> DataFrame:
        return lookup.lookup(self.g.nodes.where("kind <> 'section'"), name, fuzzy)

    def search_nodes(self, text: str, limit: int = 10) -> DataFrame:
        return lookup.search_nodes(self.g.nodes, text, max(500, 50 * limit))

    def ast_search(self, limit: int = 30, **filters: object) -> DataFrame:
        return lookup.search_by_attributes(self.g.nodes, limit, **filters)

    def list_definitions(self, file: str) -> DataFrame:
        return lookup.definitions_in_file(self.g.nodes, file)

    def list_symbols_in_range(self, file: str, start: int, end: int) -> DataFrame:
        return lookup.symbols_in_range(self.g.nodes, file, start, end)

    # relations
    def find_callers_of_name(self, name: str) -> DataFrame:
        return lookup.callers(self.g, self._names(name))

    def find_implementors(self, name: str) -> DataFrame:
        return lookup.implementors(self.g, self._names(name))

    def find_type_usages(self, name: str) -> DataFrame:
        return lookup.type_usages(self.g, self._names(name))

    def get_call_sites(self, name: str) -> DataFrame:
        return lookup.call_sites(self.g, self._names(name))

    def find_importers(self, name: str) -> DataFrame:
        return lookup.importers(self.g, self._names(name))

    def type_hierarchy(self, name: str) -> DataFrame:
        return lookup.type_hierarchy(self.g, self._names(name))

    def symbol_context(self, name: str) -> DataFrame:
        """Relations of the best definition; an unknown name is an error."""
        if self.g.nodes.where(F.col("name") == name).isEmpty():
            raise LookupError(name)
        return lookup.symbol_context(self.g, self._names(name))

    def module_dependencies(self, module: str) -> DataFrame:
        return lookup.module_dependencies(self.g).where(F.col("module") == module)

    def find_unused_symbols(self, kind: str | None = None, limit: int = 30) -> DataFrame:
        return lookup.unused_symbols(self.g, kind).orderBy("file", "start_line", "id").limit(min(limit, 200))

    # traversals
    def find_callers(self, query: str, depth: int = 1, limit: int = 25, tokens: int = 600) -> tuple[str, list[dict], DataFrame | None]:
        """(status, candidates, ranked callers): an ambiguous or unknown query gives candidates and no traversal."""
        status, rows = traverse.resolve_symbol(self.g, query)
        if status != "exact":
            return status, rows, None
        ranked = traverse.callers_exact(self.g, self._ids(rows[0]["id"]), depth).orderBy("hop", "place").limit(min(limit, 100))
        return status, rows, search.within_budget(ranked, ["branch"], [F.col("hop"), F.col("place")], tokens)

    pre_edit_impact = find_callers

    def find_callees(self, name: str, depth: int = 1) -> DataFrame:
        return traverse.reach_by_name(self.g, self._names(name), depth, "out")

    def callers_deep(self, name: str, depth: int = 5) -> DataFrame:
        return traverse.reach_by_name(self.g, self._names(name), depth, "in")

    def get_subgraph(self, query: str, limit: int = 20, tokens: int = 400) -> tuple[str, list[dict], DataFrame | None]:
        status, rows = traverse.resolve_symbol(self.g, query)
        if status != "exact":
            return status, rows, None
        r = traverse.relations(self.g, self._ids(rows[0]["id"])).orderBy("place").limit(min(limit, 100))
        return status, rows, search.within_budget(r, ["branch"], [F.col("place")], tokens)

    def trace_path(self, start: str, goal: str) -> list[str]:
        pairs = self.spark.createDataFrame([(self.name, start, goal)], "branch string, from_name string, to_name string")
        rows = traverse.call_paths(self.g, pairs).collect()
        return list(rows[0]["path"]) if rows else []

    def neighbourhood(self, node_id: str, direction: str = "both", limit: int = 500) -> DataFrame:
        return lookup.neighbourhood(self.g, self._ids(node_id), direction, limit)

    def branch_diff(self, other: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges that this branch adds to and removes from another."""
        base = self.all.branch(other)
        return resolve.diff_nodes(base.nodes, self.g.nodes), resolve.diff_edges(base.edges, self.g.edges)

    def blast_radius(self, base: str, depth: int = 2) -> DataFrame:
        return traverse.blast_radius(self.all.branch(base), self.g, depth)

    def detect_changes(self, hunks: DataFrame) -> DataFrame:
        return lookup.changed_symbols(self.g.nodes, hunks)

    # analytics
    def graph_stats(self) -> DataFrame:
        return analytics.graph_stats(self.g)

    def find_god_nodes(self, least: int = 10, limit: int = 20) -> DataFrame:
        return analytics.hubs(self.g, least, limit)

    def find_clusters(self, least: int = 3, limit: int = 20, exact: bool = False) -> DataFrame:
        labels = analytics.sequential_clusters(self.g) if exact else analytics.label_propagation(self.g)
        return analytics.cluster_report(self.g, labels, least).orderBy(F.desc("size"), "label").limit(min(limit, 100))

    def find_cycles(self) -> DataFrame:
        return analytics.import_cycles(self.g)

    def health_report(self) -> DataFrame:
        return analytics.health(self.g)

    def start_tour(self, seed: str | None = None, limit: int = 6) -> DataFrame:
        """Steps from the most called node of a name, or over the branch."""
        if seed is None:
            return analytics.global_tour(self.g, limit)
        best = analytics.in_degrees(self.g).join(self.g.nodes.where(F.col("name") == seed).select("branch", "id"), ["branch", "id"], "right")
        first = best.orderBy(F.coalesce("in_degree", F.lit(0)).desc(), "id").select("branch", "id").limit(1)
        return traverse.seeded_tour(self.g, first, limit)

    def search_code(self, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
        if index is None:
            return search.search_envelope(search.lexical(self.g.nodes, query, limit))
        return search.hybrid(self.g.nodes, index, query, limit)

    def wiki_symbol(self, node_id: str) -> str:
        return export.wiki_page(self.g, node_id)
