"""The code graph as two DataFrames, and the scans over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The stored texts of a node; only loads that ask for them read them.
TEXTS = ("def_signature", "def_body", "def_doc")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Of rows delivered again for a (branch, id), the latest stands. Rows without an id are left out.

    Rows delivered at the same time are told apart by name, lines, size and
    complexity and then by their stored texts, if these are there; so the
    choice does not depend on order, and is the same with and without texts.
    """
    told = [c for c in ("name", "qualified_name", "file", "start_line", "end_line", "loc", "complexity", *TEXTS) if c in nodes.columns]
    w = Window.partitionBy("branch", "id").orderBy(F.col("indexed_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in told])
    return nodes.where("id is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def current_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (branch, src, dst, kind): the first seen; then the lower line and confidence. Null ends are left out.

    The minimum of a struct combines on the map side, so a dst with any share
    of all rows sends one row for each caller and task.
    """
    first = F.min(F.struct("seen_at", "loaded_at", F.col("line").isNull().alias("no_line"), "line", F.col("confidence").isNull().alias("no_conf"), "confidence"))
    return (
        edges.where("src is not null and dst is not null").groupBy("branch", "src", "dst", "kind").agg(first.alias("f"))
        .select("branch", "src", "dst", "kind", F.col("f.line").alias("line"), F.col("f.confidence").alias("confidence"))
    )


@dataclass
class Graph:
    """nodes: one row for each (branch, id). edges: one for each (branch, src, dst, kind)."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str, texts: bool = False) -> Graph:
        """The graph of the tables in a folder. Signatures, bodies and documentation are read only if ``texts`` are wanted."""
        nodes = spark.read.parquet(f"{path}/nodes.parquet")
        return Graph(current_nodes(nodes if texts else nodes.drop(*TEXTS)), current_edges(spark.read.parquet(f"{path}/edges.parquet")))

    def branch(self, name: str) -> Graph:
        """The graph of one branch; the filter reaches the scans."""
        return Graph(self.nodes.where(F.col("branch") == name), self.edges.where(F.col("branch") == name))

    def kind(self, *kinds: str) -> DataFrame:
        """Edges of some kinds, filtered at the scan."""
        return self.edges.where(F.col("kind").isin(*kinds))

    def valid_edges(self) -> DataFrame:
        """Edges with both ends among the nodes."""
        return induced_edges(self.edges, self.nodes)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in a set of (branch, id)."""
    ids = nodes.select("branch", "id")
    return (
        edges.join(ids.withColumnRenamed("id", "src"), ["branch", "src"], "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), ["branch", "dst"], "left_semi").select(edges.columns)
    )


def nodes_page(nodes: DataFrame, offset: int, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """A page in order of branch and id. ``after`` is the last key of the page before: the filter reaches the scan, and only the first rows of each task are sorted."""
    if after is not None:
        nodes = nodes.where((F.col("branch") > after[0]) | (F.col("branch") == after[0]) & (F.col("id") > after[1]))
    return nodes.orderBy("branch", "id").offset(offset).limit(limit)


def edges_page(edges: DataFrame, offset: int, limit: int) -> DataFrame:
    return edges.orderBy("branch", "src", "dst", "kind", "line").offset(offset).limit(limit)


def branch_list(nodes: DataFrame) -> DataFrame:
    return nodes.select("branch").distinct()
