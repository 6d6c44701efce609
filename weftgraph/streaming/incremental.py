"""Structured Streaming: incremental indexing and windows over event streams."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.resolve import apply_diff
from weftgraph.schema import EDGES, INDEX_STATE, NODES, REFS, SCHEMA_VERSION
from weftgraph.sources.graph import Graph


def write_state(spark: SparkSession, path: str, branch: str, sha: str) -> None:
    """Records the last indexed commit of a branch, after everything else was written."""
    spark.createDataFrame([(branch, sha, SCHEMA_VERSION)], INDEX_STATE).coalesce(1).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def last_indexed(spark: SparkSession, path: str, branch: str) -> str | None:
    """The last recorded commit of a branch; None if nothing was recorded. A state of another schema version, or one that cannot be read, is an error."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(INDEX_STATE).parquet(path).where(F.col("branch") == branch)
    found = rows.withColumn("m", F.col("_metadata.file_modification_time")).orderBy(F.desc("m")).limit(1).collect()
    if found and found[0]["schema_version"] != SCHEMA_VERSION:
        raise ValueError("the index has another schema version; rebuild it")
    return found[0]["last_indexed_sha"] if found else None


def swap(tables: dict[str, DataFrame], partition: str | None = None) -> None:
    """Replaces tables by path: all are written beside the old ones first, then renamed.

    A failed write leaves the old tables, and frames that read an old table
    are done with it before any is renamed.
    """
    for path, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(f"{path}.staged")
    for path, df in tables.items():
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        new, now, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.staged", path, f"{path}.old"))
        fs = now.getFileSystem(conf)
        fs.delete(old, True)
        if fs.exists(now):
            fs.rename(now, old)
        fs.rename(new, now)
        fs.delete(old, True)


class GraphStore:
    """A graph as Parquet tables partitioned by branch, and its updates."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def full_load(self, g: Graph, refs: DataFrame | None = None) -> None:
        """Nodes by id, edges by (src, dst, kind) with both ends, references: written partitioned by branch."""
        nodes = g.nodes.dropDuplicates(["branch", "id"])
        edges = Graph(nodes, g.edges.dropDuplicates(["branch", "src", "dst", "kind"])).valid_edges()
        nodes.write.mode("overwrite").partitionBy("branch").parquet(self.path("nodes"))
        edges.write.mode("overwrite").partitionBy("branch").parquet(self.path("edges"))
        if refs is not None:
            refs.write.mode("overwrite").partitionBy("branch").parquet(self.path("refs"))

    def read(self) -> Graph:
        return Graph(self.spark.read.schema(NODES).parquet(self.path("nodes")), self.spark.read.schema(EDGES).parquet(self.path("edges")))

    def refs(self) -> DataFrame | None:
        return self.spark.read.schema(REFS).parquet(self.path("refs")) if exists(self.spark, self.path("refs")) else None

    def apply(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, refs: DataFrame | None = None) -> None:
        """Replaces all nodes of changed files (branch, file) and resolves references anew, then swaps the folders of the branches that changed.

        Other branches are neither read nor written.
        """
        touched = sorted(r[0] for r in files.select("branch").union(nodes.select("branch")).distinct().collect())  # a batch touches few branches
        mine = F.col("branch").isin(touched)
        old = self.refs()
        every = old = None if old is None else old.where(mine)
        if refs is not None:
            gone = files.select("branch", F.col("file").alias("src_file"))
            every = refs if old is None else old.join(gone, ["branch", "src_file"], "left_anti").select(refs.columns).unionByName(refs)
        now = self.read()
        g = apply_diff(Graph(now.nodes.where(mine), now.edges.where(mine)), nodes, files, edges, every)
        tables = {"nodes": g.nodes, "edges": g.edges}
        if every is not None and refs is not None:
            tables["refs"] = every
        self.replace(tables, touched)

    def _folder(self, table: str, branch: str):
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/branch={escape(branch)}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def replace(self, tables: dict[str, DataFrame], branches: list[str]) -> None:
        """Puts new rows in the place of those of some branches: all are staged first, then each branch's folder is renamed."""
        for t, df in tables.items():
            df.write.mode("overwrite").partitionBy("branch").parquet(f"{self.path(t)}.staged")
        for t in tables:
            for b in branches:
                (new, fs), (here, _) = self._folder(f"{t}.staged", b), self._folder(t, b)
                fs.mkdirs(here.getParent())
                fs.delete(here, True)
                if fs.exists(new):
                    fs.rename(new, here)
            fs.delete(new.getParent(), True)

    def wipe(self, branch: str, state: str | None = None) -> None:
        """Drops one branch: its nodes, edges and references, and its index state at ``state``."""
        for t in ("nodes", "edges", "refs"):
            here, fs = self._folder(t, branch)
            fs.delete(here, True)
        if state is not None and exists(self.spark, state):
            swap({state: self.spark.read.schema(INDEX_STATE).parquet(state).where(F.col("branch") != branch)})


Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def apply_changes(changes: DataFrame, parse: Parse, store: GraphStore) -> None:
    """Indexes changed files (branch, path, change, source_text), committed or not."""
    df = changes.persist()
    try:
        if df.isEmpty():
            return
        files = df.select("branch", F.col("path").alias("file")).distinct()
        nodes, edges, refs = parse(df.where("change <> 'Deleted'"))
        store.apply(nodes, edges, files, refs)
    finally:
        df.unpersist()


def update(store: GraphStore, state: str, branch: str, head: str, changes: Callable[[str | None], DataFrame], parse: Parse) -> bool:
    """Brings the index of a branch from the last recorded commit to ``head``; False if it is there already.

    ``changes`` gives the files (branch, path, change, source_text) that differ
    between a commit, or nothing, and ``head``. The commit is recorded last, so
    a run that fails is done again.
    """
    last = last_indexed(store.spark, state, branch)
    if last == head:
        return False
    apply_changes(changes(last), parse, store)
    write_state(store.spark, state, branch, head)
    return True


def index_stream(changes: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], store: GraphStore, checkpoint: str):
    """A streaming query that indexes changed files as they arrive.

    changes: branch, path, change, source_text. ``parse`` turns a batch of
    files into nodes, edges and references. Every batch replaces its files'
    nodes; a batch that runs again after a failure gives the same tables.
    """

    def batch(df: DataFrame, _: int) -> None:
        apply_changes(df, parse, store)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of file events (path, ts) that end with a quiet time: path, started, ended, n."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("s"), "path").agg(F.count(F.lit(1)).alias("n"))
        .select("path", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")
    )


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and sums of value by window and type. Works on streams and on tables."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late).groupBy(win.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One event for each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: user_id, started, n."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("started"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet and reads the result."""
    if mode == "complete":  # files can only be appended to; each batch stands for all before it
        w = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    else:
        w = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stale(indexed: str | None, head: str, dirty: int = 0) -> str | None:
    """A warning where an index lags behind its tree, else None."""
    if indexed == head and not dirty:
        return None
    return f"index at {indexed or 'nothing'}, tree at {head}" + (f", {dirty} files changed" if dirty else "")
