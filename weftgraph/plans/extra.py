"""Queries on streams of events, parsed sources and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import export as X
from weftgraph.operators import search as S
from weftgraph.operators.snapshots import row_digests
from weftgraph.plans.graph import _BASE, _RANK, _lex
from weftgraph.session import ensure_checkpoint_dir
from weftgraph.sources import files as FS
from weftgraph.sources import parsers as P
from weftgraph.sources.graph import Graph
from weftgraph.streaming import incremental as I


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return I.windowed_counts(_events(spark, sf)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return I.sessions(_events(spark, sf), "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows by a stream over all events that are there; the last windows, too, as the stream is complete."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    one = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet*")
    one = one.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    out = I.run_to_table(I.windowed_counts(one), f"{base}/out", f"{base}/state", "complete")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return I.deduplicated(_events(spark, sf), ["user_id", "event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    latest = F.max_by("source_text", F.struct("parsed_at", "source_text"))
    return spark.read.parquet(f"{sf}/source_files.parquet").groupBy("branch", "repo", "file").agg(latest.alias("source_text")).select("branch", F.concat_ws("/", "repo", "file").alias("path"), "source_text")


def parsed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations of all source files."""
    n, _, _ = P.split_parsed(P.parse_files(_sources(spark, sf)))
    return n.select("branch", "id", "kind", "name", "qualified_name", "file", "start_line", "complexity")


def built_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The whole graph of all source files, as edges."""
    return P.build(_sources(spark, sf))[1]


def source_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between the files of the branches 'release/3' and 'main' of the archived nodes, by digest of all they declare in the last snapshot of each.

    Of several rows for an id within the snapshot the one loaded last stands;
    of several loaded at once, the one with the greatest digest.
    """
    s = spark.read.parquet(f"{sf}/node_snapshots.parquet").where("id is not null")
    s = s.withColumn("digest", row_digests(s, ["branch", "snap_no"], ["annotations"], ["loaded_at"]))
    half = lambda i: F.conv(F.substring("digest", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")

    def of(b: str) -> DataFrame:
        rows = s.where(F.col("branch") == b)
        last = rows.join(rows.agg(F.max("snap_no").alias("snap_no")), "snap_no")
        one = last.groupBy("id").agg(F.max(F.struct("loaded_at", "digest", "file")).alias("r")).select("r.digest", F.col("r.file").alias("path")).where("path is not null")
        return one.groupBy("path").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(half(0)).alias("a"), F.sum(half(1)).alias("b")).alias("blob"))

    return FS.manifest_changes(of("release/3"), of("main"))


def top_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_symbols(Graph.load(spark, sf))


def cypher_export(spark: SparkSession, sf: str) -> DataFrame:
    return X.cypher_lines(Graph.load(spark, sf))


def dot_export(spark: SparkSession, sf: str) -> DataFrame:
    return X.dot_lines(Graph.load(spark, sf))


def graphml_export(spark: SparkSession, sf: str) -> DataFrame:
    return X.graphml_lines(Graph.load(spark, sf))


def json_export(spark: SparkSession, sf: str) -> DataFrame:
    return X.json_lines(Graph.load(spark, sf))


def markdown_map(spark: SparkSession, sf: str) -> DataFrame:
    return X.markdown_map(Graph.load(spark, sf))


def ring_layout(spark: SparkSession, sf: str) -> DataFrame:
    return X.ring_layout(Graph.load(spark, sf))


def search_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return S.search_envelope(S.lexical(Graph.load(spark, sf, texts=True).nodes, "policy table", None))


def search_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, hits returned and distinct files of a search."""
    hits = S.lexical(Graph.load(spark, sf).nodes, "policy table", None)
    return hits.agg(F.count(F.lit(1)).alias("total"), F.least(F.count(F.lit(1)), F.lit(10)).alias("returned"), F.count_distinct("file").alias("files"))


def ranked_definitions(spark: SparkSession, sf: str) -> DataFrame:
    from weftgraph.operators.lookup import best_definition

    return best_definition(Graph.load(spark, sf).nodes)


QUERIES = {
    f.__name__: f
    for f in (
        event_windows, event_sessions, stream_windows, stream_deduplicated, parsed_nodes, built_graph, source_changes, top_symbols, cypher_export, dot_export,
        graphml_export, json_export, markdown_map, ring_layout, search_envelope, search_coverage, ranked_definitions,
    )
}

_X = "replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_CQ = "replace(replace(coalesce({c}, ''), '\\', '\\\\'), '''', '\\''')"
_DQ = "replace(replace(coalesce({c}, ''), '\\', '\\\\'), '\"', '\\\"')"

ORACLE = {
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
    "event_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as s from events where ts is not null)
select user_id, cast(sum(s) as bigint) as n_sessions, count(*) as n_events from g group by 1""",
    "stream_deduplicated": "select event_type, count(distinct coalesce(cast(user_id as varchar), '-')) as n_users from events group by 1",
    "source_changes": """with s as (select * from node_snapshots where id is not null),
last as (select s.* from s join (select branch, max(snap_no) as snap_no from s group by 1) m on m.branch = s.branch and m.snap_no = s.snap_no),
one as (select * from (select *, row_number() over (partition by branch, id order by loaded_at desc) as rn from last where branch in ('release/3', 'main')) where rn = 1 and file is not null),
f as (select branch, file as path, string_agg(concat_ws('|', id, coalesce(kind, '~'), coalesce(name, '~'), coalesce(qualified_name, '~'), coalesce(cast(start_line as varchar), '~'), coalesce(cast(end_line as varchar), '~'), coalesce(cast(loc as varchar), '~'),
  coalesce(visibility, '~'), coalesce(def_signature, '~'), coalesce(cast(complexity as varchar), '~'), coalesce(cast(list_sort(list_distinct(annotations)) as varchar), '~')), chr(10) order by id) as blob from one group by 1, 2),
a as (select * from f where branch = 'release/3'), b as (select * from f where branch = 'main')
select * from (select coalesce(a.path, b.path) as path, case when a.blob is null then 'Added' when b.blob is null then 'Deleted' when a.blob <> b.blob then 'Modified' end as change from a full join b on a.path = b.path) where change is not null""",
    "stream_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
    "search_coverage": _lex("policy table") + "select count(*) as total, least(count(*), 10) as returned, count(distinct file) as files from sc where score is not null",
    "graphml_export": _BASE + f"""select 0 as seq, '{X.GRAPHML_HEAD}' as line
union all select 9, '</graph></graphml>'
union all select 1, '<node id="' || {_X.format(c='id')} || '">' || {" || ".join(f"'<data key={chr(34)}{k}{chr(34)}>' || " + _X.format(c=f"cast({k} as varchar)") + " || '</data>'" for k in X.GRAPHML_KEYS)} || '</node>' from n
union all select 2, '<edge source="' || {_X.format(c='src')} || '" target="' || {_X.format(c='dst')} || '"><data key="relation">' || {_X.format(c='kind')} || '</data></edge>' from e""",
    "top_symbols": _BASE + "select branch, cast(place as int) as place, id, name, in_degree from (select n.branch, n.id, n.name, d.in_degree, row_number() over (partition by n.branch order by d.in_degree desc, n.qualified_name nulls first, n.id) as place from n join deg d using (branch, id) where n.kind in ('function','method','struct','trait','interface','enum')) where place <= 20",
    "cypher_export": _BASE + f"""select 1 as seq, 'CREATE (:Symbol {{id: ''' || {_CQ.format(c='id')} || ''', name: ''' || {_CQ.format(c='name')} || ''', kind: ''' || {_CQ.format(c='kind')} || ''', file: ''' || {_CQ.format(c='file')} || '''}});' as line from n
union all select 2, 'MATCH (a:Symbol {{id: ''' || src || '''}}), (b:Symbol {{id: ''' || dst || '''}}) CREATE (a)-[:' || upper(kind) || ']->(b);' from e""",
    "dot_export": _BASE + f"""select 0 as seq, 'digraph code {{' as line union all select 9, '}}'
union all select 1, '  "' || id || '" [label="' || {_DQ.format(c='name')} || '", fillcolor="' || case when kind in ('function','method') then 'lightblue' when kind in ('struct','enum','trait','interface') then 'lightgreen' else 'lightgrey' end || '"];' from n
union all select 2, '  "' || src || '" -> "' || dst || '" [label="' || kind || '"];' from e""",
    "ranked_definitions": _BASE + f"select branch, name, id from (select branch, name, id, row_number() over (partition by branch, name order by {_RANK.format(k='kind')}, coalesce(start_line, 2147483647), id) as rn from n where name is not null) where rn = 1",
}
