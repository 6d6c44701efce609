"""Queries of the general data-processing problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import hierarchy as H
from weftgraph.operators.skew import in_degree
from weftgraph.operators.snapshots import snapshot_changes


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return in_degree(_t(spark, sf, "edges"), "calls", min_degree=10).select("branch", "dst")


def p2_in_degree(spark: SparkSession, sf: str) -> DataFrame:
    """In-degree of every called dst with its name, if a node or a core symbol has one."""
    deg = in_degree(_t(spark, sf, "edges"), "calls")
    core = _t(spark, sf, "core_nodes").groupBy(F.col("id").alias("dst")).agg(F.min("name").alias("core_name"))
    own = _t(spark, sf, "nodes").groupBy("branch", F.col("id").alias("dst")).agg(F.max_by("name", F.struct("indexed_at", "name")).alias("node_name"))
    return (
        deg.join(own, ["branch", "dst"], "left").join(core, "dst", "left")
        .select("branch", "dst", "in_degree", F.coalesce("node_name", "core_name").alias("dst_name"))
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(_t(spark, sf, "node_snapshots"))


def p3_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(_t(spark, sf, "node_snapshots")).groupBy("branch", "snap_no", "delta_kind").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return H.deep_or_cyclic(_t(spark, sf, "edges"))


def p4_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    h = H.hierarchy(_t(spark, sf, "edges"), with_path=True)
    return h.select("branch", "id", "status", "root_id", "node_depth", F.concat_ws("/", "path").alias("node_path"))


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return H.descendants(_t(spark, sf, "edges"))


QUERIES = {
    "p2_found": p2_found, "p2_in_degree": p2_in_degree,
    "p3_found": p3_found, "p3_change_counts": p3_change_counts,
    "p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants,
}

_P3 = """
with cur as (
  select * exclude (rn) from (select *, row_number() over (partition by branch, snap_no, id order by loaded_at desc nulls last) rn
    from node_snapshots where branch is not null and snap_no is not null and id is not null) where rn = 1),
snaps as (select branch, snap_no, lag(snap_no) over (partition by branch order by snap_no) prev
  from (select distinct branch, snap_no from cur)),
new as (select s.branch, s.snap_no as this_no, c.* exclude (branch, snap_no) from cur c join snaps s on c.branch = s.branch and c.snap_no = s.snap_no where s.prev is not null),
old as (select s.branch, s.snap_no as this_no, c.* exclude (branch, snap_no) from cur c join snaps s on c.branch = s.branch and c.snap_no = s.prev),
delta as (
select coalesce(n.branch, o.branch) as branch, cast(coalesce(n.this_no, o.this_no) as bigint) as snap_no, coalesce(n.id, o.id) as id,
  case when o.id is null then 'added' when n.id is null then 'removed'
    when n.kind is distinct from o.kind or n.name is distinct from o.name or n.qualified_name is distinct from o.qualified_name
      or n.file is distinct from o.file or n.start_line is distinct from o.start_line or n.end_line is distinct from o.end_line
      or n.loc is distinct from o.loc or n.visibility is distinct from o.visibility or n.def_signature is distinct from o.def_signature
      or n.complexity is distinct from o.complexity
      or list_sort(list_distinct(n.annotations)) is distinct from list_sort(list_distinct(o.annotations)) then 'changed' end as delta_kind
from new n full join old o on n.branch = o.branch and n.this_no = o.this_no and n.id = o.id)
"""

_P4_WALK = """
with recursive links as (select distinct branch, src, dst from edges where kind = 'contains' and branch is not null and src is not null and dst is not null),
ids as (select branch, src as id from links union select branch, dst from links),
up as (
  select branch, dst as id, src as anc, 1 as d from links
  union select u.branch, u.id, l.src, u.d + 1 from up u join links l on l.branch = u.branch and l.dst = u.anc where u.anc <> u.id and u.d < 400),
cyc as (select distinct branch, id from up where id = anc),
below as (select distinct u.branch, u.id from up u join cyc c on c.branch = u.branch and c.id = u.anc
  where not exists (select 1 from cyc x where x.branch = u.branch and x.id = u.id)),
roots as (select branch, id from ids i where not exists (select 1 from links l where l.branch = i.branch and l.dst = i.id)),
tree as (
  select u.branch, u.id, u.anc as root_id, max(u.d) as d from up u
  join roots r on r.branch = u.branch and r.id = u.anc
  where not exists (select 1 from cyc x where x.branch = u.branch and x.id = u.id)
    and not exists (select 1 from below x where x.branch = u.branch and x.id = u.id)
  group by 1, 2, 3)
"""

ORACLE = {
    "p2_found": """
select branch, dst from edges where kind = 'calls' and dst is not null
group by branch, dst having count(distinct src) >= 10""",
    "p2_in_degree": """
with deg as (select branch, dst, count(distinct src) as in_degree from edges where kind = 'calls' and dst is not null group by 1, 2),
own as (select branch, id, name from (select *, row_number() over (partition by branch, id order by indexed_at desc, name desc) rn from nodes) where rn = 1),
core as (select id, min(name) as name from core_nodes group by 1)
select d.branch, d.dst, d.in_degree, coalesce(o.name, c.name) as dst_name
from deg d left join own o on o.branch = d.branch and o.id = d.dst left join core c on c.id = d.dst""",
    "p3_found": _P3 + "select branch, snap_no, id, delta_kind from delta where delta_kind is not null",
    "p3_change_counts": _P3 + "select branch, snap_no, delta_kind, count(*) as n from delta where delta_kind is not null group by 1, 2, 3",
    "p4_found": _P4_WALK + """
select branch, id, 'CYCLE' as root_id, cast(-1 as bigint) as node_depth from cyc
union all select branch, id, 'BELOW', -1 from below
union all select branch, id, root_id, d from tree where d >= 10""",
    "p4_hierarchy": _P4_WALK + """, bad as (select branch, id from cyc union select branch, id from below),
down as (
  select branch, id, id as root_id, 0 as d, id as path from roots
  union all select w.branch, l.dst, w.root_id, w.d + 1, w.path || '/' || l.dst from down w join links l on l.branch = w.branch and l.src = w.id
  where not exists (select 1 from bad x where x.branch = l.branch and x.id = l.dst))
select branch, id, 'cycle' as status, 'CYCLE' as root_id, cast(-1 as bigint) as node_depth, '' as node_path from cyc
union all select branch, id, 'below', 'BELOW', -1, '' from below
union all select branch, id, 'tree', root_id, d, path from (select *, row_number() over (partition by branch, id, root_id order by d desc, path) as rn from down) where rn = 1""",
    "p4_descendants": _P4_WALK + """
select u.branch, u.anc as ancestor, u.id as descendant, cast(max(u.d) as bigint) as hops from up u
where not exists (select 1 from cyc x where x.branch = u.branch and x.id = u.id)
  and not exists (select 1 from below x where x.branch = u.branch and x.id = u.id)
group by 1, 2, 3""",
}
