"""Queries of the code graph and their SQL. Each runs over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators import analytics as A
from weftgraph.operators import lookup as L
from weftgraph.operators import resolve as R
from weftgraph.operators import search as S
from weftgraph.operators import traverse as T
from weftgraph.schema import NON_CODE_KINDS
from weftgraph.sources import graph as G
from weftgraph.sources.graph import Graph

BASE, HEAD = "release/3", "main"
QUERY = "session table"

_BASE = """
with recursive n as (
  select * exclude (rn) from (select *, row_number() over (partition by branch, id order by indexed_at desc nulls last, name desc nulls last, qualified_name desc nulls last, file desc nulls last,
    start_line desc nulls last, end_line desc nulls last, loc desc nulls last, complexity desc nulls last, def_signature desc nulls last, def_body desc nulls last, def_doc desc nulls last) rn from nodes where id is not null) where rn = 1),
e as (
  select branch, src, dst, kind, line, confidence from (select *, row_number() over (partition by branch, src, dst, kind order by seen_at nulls first, loaded_at nulls first,
    line is null, line nulls first, confidence is null, confidence nulls first) rn from edges where src is not null and dst is not null) where rn = 1),
deg as (select branch, dst as id, count(*) as in_degree from e where kind = 'calls' group by 1, 2)
"""
_HUBS = _BASE + ", hub as (select d.branch, d.id from deg d join n on n.branch = d.branch and n.id = d.id where d.in_degree >= 10)"
#: Every node is a seed.
_ALL = _BASE + ", hub as (select branch, id from n)"
_NONCODE = ", ".join(f"'{k}'" for k in NON_CODE_KINDS)
_RANK = "case when {k} in ('struct','trait','interface','enum','type_alias') then 0 when {k} in ('function','method') then 1 when {k} in ('macro','constant','property','annotation','enum_member') then 2 else 5 end"
_CONF = "case {c} when 'resolved' then 1 when 'inferred' then 2 else 0 end"
_TEST = f"coalesce(regexp_matches({{f}}, '{C.TEST_FILE}'), false)"
_TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({x}, '[_\\-.:/ ]+', ' ', 'g'), '([^A-Z\\s])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda t: t <> '')"
_GROUP = """case when list_position(p, 'src') > 1 then
    case when list_position(p, 'src') > 2 and p[list_position(p, 'src') - 2] in ('crates','packages','apps')
      then p[list_position(p, 'src') - 2] || '/' || p[list_position(p, 'src') - 1] else p[list_position(p, 'src') - 1] end
  when p[1] in ('crates','packages','apps') and len(p) > 1 then p[1] || '/' || p[2] when len(p) > 1 then p[1] else 'repository root' end"""
_GROUPED = f", gn as (select *, {_GROUP} as grp from (select *, list_filter(string_split(replace(file, '\\', '/'), '/'), lambda t: t <> '') as p from n where file is not null))"
_RELEVANT = f"not regexp_matches(lower(file), '^(docs|site|examples)/|/(generated|vendor|node_modules|target)/') and not {_TEST.format(f='file')} and coalesce(visibility, 'private') <> 'private' and kind in ('function','method','struct','trait','interface','enum')"
_WEIGHT = "(case when kind in ('struct','trait','interface','enum') then 100 when kind = 'function' then 70 when kind = 'method' then 10 else 0 end) + least(coalesce(in_degree, 0), 30)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _g(spark: SparkSession, sf: str, texts: bool = False) -> Graph:
    return Graph.load(spark, sf, texts)


def _hubs(g: Graph) -> DataFrame:
    return A.hubs(g, 10, None).select("branch", "id")


# ---- scans, filters, lookups ----------------------------------------------------------------------------------------


@query(_BASE + "select branch, id, kind, name, qualified_name, file, start_line from n")
def node_scan(spark, sf):
    return _g(spark, sf).nodes.select(*L.SHOWN)


@query(_BASE + "select e.branch, e.src, e.dst, e.kind, e.line, e.confidence from e join n a on a.branch = e.branch and a.id = e.src join n b on b.branch = e.branch and b.id = e.dst")
def edge_scan(spark, sf):
    return _g(spark, sf).valid_edges()


@query(_BASE + "select branch, src, dst, confidence from e where kind = 'implements'")
def edges_by_kind(spark, sf):
    return _g(spark, sf).kind("implements").select("branch", "src", "dst", "confidence")


@query(_BASE + "select branch, id, name from n order by branch, id limit 100 offset 50")
def nodes_page(spark, sf):
    return G.nodes_page(_g(spark, sf).nodes.select("branch", "id", "name"), 50, 100)


@query(_BASE + "select branch, src, dst, kind, line from e order by branch, src, dst, kind, line nulls first limit 100 offset 50")
def edges_page(spark, sf):
    return G.edges_page(_g(spark, sf).edges, 50, 100).drop("confidence")


@query("select distinct branch from nodes where id is not null")
def branch_list(spark, sf):
    return G.branch_list(_g(spark, sf).nodes)


@query(_BASE + f"select branch, id, name, {_RANK.format(k='kind')} as symbol_rank from n where name = 'PolicyTable'")
def lookup_exact(spark, sf):
    return L.lookup(_g(spark, sf).nodes, "PolicyTable").select("branch", "id", "name", C.symbol_rank(F.col("kind")).alias("symbol_rank"))


@query(_BASE + "select branch, id, name from n where contains(name, 'Table')")
def lookup_fuzzy(spark, sf):
    return L.lookup(_g(spark, sf).nodes, "Table", fuzzy=True).select("branch", "id", "name")


@query(_BASE + "select branch, id, qualified_name from n where contains(lower(name), 'session') or contains(lower(qualified_name), 'session')")
def search_nodes(spark, sf):
    return L.search_nodes(_g(spark, sf).nodes, "Session").select("branch", "id", "qualified_name")


@query(_BASE + "select branch, id, complexity from n where kind = 'method' and coalesce(visibility, 'private') = 'pub' and complexity >= 2 and complexity <= 9 and contains(lower(name), 'e')")
def attr_filter(spark, sf):
    return L.search_by_attributes(_g(spark, sf).nodes, kind="method", visibility="pub", min_complexity=2, max_complexity=9, name_contains="E").select("branch", "id", "complexity")


@query(_BASE + "select branch, id from n where len(list_filter(annotations, lambda x: contains(lower(x), 'step'))) > 0")
def attr_annotation(spark, sf):
    return L.search_by_attributes(_g(spark, sf).nodes, annotation="step").select("branch", "id")


@query(_BASE + ", ids as (select distinct branch, src as id from e where kind = 'throws') select n.branch, n.id, n.name from n join ids on ids.branch = n.branch and ids.id = n.id")
def nodes_by_ids(spark, sf):
    g = _g(spark, sf)
    return L.by_ids(g.nodes, g.kind("throws").select("branch", F.col("src").alias("id"))).select("branch", "id", "name")


@query(_BASE + ", f as (select branch, file, count(*) c from n group by 1, 2) select n.branch, n.file, n.id, n.start_line, cast(row_number() over (partition by n.branch, n.file order by n.start_line nulls first, n.id) as int) as place from n")
def definitions_in_files(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("branch", "file").orderBy("start_line", "id")
    return _g(spark, sf).nodes.select("branch", "file", "id", "start_line", F.row_number().over(w).alias("place"))


@query(_BASE + ", h as (select distinct branch, file, 10 as hs, 40 as he from source_files) select distinct n.branch, n.id from n join h on h.branch = n.branch and h.file = n.file and n.start_line <= h.he and n.end_line >= h.hs where n.kind not in ('file','folder','module')")
def changed_symbols(spark, sf):
    hunks = spark.read.parquet(f"{sf}/source_files.parquet").select("branch", "file", F.lit(10).alias("h_start"), F.lit(40).alias("h_end")).distinct()
    return L.changed_symbols(_g(spark, sf).nodes, hunks).select("branch", "id")


@query(_BASE + f"select branch, id, {_TEST.format(f='file')} as is_test, {_RELEVANT} as relevant from n")
def path_predicates(spark, sf):
    n = _g(spark, sf).nodes
    return n.select("branch", "id", C.is_test_file(F.col("file")).alias("is_test"), C.agent_relevant(F.col("kind"), F.col("file"), F.col("visibility")).alias("relevant"))


@query(_BASE + ", en as (select distinct branch, id from (select branch, src as id from e where kind in ('calls','implements','inherits','uses','throws') union all select branch, dst from e where kind in ('calls','implements','inherits','uses','throws'))) select n.branch, n.id from n join en on en.branch = n.branch and en.id = n.id where n.kind not in ('file','folder','module')")
def density_connected(spark, sf):
    return L.dense_view(_g(spark, sf)).nodes.select("branch", "id")


@query(_BASE + ", k as (select branch, id from n where kind not in ('constant','folder') and coalesce(visibility, 'private') <> 'private') select e.branch, e.src, e.dst, e.kind from e join k a on a.branch = e.branch and a.id = e.src join k b on b.branch = e.branch and b.id = e.dst where coalesce(e.confidence, 'extracted') <> 'inferred'")
def view_filters(spark, sf):
    return L.view(_g(spark, sf), ("constant", "folder"), ("private",), (), ("inferred",)).edges.select("branch", "src", "dst", "kind")


# ---- relations ------------------------------------------------------------------------------------------------------

_IN = "select distinct e.branch, t.name as target, s.id, s.name from e join n t on t.branch = e.branch and t.id = e.dst join n s on s.branch = e.branch and s.id = e.src where t.name is not null and e.kind in ({k})"


def _shown(df: DataFrame) -> DataFrame:
    return df.where("target is not null").select("branch", "target", "id", "name").distinct()


@query(_BASE + _IN.format(k="'calls'"))
def callers(spark, sf):
    return _shown(L.callers(_g(spark, sf)))


@query(_BASE + "select e.branch, t.name as target, e.src as id, e.dst, e.confidence from e join n t on t.branch = e.branch and t.id = e.dst join n s on s.branch = e.branch and s.id = e.src where e.kind = 'calls'")
def callers_conf(spark, sf):
    return L.callers_with_confidence(_g(spark, sf))


@query(_BASE + "select e.branch, e.dst, e.src as id, e.confidence, s.name from e join n s on s.branch = e.branch and s.id = e.src where e.kind = 'calls'")
def callers_by_id(spark, sf):
    return L.callers_by_id(_g(spark, sf))


@query(_BASE + _IN.format(k="'implements','inherits'"))
def implementors(spark, sf):
    return _shown(L.implementors(_g(spark, sf)))


@query(_BASE + _IN.format(k="'uses'"))
def type_usages(spark, sf):
    return _shown(L.type_usages(_g(spark, sf)))


@query(_BASE + "select e.branch, t.name as target, e.src as id, e.dst, s.name, e.line from e join n t on t.branch = e.branch and t.id = e.dst join n s on s.branch = e.branch and s.id = e.src where e.kind = 'calls'")
def call_sites(spark, sf):
    return L.call_sites(_g(spark, sf))


@query(_BASE + _IN.format(k="'imports'"))
def importers(spark, sf):
    return _shown(L.importers(_g(spark, sf)))


@query(_BASE + """select distinct branch, target, direction, id, name from (
  select e.branch, t.name as target, 'subtype' as direction, o.id, o.name from e join n t on t.branch = e.branch and t.id = e.dst join n o on o.branch = e.branch and o.id = e.src where e.kind in ('implements','inherits')
  union all select e.branch, t.name, 'supertype', o.id, o.name from e join n t on t.branch = e.branch and t.id = e.src join n o on o.branch = e.branch and o.id = e.dst where e.kind in ('implements','inherits'))""")
def type_hierarchy(spark, sf):
    return L.type_hierarchy(_g(spark, sf))


@query(_BASE + f""", best as (select branch, name, id from (select branch, name, id, row_number() over (partition by branch, name order by {_RANK.format(k='kind')}, coalesce(start_line, 2147483647), id) rn from n where name is not null) where rn = 1)
select distinct r.branch, r.name, r.role, r.other_id from (
  select b.branch, b.name, 'caller' as role, e.src as other_id from e join best b on b.branch = e.branch and b.id = e.dst where e.kind = 'calls'
  union all select b.branch, b.name, 'used_by', e.src from e join best b on b.branch = e.branch and b.id = e.dst where e.kind = 'uses'
  union all select b.branch, b.name, 'callee', e.dst from e join best b on b.branch = e.branch and b.id = e.src where e.kind = 'calls') r
join n o on o.branch = r.branch and o.id = r.other_id""")
def symbol_context(spark, sf):
    return L.symbol_context(_g(spark, sf))


@query(_BASE + """select distinct e.branch, m.name as module, f.id as depends_on_id, f.name as depends_on from e
join n m on m.branch = e.branch and m.id = e.src and m.kind = 'module' join n s on s.branch = e.branch and s.id = e.dst
join n f on f.branch = e.branch and f.file = s.file and f.kind = 'module' where e.kind = 'imports' and m.file <> s.file""")
def module_deps(spark, sf):
    return L.module_dependencies(_g(spark, sf))


@query(_BASE + "select branch, id, kind from n where kind not in ('file','folder','module') and not exists (select 1 from e where e.branch = n.branch and e.dst = n.id and e.kind in ('calls','uses'))")
def unused(spark, sf):
    return L.unused_symbols(_g(spark, sf)).select("branch", "id", "kind")


@query(_ALL + "select distinct e.branch, e.src, e.dst, e.kind from e join hub h on h.branch = e.branch and (h.id = e.src or h.id = e.dst)")
def neighbourhood(spark, sf):
    """Edges at every node."""
    g = _g(spark, sf)
    return L.neighbourhood(g, g.nodes.select("branch", "id"), "both", None).select("branch", "src", "dst", "kind")


@query(_BASE + ", k as (select branch, id from n where kind in ('struct','method')) select e.branch, e.src, e.dst, e.kind from e join k a on a.branch = e.branch and a.id = e.src join k b on b.branch = e.branch and b.id = e.dst")
def induced_edges(spark, sf):
    g = _g(spark, sf)
    return G.induced_edges(g.edges, g.nodes.where("kind in ('struct', 'method')")).select("branch", "src", "dst", "kind")


_FAMILY = "case regexp_extract({f}, '\\.([A-Za-z]+)$', 1) when 'rs' then 'rust' when 'py' then 'python' when 'ts' then 'script' when 'tsx' then 'script' when 'js' then 'script' when 'jsx' then 'script' when 'mjs' then 'script' when 'cjs' then 'script' when 'go' then 'go' when 'java' then 'java' end"
_ALLOWED = " or ".join(f"(r.ref_kind = '{k}'" + (f" and c.kind in ({', '.join(repr(x) for x in v)})" if v else "") + ")" for k, v in R.ALLOWED.items())
_BUILTIN = " or ".join(f"(family = '{k}' and target_name in ({', '.join(repr(x) for x in v)}))" for k, v in C.BUILTINS.items())
_RESOLVE = _BASE + f""",
r as (select branch, src, src_file, target_name, ref_kind, family, min(line) as line from (select *, {_FAMILY.format(f='src_file')} as family from refs where target_name is not null and src is not null)
  where ref_kind = 'references' or not coalesce({_BUILTIN}, false) group by 1, 2, 3, 4, 5, 6),
c as (select branch, id as dst, kind, name as target_name, {_FAMILY.format(f='file')} as nf from n where kind not in ('file','folder','section')),
m as (select r.*, c.dst, count(*) over (partition by r.branch, r.src, r.src_file, r.target_name, r.ref_kind, r.family) as fan from r join c on c.branch = r.branch and c.target_name = r.target_name
  where ({_ALLOWED}) and (r.family is null or c.nf is null or r.family = c.nf or r.ref_kind = 'references')),
im as (select distinct branch, src_file, target_name from refs where ref_kind = 'imports' and target_name is not null)
"""


@query(_RESOLVE + """select m.branch, m.src, m.dst, m.ref_kind as kind, min(m.line) as line, max(case when im.branch is not null then 'resolved' else 'inferred' end) as confidence
from m left join im on im.branch = m.branch and im.src_file = m.src_file and im.target_name = m.target_name where m.fan <= 8 and m.src <> m.dst group by 1, 2, 3, 4""")
def resolve_refs(spark, sf):
    return R.resolve_references(spark.read.parquet(f"{sf}/refs.parquet"), _g(spark, sf).nodes)[0]


@query(_RESOLVE + "select distinct r.branch, r.src, r.target_name, r.ref_kind from r where not exists (select 1 from m where m.branch = r.branch and m.src = r.src and m.target_name = r.target_name and m.ref_kind = r.ref_kind and m.src_file is not distinct from r.src_file)")
def unresolved_refs(spark, sf):
    return R.resolve_references(spark.read.parquet(f"{sf}/refs.parquet"), _g(spark, sf).nodes)[1].select("branch", "src", "target_name", "ref_kind").distinct()


@query(_BASE + """select distinct r.branch, r.src, r.target_name from refs r where exists (select 1 from e join n a on a.branch = e.branch and a.id = e.src join n b on b.branch = e.branch and b.id = e.dst
  where e.kind = 'imports' and e.branch = r.branch and a.file = r.src_file and b.name = r.target_name)""")
def verified_imports(spark, sf):
    g = _g(spark, sf)
    return R.verified_imports(spark.read.parquet(f"{sf}/refs.parquet"), g.edges, g.nodes)


@query(_BASE + f", a as (select distinct id from n where branch = '{BASE}'), b as (select distinct id from n where branch = '{HEAD}') select id, 'added' as change from b where id not in (select id from a) union all select id, 'removed' from a where id not in (select id from b)")
def branch_diff_nodes(spark, sf):
    g = _g(spark, sf)
    return R.diff_nodes(g.branch(BASE).nodes, g.branch(HEAD).nodes)


@query(_BASE + f", a as (select src, dst, kind, line, confidence from e where branch = '{BASE}'), b as (select src, dst, kind, line, confidence from e where branch = '{HEAD}') select distinct src, dst, kind, 'added' as change from (select * from b except select * from a) union all select distinct src, dst, kind, 'removed' from (select * from a except select * from b)")
def branch_diff_edges(spark, sf):
    g = _g(spark, sf)
    return R.diff_edges(g.branch(BASE).edges, g.branch(HEAD).edges)


# ---- traversals -----------------------------------------------------------------------------------------------------

_REACH = """, walk as (select branch, id as seed, id, 0 as hop from hub union select w.branch, w.seed, s.b, w.hop + 1 from walk w join ({step}) s on s.branch = w.branch and s.a = w.id where w.hop < {depth}),
reached as (select branch, seed, id, min(hop) as hop from walk group by 1, 2, 3)"""
_UP = "select branch, dst as a, src as b from e where kind = 'calls'"
_DOWN = "select branch, src as a, dst as b from e where kind = 'calls'"
_ANY = "select branch, src as a, dst as b from e union all select branch, dst, src from e"
_BYNAME = """, st as (select distinct e.branch, a.name as a_name, b.id, b.name as b_name from e join n a on a.branch = e.branch and a.id = e.{a} join n b on b.branch = e.branch and b.id = e.{b} where e.kind = 'calls'),
sd as (select distinct h.branch, n.name as seed from hub h join n on n.branch = h.branch and n.id = h.id),
walk as (select branch, seed, cast(null as varchar) as id, seed as name, 0 as hop from sd union select w.branch, w.seed, st.id, st.b_name, w.hop + 1 from walk w join st on st.branch = w.branch and st.a_name = w.name where w.hop < {depth})
select branch, seed, id, min(hop) as hop from walk where id is not null group by 1, 2, 3"""


def _hub_names(g: Graph) -> DataFrame:
    return A.hubs(g, 10, None).select("branch", "name").where("name is not null").distinct()


@query(_HUBS + _BYNAME.format(a="dst", b="src", depth=5))
def callers_deep(spark, sf):
    """Callers of hub names (10 callers and more) over up to MAX_DEPTH hops."""
    g = _g(spark, sf)
    return T.reach_by_name(g, _hub_names(g), direction="in")


@query(_HUBS + _BYNAME.format(a="src", b="dst", depth=5))
def callees_deep(spark, sf):
    """Callees of hub names over up to MAX_DEPTH hops."""
    g = _g(spark, sf)
    return T.reach_by_name(g, _hub_names(g), direction="out")


@query(_ALL + _REACH.format(step=_UP, depth=2) + f""", best as (select r.branch, r.seed, r.id, r.hop, min({_CONF.format(c='e.confidence')}) as cr from reached r join e on e.branch = r.branch and e.src = r.id and e.kind = 'calls'
  join reached p on p.branch = r.branch and p.seed = r.seed and p.id = e.dst and p.hop = r.hop - 1 where r.hop > 0 group by 1, 2, 3, 4)
select b.branch, b.seed, b.id, b.hop, case b.cr when 0 then 'extracted' when 1 then 'resolved' else 'inferred' end as confidence, {_TEST.format(f='n.file')} as is_test,
  cast(row_number() over (partition by b.branch, b.seed, b.hop order by b.cr, {_TEST.format(f='n.file')}, case n.visibility when 'pub' then 0 when 'pub_crate' then 1 else 2 end, n.file nulls first, n.qualified_name nulls first, b.id) as int) as place
from best b join n on n.branch = b.branch and n.id = b.id""")
def callers_exact(spark, sf):
    """Callers of every node over two hops."""
    g = _g(spark, sf)
    return T.callers_exact(g, g.nodes.select("branch", "id"))


@query(_HUBS + _REACH.format(step=_UP, depth=5) + "select branch, seed, count(*) as affected, max(hop) as deepest, case when count(*) <= 2 then 'LOW' when count(*) <= 10 then 'MEDIUM' when count(*) <= 30 then 'HIGH' else 'CRITICAL' end as risk from reached where hop > 0 group by 1, 2")
def callers_risk(spark, sf):
    g = _g(spark, sf)
    return T.summary(T.reach(g.kind("calls"), _hubs(g).select("branch", F.col("id").alias("seed"), "id"), 5, "in"))


@query(_HUBS + _REACH.format(step=_UP, depth=5) + ", a as (select branch, seed, count(*) as c from reached where hop > 0 group by 1, 2) select branch, seed, least(c, 500) as affected, c > 500 as truncated, case when c <= 2 then 'LOW' when c <= 9 then 'MEDIUM' when c <= 29 then 'HIGH' else 'CRITICAL' end as risk from a")
def affected_by_id(spark, sf):
    g = _g(spark, sf)
    return T.affected_by_id(g, _hubs(g))


@query(_HUBS + _REACH.format(step=_ANY, depth=2) + "select r.branch, r.seed, r.id, r.hop from reached r join n on n.branch = r.branch and n.id = r.id")
def subgraph_nodes(spark, sf):
    """Nodes within two hops of hubs."""
    g = _g(spark, sf)
    return T.subgraph_nodes(g, _hubs(g))


@query(_HUBS + _REACH.format(step=_ANY, depth=2) + ", k as (select r.branch, r.seed, r.id from reached r join n on n.branch = r.branch and n.id = r.id) select e.branch, a.seed, e.src, e.dst, e.kind from e join k a on a.branch = e.branch and a.id = e.src join k b on b.branch = e.branch and b.id = e.dst and b.seed = a.seed")
def subgraph_edges(spark, sf):
    """Edges between the nodes within two hops of each hub."""
    g = _g(spark, sf)
    return T.subgraph(g, _hubs(g))[1].select("branch", "seed", "src", "dst", "kind")


_LABEL = "case " + " ".join(f"when kind = '{k}' and dir = '{d}' then '{v}'" for (k, d), v in T.RELATIONS.items()) + " else 'related' end"
_LRANK = "case relation " + " ".join(f"when '{k}' then {v}" for k, v in T.RELATION_RANKS.items()) + " else 5 end"
_RELATIONS = _ALL + f""", raw as (
  select h.branch, h.id as seed, 'out' as dir, e.dst as other_id, e.kind, e.confidence from e join hub h on h.branch = e.branch and h.id = e.src
  union all select h.branch, h.id, 'in', e.src, e.kind, e.confidence from e join hub h on h.branch = e.branch and h.id = e.dst where e.src <> e.dst),
lab as (select branch, seed, {_LABEL} as relation, other_id, min({_CONF.format(c='confidence')}) as cr from raw group by 1, 2, 3, 4),
rel as (select l.*, n.file, n.qualified_name, {_TEST.format(f='n.file')} as is_test from lab l join n on n.branch = l.branch and n.id = l.other_id where n.kind not in ('section','file','folder','module'))
"""


@query(_RELATIONS + f"select branch, seed, relation, other_id, case cr when 0 then 'extracted' when 1 then 'resolved' else 'inferred' end as confidence, is_test, cast(row_number() over (partition by branch, seed order by {_LRANK}, cr, is_test, file nulls first, qualified_name nulls first, relation, other_id) as int) as place from rel")
def relation_digest(spark, sf):
    """Direct relations of every node."""
    g = _g(spark, sf)
    return T.relations(g, g.nodes.select("branch", "id"))


@query(_RELATIONS + "select branch, seed, relation, count(*) as n from rel group by 1, 2, 3")
def relation_counts(spark, sf):
    """Numbers of direct relations of every node."""
    g = _g(spark, sf)
    return T.relations(g, g.nodes.select("branch", "id")).groupBy("branch", "seed", "relation").agg(F.count(F.lit(1)).alias("n"))


@query()
def trace_path(spark, sf):
    """Shortest call paths of up to TRACE_MAX_HOPS hops for all pairs of hub names (10 callers and more) of a branch. Tested against brute force: SQL that holds all paths is too slow on whole tables."""
    g = _g(spark, sf)
    return T.paths_among(g, _hub_names(g), sep=" ")


@query(_BASE + f""", ch as (select distinct id from n where branch = '{HEAD}' and id not in (select id from n where branch = '{BASE}')),
walk as (select id, 0 as hop from ch union select e.src, w.hop + 1 from walk w join e on e.dst = w.id and e.branch = '{HEAD}' and e.kind = 'calls' where w.hop < 2 and e.src not in (select id from ch))
select id, min(hop) as hop from walk where hop > 0 and id in (select id from n where branch = '{HEAD}') group by 1""")
def blast_radius(spark, sf):
    g = _g(spark, sf)
    return T.blast_radius(g.branch(BASE), g.branch(HEAD), 2)


@query(_HUBS + _REACH.format(step=_DOWN, depth=5) + "select branch, seed, cast(step as int) as step, id, hop from (select r.*, row_number() over (partition by r.branch, r.seed order by r.hop, n.qualified_name nulls first, r.id) as step from reached r join n on n.branch = r.branch and n.id = r.id) where step <= 6")
def seeded_tour(spark, sf):
    g = _g(spark, sf)
    return T.seeded_tour(g, _hubs(g))


# ---- aggregates and analytics ---------------------------------------------------------------------------------------


@query(_BASE + """, k as (select branch, 'nodes' as what, kind, count(*) as n from n group by 1, 3 union all select branch, 'edges', kind, count(*) from e group by 1, 3)
select branch, what, kind, n from k union all select branch, what, '*', cast(sum(n) as bigint) from k group by 1, 2""")
def graph_stats(spark, sf):
    return A.graph_stats(_g(spark, sf))


@query(_BASE + "select branch, id, in_degree from deg")
def in_degree(spark, sf):
    return A.in_degrees(_g(spark, sf))


@query(_BASE + "select d.branch, d.id, n.name, n.qualified_name, d.in_degree from deg d join n on n.branch = d.branch and n.id = d.id where d.in_degree >= 10 order by d.in_degree desc, n.qualified_name, d.branch, d.id limit 20")
def hub_nodes(spark, sf):
    return A.hubs(_g(spark, sf)).select("branch", "id", "name", "qualified_name", "in_degree")


@query(_HUBS + _REACH.format(step=_UP, depth=1) + f", m as (select r.branch, r.seed, r.id, min({_CONF.format(c='e.confidence')}) as cr from reached r join e on e.branch = r.branch and e.src = r.id and e.dst = r.seed and e.kind = 'calls' join n on n.branch = r.branch and n.id = r.id where r.hop = 1 group by 1, 2, 3) select branch, seed, count(*) filter (cr = 0) as extracted, count(*) filter (cr = 1) as resolved, count(*) filter (cr = 2) as inferred from m group by 1, 2")
def confidence_mix(spark, sf):
    g = _g(spark, sf)
    c = T.callers_exact(g, _hubs(g), 1)
    n = lambda k: F.count(F.when(F.col("confidence") == k, 1)).alias(k)
    return c.groupBy("branch", "seed").agg(n("extracted"), n("resolved"), n("inferred"))


_HITS = _BASE + "select file, count(*) as n, array_to_string(list_slice(list(name order by score desc, name), 1, 3), ' ') as names from (select file, name, coalesce(loc, 0) as score from n where kind in ('function', 'method') and file is not null) group by 1"


@query(_HITS)
def hits_by_file(spark, sf):
    hits = _g(spark, sf).nodes.where("kind in ('function', 'method') and file is not null").select("file", "name", F.coalesce("loc", F.lit(0)).alias("score"))
    return A.group_hits_by_file(hits).select("file", "n", F.concat_ws(" ", "names").alias("names"))


@query(_BASE + f""", w as (select n.*, {_WEIGHT} as weight, case when contains(file, '/') then regexp_extract(file, '^(.*)/[^/]*$', 1) else '<root>' end as component from n left join deg using (branch, id) where {_RELEVANT}),
lab as (select branch, component, name || ' — ' || file || ':' || start_line as label, max(weight) as w from w group by 1, 2, 3),
top as (select branch, component, string_agg(label, ' | ' order by r) as key_symbols from (select *, row_number() over (partition by branch, component order by w desc, label) r from lab) where r <= 2 group by 1, 2),
dep as (select distinct a.branch, a.component, b.component as far from e join w a on a.branch = e.branch and a.id = e.src join w b on b.branch = e.branch and b.id = e.dst where e.kind in ('calls','uses','imports') and coalesce(e.confidence, 'extracted') <> 'inferred' and a.component <> b.component),
five as (select branch, component, string_agg(far, ' | ' order by far) as depends_on from (select *, row_number() over (partition by branch, component order by far) r from dep) where r <= 5 group by 1, 2)
select w.branch, w.component, count(distinct file) as n_files, cast(sum(weight) as bigint) as score, any_value(top.key_symbols) as key_symbols, coalesce(any_value(five.depends_on), '') as depends_on
from w left join top using (branch, component) left join five using (branch, component) group by 1, 2""")
def architecture(spark, sf):
    return A.architecture(_g(spark, sf))


@query(_BASE + f"select branch, cast(step as int) as step, id, score from (select n.branch, n.id, {_WEIGHT} as score, row_number() over (partition by n.branch order by {_WEIGHT} desc, qualified_name nulls first, n.id) as step from n left join deg using (branch, id) where {_RELEVANT} and kind <> 'method') where step <= 8")
def global_tour(spark, sf):
    return A.global_tour(_g(spark, sf))


@query("select file as path, count(*) as touches, cast(sum(loc) as bigint) as additions, cast(sum(complexity) as bigint) as deletions, max(loaded_at) as last_changed from node_snapshots where not regexp_matches(file, '(^|/)(target|node_modules|dist|vendor)/') group by 1")
def hot_files(spark, sf):
    s = spark.read.parquet(f"{sf}/node_snapshots.parquet")
    return A.hot_files(s.select(F.col("file").alias("path"), F.col("loc").alias("additions"), F.col("complexity").alias("deletions"), F.col("loaded_at").alias("ts")), None)


@query(_BASE + ", h as (select file, count(*) as touches from nodes where file is not null group by 1), m as (select max(touches) as t from h) select n.branch, n.id, round(h.touches / m.t, 6) as heat from n join h on h.file = n.file cross join m")
def hotspots(spark, sf):
    h = spark.read.parquet(f"{sf}/nodes.parquet").where("file is not null").groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("touches"))
    return A.hotspot_scores(_g(spark, sf), h)


@query(_BASE + _GROUPED + """, ends as (select e.branch, s.grp as s, d.grp as d from e left join gn s on s.branch = e.branch and s.id = e.src left join gn d on d.branch = e.branch and d.id = e.dst),
rel as (select branch, s as name, count(*) as relations, count(*) filter (d is not null and s <> d) as cross_n from ends where s is not null group by 1, 2
  union all select branch, d, count(*), count(*) from ends where d is not null and (s is null or s <> d) group by 1, 2)
select g.branch, g.grp as name, g.nodes, g.loc, coalesce(cast(sum(r.relations) as bigint), 0) as relations, coalesce(cast(sum(r.cross_n) as bigint), 0) as boundary_relations
from (select branch, grp, count(*) as nodes, coalesce(cast(sum(loc) as bigint), 0) as loc from gn group by 1, 2) g left join rel r on r.branch = g.branch and r.name = g.grp group by 1, 2, 3, 4""")
def group_summary(spark, sf):
    return A.group_summary(_g(spark, sf))


@query(_BASE + _GROUPED + "select e.branch, e.src, e.dst, e.kind, s.grp as src_group, d.grp as dst_group from e join gn s on s.branch = e.branch and s.id = e.src join gn d on d.branch = e.branch and d.id = e.dst where s.grp <> d.grp")
def boundary_edges(spark, sf):
    return A.boundary_edges(_g(spark, sf))


@query(_BASE + """, dg as (select branch, id, count(*) as deg from (select branch, src as id from e union all select branch, dst from e) group by 1, 2),
x as (select n.branch, n.id, coalesce(n.loc, 0) as loc, coalesce(dg.deg, 0) as deg from n left join dg using (branch, id)), m as (select branch, greatest(max(loc), 1) as ml, greatest(max(deg), 1) as md from x group by 1)
select x.branch, x.id, round(0.55 * log2(loc + 1) / log2(ml + 1) + 0.45 * log2(deg + 1) / log2(md + 1), 6) as score from x join m using (branch)""")
def complexity_score(spark, sf):
    return A.complexity_score(_g(spark, sf))


_CYCLES = """, imp as (select distinct branch, src, dst from e where kind = 'imports' and src <> dst),
r as (select branch, src as a, dst as b from imp union select r.branch, r.a, i.dst from r join imp i on i.branch = r.branch and i.src = r.b),
scc as (select x.branch, x.a as id, least(min(x.b), x.a) as component from r x join r y on y.branch = x.branch and y.a = x.b and y.b = x.a where x.a <> x.b group by x.branch, x.a)"""


@query(_BASE + _CYCLES + "select branch, component, id from scc")
def import_cycles(spark, sf):
    return A.import_cycles(_g(spark, sf))


@query(_BASE + _CYCLES + """, u as (select branch, count(*) as c from n where kind not in ('file','folder','module') and not exists (select 1 from e where e.branch = n.branch and e.dst = n.id and e.kind in ('calls','uses')) group by 1),
cy as (select branch, count(distinct component) as c from scc group by 1), hb as (select d.branch, least(count(*), 10) as c from deg d join n on n.branch = d.branch and n.id = d.id where d.in_degree >= 5 group by 1)
select b.branch, coalesce(u.c, 0) as unused, coalesce(cy.c, 0) as cycles, coalesce(hb.c, 0) as hubs, case when coalesce(cy.c, 0) > 0 or coalesce(hb.c, 0) > 5 then 'HIGH' when coalesce(u.c, 0) > 20 or coalesce(hb.c, 0) > 0 then 'MEDIUM' else 'LOW' end as severity
from (select distinct branch from n) b left join u using (branch) left join cy using (branch) left join hb using (branch)""")
def health(spark, sf):
    return A.health(_g(spark, sf))


@query()
def clusters(spark, sf):
    g = _g(spark, sf)
    return A.cluster_report(g, A.label_propagation(g))


@query()
def clusters_sequential(spark, sf):
    g = _g(spark, sf)
    return A.cluster_report(g, A.sequential_clusters(g))


@query(_BASE + """, rk as (select branch || ':' || file as query, file, cast(row_number() over (partition by branch, file order by coalesce(loc, 0) desc, id) as int) as place, kind from n where file is not null),
t as (select distinct query, kind as tf from rk where kind in ('method', 'struct')), c as (select query, count(*) as n_true from t group by 1),
s as (select r.query, min(case when t.tf is not null then r.place end) as first, sum(case when t.tf is not null and r.place <= 5 then 1 else 0 end) as at5, count(distinct t.tf) as found from rk r left join t on t.query = r.query and t.tf = r.kind group by 1)
select c.query, round(coalesce(1.0 / s.first, 0.0), 6) as mrr, round(coalesce(s.at5, 0) / 5.0, 6) as precision_at_5, round(coalesce(s.found, 0) / c.n_true, 6) as file_recall from c left join s using (query)""")
def relevance(spark, sf):
    from pyspark.sql import Window

    n = _g(spark, sf).nodes.where("file is not null")
    w = Window.partitionBy("branch", "file").orderBy(F.coalesce("loc", F.lit(0)).desc(), "id")
    ranked = n.select(F.concat_ws(":", "branch", "file").alias("query"), F.row_number().over(w).alias("place"), F.col("kind").alias("file"))
    truth = ranked.where("file in ('method', 'struct')").select("query", "file").distinct()
    return A.relevance(ranked, truth)


@query(_BASE + "select round(exp(avg(ln(loc))), 6) as geomean, round(quantile_cont(loc, 0.5), 6) as median from n where loc > 0")
def geometric_mean(spark, sf):
    return A.geometric_mean(_g(spark, sf).nodes, "loc")


# ---- search ---------------------------------------------------------------------------------------------------------


@query(_BASE + f"select branch, id, array_to_string({_TOKENS.format(x='name')}, ' ') as tokens from n where name is not null")
def tokenize(spark, sf):
    return _g(spark, sf).nodes.where("name is not null").select("branch", "id", F.concat_ws(" ", C.tokenize(F.col("name"))).alias("tokens"))


@query(_BASE + "select branch, id, cast(case when abs(length(lower(name)) - 11) > 3 then 1000000 else levenshtein(lower(name), 'policytable') end as int) as distance from n where name is not null")
def edit_distance(spark, sf):
    return _g(spark, sf).nodes.where("name is not null").select("branch", "id", C.edit_distance(F.lower("name"), F.lit("policytable")).cast("int").alias("distance"))


def _score_sql(text: str) -> str:
    low, toks = text.lower(), C.query_tokens(text)
    has = " and ".join(f"list_contains(tk, '{t}')" for t in toks)
    over = " + ".join(f"cast(list_contains(tk, '{t}') as int)" for t in toks if len(t) >= 3)
    typo = ""
    if 4 <= len(low) <= 15:
        d = f"(case when abs(length(ln) - {len(low)}) > 3 then 1000000 else levenshtein(ln, '{low}') end)"
        typo = f" when length(ln) <= 25 and {d} <= 1 then 20 when length(ln) <= 25 and {d} <= 2 then 10"
    return f"""case when kind = 'section' then null else (case when ln = '{low}' then 100 when starts_with(ln, '{low}') then 60 when {has} then 50 when contains(ln, '{low}') then 30
      when {over} > 0 then 10 + least(5 * ({over}), 15) when contains(lower(qualified_name), '{low}') then 10{typo} end)
    + (case when kind in ('function','method') then 5 when kind in ('struct','trait','interface') then 4 when kind in ('enum','type_alias') then 3 when kind in ('constant','macro','annotation') then 2 when kind = 'file' then -25 when kind = 'folder' then -45 else 0 end)
    + (case when name = '{text}' then 8 else 0 end) + (case when {_TEST.format(f='file')} then -45 else 0 end) end"""


def _candidates_sql(text: str) -> str:
    words = dict.fromkeys([text.lower(), *(t for t in C.query_tokens(text) if len(t) >= 3)])
    return "coalesce(" + " or ".join(f"contains(lower(name), '{w}') or contains(lower(qualified_name), '{w}')" for w in words) + ", false)"


def _lex(text: str) -> str:
    """Candidates hold the query or one of its tokens; in a branch without any, all nodes are candidates."""
    has = _candidates_sql(text)
    return _BASE + (
        f", hits as (select branch from n group by 1 having bool_or({has})), tn as (select *, lower(name) as ln, {_TOKENS.format(x='name')} as tk from n where {has} or branch not in (select branch from hits)), "
        f"sc as (select branch, id, name, qualified_name, file, {_score_sql(text)} as score from tn) "
    )


@query(_lex(QUERY) + "select branch, id, cast(score as int) as score from sc where score is not null")
def lexical_scores(spark, sf):
    return S.lexical(_g(spark, sf).nodes, QUERY, None).select("branch", "id", F.col("score").cast("int").alias("score"))


@query(_lex("PolicyTable") + "select branch, id, cast(score as int) as score from sc where score is not null order by score desc, length(name), qualified_name, branch, id limit 10")
def lexical_search(spark, sf):
    return S.lexical(_g(spark, sf).nodes, "PolicyTable").select("branch", "id", F.col("score").cast("int").alias("score"))


@query("""with q as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 100 = 0), s as (select q.query_id, e.vec_id, list_cosine_similarity(q.qv, e.embedding::double[]) as sim from q cross join embeddings e)
select query_id, vec_id, round(sim, 6) as similarity, cast(place as int) as place from (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as place from s where sim >= 0.5) where place <= 10""")
def cosine_topk(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return S.cosine_top_k(v, q, 10)


@query(_BASE + """, a as (select branch, file, id, row_number() over (partition by branch, file order by coalesce(loc, 0) desc, id) as place from n where file is not null), b as (select branch, file, id, row_number() over (partition by branch, file order by coalesce(complexity, 0) desc, id) as place from n where file is not null),
f as (select branch, file, id, round(sum(1.0::double / (60 + place)), 9) as rrf from (select * from a union all select * from b) group by 1, 2, 3)
select branch, file, id, rrf, cast(row_number() over (partition by branch, file order by rrf desc, id) as int) as place from f""")
def rrf(spark, sf):
    from pyspark.sql import Window

    n = _g(spark, sf).nodes.where("file is not null")
    rank = lambda c: n.select("branch", "file", "id", F.row_number().over(Window.partitionBy("branch", "file").orderBy(F.coalesce(c, F.lit(0)).desc(), "id")).alias("place"))
    return S.reciprocal_rank_fusion([rank("loc"), rank("complexity")], ["branch", "file"])


@query()
def hybrid_search(spark, sf):
    g = _g(spark, sf, texts=True).branch("main")
    return S.hybrid(g.nodes, S.embed(S.node_text(g.nodes)), "policy table")


@query(_BASE + "select branch, count(distinct id) as indexed from n group by 1")
def vector_maintenance(spark, sf):
    """The semantic index after a refresh: dead ids pruned, missing ones embedded, so that every node is in it."""
    g = _g(spark, sf, texts=True)
    idx = S.maintain(spark.read.parquet(f"{sf}/node_vectors.parquet").where("size(vector) = 384"), g.nodes)
    return idx.groupBy("branch").agg(F.count_distinct("node_id").alias("indexed"))


@query(_BASE + "select branch, id as node_id, concat_ws(' ', kind, qualified_name, def_signature, def_doc, array_to_string(" + _TOKENS.format(x="name") + ", ' '), array_to_string(" + _TOKENS.format(x="list_last(string_split(replace(qualified_name, '::', '.'), '.'))") + ", ' ')) as text from n where name is not null and qualified_name is not null")
def node_text(spark, sf):
    return S.node_text(_g(spark, sf, texts=True).nodes.where("name is not null and qualified_name is not null"))


@query()
def budget_truncate(spark, sf):
    n = _g(spark, sf, texts=True).nodes.select("branch", "file", "start_line", "id", "name", "def_signature")
    return S.within_budget(n, ["branch", "file"], [F.col("start_line"), F.col("id")], 400).select("branch", "file", "id")


@query(_lex("PolicyTabel") + "select branch, id, cast(score as int) as score from sc where score is not null")
def misspelt_search(spark, sf):
    """A query that nothing holds: all nodes are scored, and edit distance finds them."""
    return S.lexical(_g(spark, sf).nodes, "PolicyTabel", None).select("branch", "id", F.col("score").cast("int").alias("score"))


# ---- symbols by name, changes, clusters -------------------------------------------------------------------------------


@query(_BASE + f"""select branch, name, case when count(*) = 1 then 'exact' else 'ambiguous' end as status, count(*) as candidates, arg_min(id, r) as id
from (select branch, name, id, row_number() over (partition by branch, name order by {_TEST.format(f='file')}, case visibility when 'pub' then 0 when 'pub_crate' then 1 else 2 end, file nulls first, qualified_name nulls first, id) as r
  from n where kind not in ({_NONCODE}) and name is not null) group by 1, 2""")
def resolve_names(spark, sf):
    return T.resolve_names(_g(spark, sf))


@query(_BASE + """, nm as (select distinct n.branch, n.name from n join deg d on d.branch = n.branch and d.id = n.id where d.in_degree >= 10 and n.name is not null),
hub as (select branch, id from (select n.branch, n.id, row_number() over (partition by n.branch, n.name order by n.kind = 'section', n.file nulls first, n.id) as r from n join nm on nm.branch = n.branch and nm.name = n.name) where r = 1)"""
       + _REACH.format(step=_ANY, depth=2) + "select r.branch, r.seed, r.id, r.hop from reached r join n on n.branch = r.branch and n.id = r.id")
def subgraph_by_name(spark, sf):
    """Nodes within two hops of the node that each name of a hub stands for."""
    g = _g(spark, sf)
    return T.subgraph_nodes(g, T.name_seeds(g.nodes, _hub_names(g)))


@query(_BASE + f"select id, kind, name, qualified_name, file, start_line from n where branch = '{BASE}' and id not in (select id from n where branch = '{HEAD}')")
def removed_nodes(spark, sf):
    g = _g(spark, sf)
    return R.removed_nodes(g.branch(BASE).nodes, g.branch(HEAD).nodes)


@query(_BASE + f""", ch as (select distinct id from n where branch = '{HEAD}' and id not in (select id from n where branch = '{BASE}')),
walk as (select id, 0 as hop from ch union select e.src, w.hop + 1 from walk w join e on e.dst = w.id and e.branch = '{HEAD}' and e.kind = 'calls' where w.hop < 2 and e.src not in (select id from ch)),
hit as (select distinct id from walk where hop > 0 and id in (select id from n where branch = '{HEAD}'))
select c.changed, h.affected, case when h.affected <= 5 then 'LOW' when h.affected <= 20 then 'MEDIUM' when h.affected <= 50 then 'HIGH' else 'CRITICAL' end as risk from (select count(*) as changed from ch) c, (select count(*) as affected from hit) h""")
def change_risk(spark, sf):
    g = _g(spark, sf)
    return T.change_risk(g.branch(BASE), g.branch(HEAD), 2)


@query(_BASE + "select b.branch, n.branch is null as empty from (select branch from e union select branch from n) b left join (select distinct branch from n) n on n.branch = b.branch")
def empty_branches(spark, sf):
    return A.empty_branches(_g(spark, sf))


@query()
def cluster_members(spark, sf):
    g = _g(spark, sf)
    return A.cluster_members(g, A.label_propagation(g))
