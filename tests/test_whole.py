"""Queries that once did less than the whole job, against brute force."""

import os
from collections import defaultdict

import duckdb
import pytest

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")


def sql_rows(sql):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f[:-8]} as select * from '{TABLES}/{f}'")
    return con.execute(sql).fetchall()


def graph_of(spark, links, names=None):
    from weftgraph.sources.graph import Graph

    names = names or {x: x for p in links for x in p}
    n = spark.createDataFrame([("b", i, v) for i, v in names.items()], "branch string, id string, name string")
    e = spark.createDataFrame([("b", x, y, "calls") for x, y in links], "branch string, src string, dst string, kind string")
    return Graph(n, e)


def shortest(steps, source, most):
    """{name: the smallest of the shortest paths from source}, the source itself through a cycle only."""
    best, front = {}, [(source,)]
    for _ in range(most):
        front = sorted({p + (b,) for p in front for b in steps[p[-1]]})
        for p in front:
            best.setdefault(p[-1], p)
        front = [p for p in front if best[p[-1]] == p]
    return best


def test_call_paths_of_six_hops(spark):
    from weftgraph.operators.traverse import call_paths

    links = [(f"n{i}", f"n{i + 1}") for i in range(8)] + [("n0", "x"), ("x", "n2"), ("n3", "n1"), ("n7", "n7")]
    steps = defaultdict(set)
    for a, b in links:
        steps[a].add(b)
    ids = sorted({x for p in links for x in p})
    pairs = spark.createDataFrame([("b", a, b) for a in ids for b in ids], "branch string, from_name string, to_name string")
    got = {(r.from_name, r.to_name): tuple(r.path) for r in call_paths(graph_of(spark, links), pairs).collect()}
    assert got == {(a, t): p for a in ids for t, p in shortest(steps, a, 6).items()}
    assert len(got["n0", "n6"]) == 7 and ("n0", "n7") not in got


@needs_tables
def test_trace_path_of_all_pairs_of_hub_names(spark):
    from weftgraph.plans import QUERIES
    from weftgraph.plans.graph import _HUBS

    steps, hubs = defaultdict(set), defaultdict(set)
    for br, a, b in sql_rows(_HUBS + "select e.branch, a.name, b.name from e join n a on a.branch = e.branch and a.id = e.src join n b on b.branch = e.branch and b.id = e.dst where e.kind = 'calls' and a.name is not null and b.name is not null"):
        steps[br, a].add((br, b))
    for br, name in sql_rows(_HUBS + "select distinct h.branch, n.name from hub h join n on n.branch = h.branch and n.id = h.id where n.name is not null"):
        hubs[br].add((br, name))
    want = set()
    for br, hs in hubs.items():
        for a in hs:
            want |= {(br, a[1], t[1], len(p) - 1, " ".join(x[1] for x in p)) for t, p in shortest(steps, a, 6).items() if t in hs}
    got = {(r.branch, r.from_name, r.to_name, r.hops, r.path) for r in QUERIES["trace_path"](spark, TABLES).collect()}
    assert got == want


def test_source_changes_sees_every_row_of_the_last_snapshot(spark, tmp_path):
    from weftgraph.plans import QUERIES

    schema = "branch string, snap_no int, id string, name string, file string, annotations array<string>, loaded_at int"
    both = {"same": ("k1", "a"), "content": ("k2", "a"), "others": ("k9", "a"), "moved": ("k4", "a")}
    rows = [(b, n, i, v, f, ["x", "y"] if b == "main" else ["y", "x", "y"], 1) for b, n in (("release/3", 5), ("main", 7)) for f, (i, v) in both.items()]
    rows += [
        ("main", 7, "k2", "b", "content", None, 2),  # loaded later, so it stands
        ("release/3", 5, "k8", "a", "others", None, 1), ("main", 7, "k7", "a", "others", None, 1),  # the greatest id stays
        ("main", 6, "k99", "a", "same", None, 1), ("release/3", 4, "k5", "a", "gone", None, 1),  # older snapshots
        ("main", 7, "k4", "a", "target", None, 2), ("main", 7, None, "a", "same", None, 1), ("main", 7, "k6", "a", None, None, 1), ("x", 9, "k3", "a", "same", None, 1),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/node_snapshots.parquet")
    got = {(r.path, r.change) for r in QUERIES["source_changes"](spark, str(tmp_path)).collect()}
    assert got == {("content", "Modified"), ("others", "Modified"), ("moved", "Deleted"), ("target", "Added")}


def longest(links):
    """{(ancestor, descendant): most hops} among ids that are neither on a cycle nor below one."""
    up = defaultdict(set)
    for a, b in links:
        up[b].add(a)
    out, ids = {}, {x for p in links for x in p}
    for i in ids:
        front, k, pairs = {i}, 0, {}
        while front and k <= len(ids):
            front, k = {p for x in front for p in up[x]}, k + 1
            pairs |= {(p, i): k for p in front}
        if not front:
            out |= pairs
    return out


def test_descendants_through_every_parent(spark):
    import random

    from weftgraph.operators.hierarchy import descendants

    diamond = [("r", "a"), ("r", "b"), ("a", "k"), ("b", "k"), ("k", "m"), ("m", "o"), ("r", "o"), ("q", "b"), ("z", "y"), ("y", "w"), ("c", "c"), ("c", "d"), ("a", "d")]
    rng = random.Random(5)
    dag = [(f"n{min(p)}", f"n{max(p)}") for p in (rng.sample(range(14), 2) for _ in range(24))]
    plain = [("r", "a"), ("r", "b"), ("a", "k"), ("b", "k")]
    for links in (plain, diamond, dag, [("r", "a"), ("a", "b")]):
        df = spark.createDataFrame([("b", x, y, "contains") for x, y in links], "branch string, src string, dst string, kind string")
        got = [((r.ancestor, r.descendant), r.hops) for r in descendants(df).collect()]
        assert len(got) == len(dict(got)) and dict(got) == longest(links)


def tables():
    """Nodes {(branch, id): name}, edges [(branch, src, dst, kind)] and hubs [(branch, id)] of the fixture."""
    from weftgraph.plans.graph import _HUBS

    n = {(b, i): x for b, i, x in sql_rows(_HUBS + "select branch, id, name from n")}
    return n, sql_rows(_HUBS + "select branch, src, dst, kind from e"), sql_rows(_HUBS + "select branch, id from hub")


def rows_of(spark, name, *cols):
    from weftgraph.plans import QUERIES

    return [tuple(r[c] for c in cols) for r in QUERIES[name](spark, TABLES).select(*cols).collect()]


def within(steps, seed, most):
    """{id: hops} of what lies within so many hops of seed, which has 0."""
    hops, front = {seed: 0}, {seed}
    for k in range(1, most + 1):
        front = {y for x in front for y in steps[x]} - set(hops)
        hops |= {y: k for y in front}
    return hops


@needs_tables
@pytest.mark.parametrize("name", ["callers_deep", "callees_deep"])
def test_reach_of_hub_names_over_five_hops(spark, name):
    n, e, hubs = tables()
    steps = defaultdict(set)
    for b, s, d, k in e:
        if k == "calls" and (b, s) in n and (b, d) in n:
            at, to = (d, s) if name == "callers_deep" else (s, d)
            steps[b, n[b, at]].add(to)
    want = set()
    for b, seed in {(b, n[b, i]) for b, i in hubs if n[b, i] is not None}:
        hops, names = {}, {seed}
        for k in range(1, 6):
            new = {i for x in names for i in steps[b, x]} - set(hops)
            hops |= {i: k for i in new}
            names = {n[b, i] for i in new} - {None}
        want |= {(b, seed, i, k) for i, k in hops.items()}
    got = rows_of(spark, name, "branch", "seed", "id", "hop")
    assert sorted(got) == sorted(want) and max(r[3] for r in got) > 3


@needs_tables
def test_subgraphs_of_two_hops(spark):
    n, e, hubs = tables()
    steps = defaultdict(set)
    for b, s, d, _ in e:
        steps[b, s].add((b, d))
        steps[b, d].add((b, s))
    want = {(h[0], h[1], i[1], k) for h in hubs for i, k in within(steps, h, 2).items() if i in n}
    got = rows_of(spark, "subgraph_nodes", "branch", "seed", "id", "hop")
    assert sorted(got) == sorted(want) and max(r[3] for r in got) == 2
    of = defaultdict(set)
    for b, seed, i, _ in want:
        of[b, seed].add(i)
    links = {(b, h, s, d, k) for b, s, d, k in e for bb, h in hubs if b == bb and s in of[b, h] and d in of[b, h]}
    assert sorted(rows_of(spark, "subgraph_edges", "branch", "seed", "src", "dst", "kind")) == sorted(links)


@needs_tables
def test_one_and_two_hop_queries_have_every_node(spark):
    from weftgraph.plans.graph import SQL

    n, e, hubs = tables()
    up, seen = defaultdict(set), {(b, s, d, k) for b, s, d, k in e if (b, s) in n or (b, d) in n}
    for b, s, d, k in e:
        if k == "calls":
            up[b, d].add((b, s))
    want = {(x[0], x[1], i[1], k) for x in n for i, k in within(up, x, 2).items() if k and i in n}
    assert sorted(rows_of(spark, "callers_exact", "branch", "seed", "id", "hop")) == sorted(want)
    assert sorted(rows_of(spark, "neighbourhood", "branch", "src", "dst", "kind")) == sorted(seen)
    for q, cols in {"callers_exact": ("branch", "seed", "id", "hop", "confidence", "is_test", "place"), "relation_digest": ("branch", "seed", "relation", "other_id", "confidence", "is_test", "place"), "relation_counts": ("branch", "seed", "relation", "n")}.items():
        got = rows_of(spark, q, *cols)
        assert sorted(got) == sorted(sql_rows(f"select {', '.join(cols)} from ({SQL[q]})")) and not {r[:2] for r in got} <= set(hubs)
