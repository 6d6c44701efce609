"""Skewed aggregation, snapshot changes and hierarchies against plain Python."""

import random
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftgraph.operators import hierarchy as H
from weftgraph.operators.components import strong_components
from weftgraph.operators.skew import grouped_rank, in_degree, salted_aggregate
from weftgraph.operators.snapshots import snapshot_changes

EDGES = "branch string, src string, dst string, kind string"
SNAP = "branch string, snap_no int, id string, name string, annotations array<string>, loaded_at int"


def test_in_degree_under_skew_equals_plain_counts(spark):
    rng = random.Random(1)
    rows = [("main", f"s{rng.randrange(400)}", "hot" if rng.random() < 0.4 else f"d{rng.randrange(60)}", "calls") for _ in range(3000)]
    rows += [("main", None, "d1", "calls"), ("main", "s1", None, "calls"), (None, "s1", "d1", "calls"), ("main", "s1", "d1", "uses"), ("main", "s1", "", "calls")]
    want = defaultdict(set)
    for b, s, d, k in rows:
        if k == "calls" and d is not None:
            want[b, d].add(s)
    want = {k: len({x for x in v if x is not None}) for k, v in want.items()}
    df = spark.createDataFrame(rows, EDGES)
    for per_task in (None, 1, 50):
        assert {(r.branch, r.dst): r.in_degree for r in in_degree(df, per_task=per_task).collect()} == want
    assert in_degree(df.limit(0)).count() == 0
    wide = df.selectExpr("*", "1 as __salt_note", "kind as name")
    assert in_degree(wide, min_degree=10).where("in_degree < 10").count() == 0


def test_salted_aggregate_sums(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).selectExpr("case when id % 3 = 0 then 'a' else cast(id % 50 as string) end as k", "id")
    out = salted_aggregate(df, ["k"], [F.sum("id").alias("s")], [F.sum("s").alias("s")], ["id"], per_task=20)
    assert sorted((r.k, r.s) for r in out.collect()) == sorted((r.k, r.s) for r in df.groupBy("k").agg(F.sum("id").alias("s")).collect())


def test_grouped_rank_is_a_permutation_of_each_group(spark):
    df = spark.range(500).selectExpr("case when id < 300 then null else id % 7 end as g", "id")
    got = defaultdict(list)
    for r in grouped_rank(df, ["g"], "id", buckets=8).collect():
        got[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got[None]) == 300


def brute_changes(rows):
    last = {}
    for b, s, i, n, a, v in rows:
        key = (b, s, i)
        if key not in last or v > last[key][0]:
            last[key] = (v, n, None if a is None else frozenset(a))
    snaps = defaultdict(set)
    for b, s, _ in last:
        snaps[b].add(s)
    out = set()
    for b, ss in snaps.items():
        order = sorted(ss)
        for p, c in zip(order, order[1:]):
            old = {i: x[1:] for (bb, s, i), x in last.items() if (bb, s) == (b, p)}
            new = {i: x[1:] for (bb, s, i), x in last.items() if (bb, s) == (b, c)}
            out |= {(b, c, i, "added") for i in new.keys() - old.keys()} | {(b, c, i, "removed") for i in old.keys() - new.keys()}
            out |= {(b, c, i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    return out


def test_snapshot_changes(spark):
    rng = random.Random(3)
    rows = []
    for b in ("main", "x"):
        for s in (1, 2, 5) if b == "main" else (4, 6):
            for i in range(120):
                if rng.random() < 0.9:
                    ann = rng.choice([None, [], ["a", "b"], ["b", "a"], ["a", "b", "a"]])
                    rows.append((b, s, f"{i:03d}", rng.choice(["n", "n", "n", "m", None]), ann, 1))
                    if rng.random() < 0.1:
                        rows.append((b, s, f"{i:03d}", "later", ann, 2))
                    if rng.random() < 0.05:
                        rows.append(rows[-1])
    df = spark.createDataFrame(rows, SNAP)
    for size in (1, 4, 64):
        got = {(r.branch, r.snap_no, r.id, r.delta_kind) for r in snapshot_changes(df, mean_chunk=size).collect()}
        assert got == brute_changes(rows)


def test_snapshot_edge_cases(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0
    one = spark.createDataFrame([("b", 1, "i", "n", None, 1), (None, 1, "i", "n", None, 1), ("b", 1, None, "n", None, 1)], SNAP)
    assert snapshot_changes(one).count() == 0
    gap = spark.createDataFrame([("b", 1, "i", "n", None, 1), ("b", 2, "j", "n", None, 1), ("b", 3, "i", "n", None, 1), ("b", 3, "j", "n" * 100_000, [], 1)], SNAP)
    got = {(r.snap_no, r.id, r.delta_kind) for r in snapshot_changes(gap).collect()}
    assert got == {(2, "i", "removed"), (2, "j", "added"), (3, "i", "added"), (3, "j", "changed")}


def test_snapshot_renamed_and_exchanged_keys(spark):
    rng = random.Random(4)
    rows = [("b", 1, f"k{i}", f"n{i}", None, 1) for i in range(60)]
    rows += [("b", 2, f"k{i}z" if i in (3, 40) else f"k{i}", f"n{({8: 9, 9: 8}).get(i, i)}", None, 1) for i in range(60)]
    for s in (3, 4, 5):  # random renames and swaps among keys that sort next to each other
        last = [r for r in rows if r[1] == s - 1]
        names = [r[3] for r in last]
        for _ in range(6):
            i, j = rng.randrange(60), rng.randrange(60)
            names[i], names[j] = names[j], names[i]
        rows += [("b", s, r[2] + ("y" if rng.random() < 0.1 else ""), n, None, 1) for r, n in zip(last, names, strict=True)]
    df = spark.createDataFrame(rows, SNAP)
    for size in (1, 4, 64, 10_000):
        got = {(r.branch, r.snap_no, r.id, r.delta_kind) for r in snapshot_changes(df, mean_chunk=size).collect()}
        assert got == brute_changes(rows)
        assert {("b", 2, "k3", "removed"), ("b", 2, "k3z", "added"), ("b", 2, "k8", "changed"), ("b", 2, "k9", "changed")} <= got


def brute_hierarchy(links):
    """{id: set of (status, root, depth)} for links (a, b) of one branch."""
    links = set(links)
    ids = {x for p in links for x in p}
    up = defaultdict(set)
    for a, b in links:
        up[b].add(a)
    reach = {}
    for i in ids:
        seen, todo = set(), list(up[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        reach[i] = seen
    cyc = {i for i in ids if i in reach[i]}
    out = {}

    def depths(i):
        if not up[i]:
            return {i: 0}
        d = {}
        for p in up[i]:
            for r, k in depths(p).items():
                d[r] = max(d.get(r, -1), k + 1)
        return d

    for i in ids:
        if i in cyc:
            out[i] = {("CYCLE", -1)}
        elif reach[i] & cyc:
            out[i] = {("BELOW", -1)}
        else:
            out[i] = set(depths(i).items())
    return out


def check_hierarchy(spark, links):
    df = spark.createDataFrame([("b", a, b, "contains") for a, b in links], EDGES)
    got = defaultdict(set)
    for r in H.hierarchy(df).collect():
        got[r.id].add((r.root_id, r.node_depth))
        if r.status == "tree":
            assert r.path[0] == r.root_id and r.path[-1] == r.id and len(r.path) == r.node_depth + 1
    assert dict(got) == brute_hierarchy(links)


def test_hierarchy_chain_cycle_and_tail(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(14)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("c3", "x"), ("z", "t1"), ("t1", "t2"), ("t2", "t3")]
    check_hierarchy(spark, chain + cycle + [("s", "s"), ("s", "u"), ("r", "d"), ("q", "d"), ("d", "e"), ("r", "e")])


def test_hierarchy_nulls_repeats_and_empty(spark):
    rows = [("b", "r", "k", "contains")] * 3 + [("b", None, "k", "contains"), ("b", "r", None, "contains"), (None, "r", "k", "contains"), ("b", "r", "q", "calls")]
    df = spark.createDataFrame(rows, EDGES)
    assert {(r.id, r.root_id, r.node_depth) for r in H.hierarchy(df).collect()} == {("r", "r", 0), ("k", "r", 1)}
    assert H.hierarchy(df.limit(0)).count() == 0 and H.deep_or_cyclic(df.limit(0)).count() == 0
    assert [(r.ancestor, r.descendant, r.hops) for r in H.descendants(df).collect()] == [("r", "k", 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=12))
def test_hierarchy_random(spark, pairs):
    check_hierarchy(spark, [(f"n{a}", f"n{b}") for a, b in pairs])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=16))
def test_components_random(spark, pairs):
    links = {(f"n{a}", f"n{b}") for a, b in pairs}
    down = defaultdict(set)
    for a, b in links:
        down[a].add(b)

    def reach(i):
        seen, todo = set(), list(down[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += down[x]
        return seen

    r = {x: reach(x) for p in links for x in p}
    want = {x: min([y for y in r[x] if x in r[y]]) for x in r if x in r[x]}
    df = spark.createDataFrame([("b", a, b) for a, b in links], "branch string, src string, dst string")
    assert {x.id: x.component for x in strong_components(df).collect()} == want
