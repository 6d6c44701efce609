"""Searches by bits against plain Python, and against the joins that take over where a graph is too large for them."""

import random

import pytest
from test_whole import graph_of, shortest, within


def random_graph(spark, n=150, m=420, names=60):
    from weftgraph.sources.graph import Graph

    rng = random.Random(3)
    label = {f"i{k}": None if k % 29 == 0 else f"é{k % names}" for k in range(n)}
    links = {(f"i{rng.randrange(n + 9)}", f"i{rng.randrange(n + 9)}") for _ in range(m)}  # nine ends are no nodes
    return Graph(
        spark.createDataFrame([(b, i, x) for b in ("b", "c") for i, x in label.items()], "branch string, id string, name string"),
        spark.createDataFrame([("b", x, y, "calls") for x, y in links], "branch string, src string, dst string, kind string"),
    ), label, links


def some(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("direction", ["in", "out"])
def test_reach_by_name_in_blocks_equals_joins(spark, direction):
    from weftgraph.operators import bitreach, traverse

    g, label, _ = random_graph(spark)
    seeds = g.nodes.where("name is not null").select("branch", "name").union(spark.createDataFrame([("b", "none")], "branch string, name string"))
    joined = some(traverse.reach_by_name(g, seeds, 5, direction, most=0))
    assert joined and some(traverse.reach_by_name(g, seeds, 5, direction)) == joined
    rows = bitreach.BATCH
    try:
        bitreach.BATCH = 64
        assert some(traverse.reach_by_name(g, seeds, 5, direction)) == joined
    finally:
        bitreach.BATCH = rows


@pytest.mark.parametrize("direction", ["in", "out", "both"])
def test_subgraph_nodes_in_blocks(spark, direction):
    from collections import defaultdict

    from weftgraph.operators import traverse

    g, label, links = random_graph(spark)
    steps = defaultdict(set)
    for a, b in links:
        if direction != "in":
            steps[a].add(b)
        if direction != "out":
            steps[b].add(a)
    want = {("b", s, i, k) for s in label for i, k in within(steps, s, 2).items() if i in label} | {("c", s, s, 0) for s in label}
    assert some(traverse.subgraph_nodes(g, g.nodes.select("branch", "id"), 2, direction)) == want
    assert some(traverse.subgraph_nodes(g, g.nodes.select("branch", "id"), 2, direction, most=0)) == want


def test_paths_among_all_names_equal_brute_force(spark):
    from collections import defaultdict

    from weftgraph.operators import traverse

    g, label, links = random_graph(spark)
    steps = defaultdict(set)
    for a, b in links:
        if label.get(a) and label.get(b):
            steps[label[a]].add(label[b])
    ends = sorted({x for x in label.values() if x})[::2]
    df = spark.createDataFrame([("b", x) for x in [*ends, "none"]], "branch string, name string")
    want = {(a, t, len(p) - 1, p) for a in ends for t, p in shortest(steps, a, 6).items() if t in ends}
    for most in (10**6, 0):
        got = [(r.from_name, r.to_name, r.hops, tuple(r.path)) for r in traverse.paths_among(g, df, most=most).collect()]
        assert len(got) == len(want) and set(got) == want
        assert {r.path for r in traverse.paths_among(g, df, most=most, sep=" ").collect()} == {" ".join(p) for *_, p in want}


@pytest.mark.parametrize("way", ["subgraph_nodes", "reach_by_name", "paths_among"])
def test_reached_pairs_are_not_stored(spark, way):
    """Neither checkpoints nor anything else there holds a row for each pair of seed and node."""
    import os

    from weftgraph.operators import traverse
    from weftgraph.session import ensure_checkpoint_dir

    g = graph_of(spark, [(f"s{i}", "hub") for i in range(300)] + [("hub", f"t{i}") for i in range(300)])
    seeds = g.nodes if way == "subgraph_nodes" else g.nodes.select("branch", "name")
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs)
    before = size()
    assert getattr(traverse, way)(g, seeds, 2).count() > 90_000 and size() - before < 1_000_000


def test_copies_of_the_graph_do_not_grow_with_partitions(spark):
    """A graph goes to two tasks a core at most, and the seeds are found once; the rows stay whole."""
    from weftgraph.operators import bitreach

    found = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b

    n = 64 * 64
    ids = spark.range(n, numPartitions=1).selectExpr("'b' branch", "cast(id as int) x", "concat('n', id) s")
    steps = ids.selectExpr("branch", "x", "cast((x + 1) % 4096 as int) y")
    nodes, seeds = ids.selectExpr("branch", "x", "cast(null as int) y", "s"), ids.mapInArrow(counted, ids.schema)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        copies = bitreach._blocks(steps, nodes, ids).where(f"what = {bitreach.STEP}").count()
        assert 1 < copies <= 2 * spark.sparkContext.defaultParallelism
        want = {("b", f"n{i}", f"n{(i + k) % n}", k) for i in range(n) for k in range(3)}
        assert some(bitreach.search(steps, nodes, seeds, 2).select("branch", "seed", "id", "hop")) == want and found.value == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tables_of_a_block_are_freed_while_it_is_searched():
    """The rows of steps and nodes are not held beside the lists made of them."""
    import pyarrow as pa

    from weftgraph.operators import bitreach

    n = 400_000
    s = pa.array([f"{i:016x}" for i in range(n)])
    rows = lambda what, x, y, s: pa.RecordBatch.from_pydict({"branch": ["b"] * len(x), "block": pa.array([0] * len(x), pa.int32()), "what": pa.array([what] * len(x), pa.int32()), "x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32()), "s": s})
    ids = range(n)
    given = [rows(bitreach.NODE, ids, ids, s), rows(bitreach.STEP, ids, [*range(1, n), 0], pa.nulls(n, pa.string())), rows(bitreach.SEED, [5], [0], pa.array(["n5"]))]
    packed = [p for b in given for p in bitreach._pack(iter([b]))]
    del given
    before = pa.total_allocated_bytes()
    found = bitreach._search(3, False, True)(iter(packed))
    first = next(found)
    assert pa.total_allocated_bytes() - before < 1.5 * s.nbytes  # the ids and little more
    assert [r for b in [first, *found] for r in b.to_pylist()] == [{"branch": "b", "id": f"{5 + k:016x}", "hop": k, "seeds": ["n5"]} for k in (1, 2, 3)]
