"""Parsers, resolution, updates and streams on small sources."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Engine
from weftgraph.operators import analytics as A
from weftgraph.operators import export as X
from weftgraph.operators import lookup as L
from weftgraph.operators import resolve as R
from weftgraph.sources import files as FS
from weftgraph.sources import parsers as P
from weftgraph.sources.graph import Graph
from weftgraph.streaming import incremental as I

SOURCES = {
    "src/callee.rs": "/// Adds one.\npub fn compute_total(x: u32) -> u32 {\n    x + 1\n}\n\npub struct DataShelf {\n    pub a: u32,\n}\n",
    "src/caller.rs": "use crate::callee::compute_total;\n\npub fn run() -> u32 {\n    compute_total(1)\n}\n\npub fn run_guarded(x: u32) -> u32 {\n    if x > 1 {\n        return compute_total(x);\n    }\n    0\n}\n",
    "src/kinds.rs": "pub trait Worker {\n    fn work(&self);\n}\n\n#[derive(Clone)]\npub(crate) struct Bee<T: Send> {\n    x: T,\n}\n\nimpl Worker for Bee<u8> {\n    fn work(&self) {\n        helper();\n    }\n}\n\nasync unsafe fn helper() {}\n\npub enum Mode { A, B }\nconst LIMIT: u32 = 3;\nmacro_rules! hey { () => {} }\nmod inner {\n    pub fn deep() {}\n}\n",
    "app/shapes.py": "from typing import Protocol\nimport os\n\nMAX_SIZE = 3\n\n\nclass Drawable(Protocol):\n    def draw(self) -> None: ...\n\n\nclass Base:\n    '''A base.'''\n\n    @property\n    def size(self) -> int:\n        return self._size()\n\n    def _size(self):\n        if True:\n            for x in y:\n                pass\n        return 1\n\n\nclass Circle(Base):\n    @staticmethod\n    async def make(r: Base) -> 'Circle':\n        yield Circle()\n\n\ndef build(kind):\n    return Circle.make(kind)\n",
    "web/view.ts": "import { a, b as c } from './x';\n\nexport interface Shape {\n  area(): number;\n}\n\nexport class Square extends Polygon implements Shape {\n  private side = 1;\n  area(): number {\n    return square(this.side);\n  }\n  static *all() {\n    yield 1;\n  }\n}\n\nexport const square = (x: number) => x * x;\nconst LIMIT = 3;\nenum Color { Red }\ntype Alias = Shape | null;\n",
    "svc/main.go": "package svc\n\nimport \"fmt\"\n\ntype Runner interface {\n\tRun() error\n}\n\ntype Base struct{}\n\ntype Job struct {\n\tBase\n\tname string\n}\n\nvar _ Runner = &Job{}\n\n// Run runs.\nfunc (j *Job) Run() error {\n\tif j.name == \"\" {\n\t\treturn start(j)\n\t}\n\treturn nil\n}\n\nfunc start(j *Job) error { return nil }\n\nconst Max = 3\n",
    "jv/Shop.java": "package jv;\n\nimport java.util.List;\n\npublic class Shop extends Store implements Open, Shut {\n    private int x;\n\n    @Override\n    public List<Item> find(Query q) throws MissingException {\n        for (Item i : items) {\n            check(i);\n        }\n        return null;\n    }\n\n    protected static void check(Item i) {\n    }\n}\n\ninterface Open {\n}\n",
    "docs/guide.md": "# Guide\n\nSee `compute_total()` and [DataShelf](x).\n\n## Use\n\n```\n# no heading\n```\n\nCall `run`.\n",
}


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame([("main", p, t) for p, t in SOURCES.items()], "branch string, path string, source_text string")
    n, e, r = P.build(df)
    return Graph(n.persist(), e.persist()), r.persist()


def named(g, name, kind=None):
    rows = g.nodes.where(F.col("name") == name).collect()
    rows = [x for x in rows if kind is None or x.kind == kind]
    assert len(rows) == 1, (name, rows)
    return rows[0]


def links(g, kind):
    n = {r.id: r.name for r in g.nodes.select("id", "name").collect()}
    return {(n.get(r.src), n.get(r.dst)) for r in g.edges.where(F.col("kind") == kind).collect()}


def test_declarations(built):
    g, _ = built
    assert named(g, "compute_total").visibility == "pub" and named(g, "compute_total").complexity == 1 and named(g, "compute_total").qualified_name == "crate::compute_total"
    assert named(g, "run_guarded").complexity == 2 and named(g, "compute_total").def_doc == "/// Adds one."
    assert named(g, "Bee").visibility == "pub_crate" and named(g, "Bee").annotations == ["derive"] and named(g, "helper").is_async and named(g, "helper").is_unsafe
    assert {named(g, x).kind for x in ("Mode", "Worker", "hey")} == {"enum", "trait", "macro"} and named(g, "deep").qualified_name == "crate::inner::deep"
    assert named(g, "Drawable").kind == "interface" and named(g, "size").kind == "property" and named(g, "_size").visibility == "private" and named(g, "_size").complexity == 3
    make = named(g, "make")
    assert make.is_static and make.is_async and make.is_generator and make.qualified_name == "shapes.Circle.make" and named(g, "MAX_SIZE").kind == "constant"
    assert named(g, "Shape").kind == "interface" and named(g, "square").kind == "function" and named(g, "area", "method").visibility == "pub" and named(g, "all").is_generator and named(g, "Color").kind == "enum" and named(g, "Alias").kind == "type_alias"
    assert named(g, "Run", "method").qualified_name == "svc.Job.Run" and named(g, "Max").visibility == "pub" and named(g, "start").visibility == "private" and named(g, "Runner").kind == "interface"
    assert named(g, "find").annotations == ["Override"] and named(g, "check").visibility == "pub_crate" and named(g, "find").complexity == 2
    sections = [r.name for r in g.nodes.where("kind = 'section'").orderBy("start_line").collect()]
    assert sections == ["Guide", "Use"]


def test_edges(built):
    g, r = built
    calls = links(g, "calls")
    assert {("run", "compute_total"), ("run_guarded", "compute_total"), ("work", "helper"), ("area", "square"), ("Run", "start"), ("find", "check"), ("build", "make")} <= calls
    conf = {x.confidence for x in g.edges.where("kind = 'calls'").join(g.nodes.where("name = 'compute_total'").select(F.col("id").alias("dst")), "dst").collect()}
    assert conf == {"resolved"}
    assert ("Bee", "Worker") in links(g, "implements") and ("Circle", "Base") in links(g, "implements") and ("Square", "Shape") in links(g, "implements") and ("Shop", "Open") in links(g, "implements") and ("Job", "Runner") in links(g, "implements")
    assert ("Job", "Base") in links(g, "inherits") and ("make", "Base") in links(g, "uses")
    assert {("Guide", "compute_total"), ("Guide", "DataShelf"), ("Use", "run")} <= links(g, "references")
    assert ("Guide", "Use") in links(g, "contains") and ("Job", "Run") in links(g, "contains") and ("src", "caller.rs") in links(g, "contains") and ("caller.rs", "caller") in links(g, "contains")
    assert {x.target_name for x in r.where("ref_kind = 'throws'").collect()} == {"MissingException"}


def test_engine(spark, built):
    g, _ = built
    e = Engine(g, "main")
    assert {r.name for r in e.find_callers_of_name("compute_total").collect()} == {"run", "run_guarded"}
    status, rows, callers = e.find_callers("compute_total")
    assert status == "exact" and callers.count() == 2
    assert e.find_callers("Base")[0] == "ambiguous" and e.find_callers("compute_totl")[0] == "not_found"
    assert e.find_callers("compute_totl")[1][0]["name"] == "compute_total"
    assert {(r.module, r.depends_on) for r in e.module_dependencies("caller").collect()} == {("caller", "callee")}
    unused = {r.name for r in e.find_unused_symbols(limit=200).collect()}
    assert "DataShelf" in unused and "compute_total" not in unused
    assert e.trace_path("run", "compute_total") == ["run", "compute_total"] and e.trace_path("run", "nothing") == []
    assert e.search_code("compute_total").first()["name"] == "compute_total" and e.search_code("").count() == 0
    assert e.search_code("compute_totl").first()["name"] == "compute_total"
    assert "# compute_total" in e.wiki_symbol(rows[0]["id"]) and "called_by" in e.wiki_symbol(rows[0]["id"])
    assert {r.direction for r in e.type_hierarchy("Worker").collect()} == {"subtype"}
    assert e.start_tour("run").count() == 2 and e.get_subgraph("compute_total")[2].where("relation = 'called_by'").count() == 2
    with pytest.raises(LookupError):
        e.symbol_context("nothing")
    with pytest.raises(ValueError):
        L.attribute_filter()
    with pytest.raises(ValueError):
        L.attribute_filter(kind="thing")


def test_ids_do_not_depend_on_branch_or_line(spark):
    a = P.rows_of("main", "a.py", "def f():\n    pass\n")[0]
    b = P.rows_of("dev", "a.py", "\n\ndef f():\n    pass\n")[0]
    assert [x["id"] for x in a] == [x["id"] for x in b]
    assert P.rows_of("m", "a.unknown", "x")[0][0]["kind"] == "module" and P.rows_of("m", "b.py", "def f(:\n")[1] == []


def test_update_equals_full_build(spark, tmp_path):
    frame = lambda s: spark.createDataFrame([("main", p, t) for p, t in s.items()], "branch string, path string, source_text string")
    first = {k: v for k, v in SOURCES.items() if k.startswith("src/")}
    n, e, r = P.build(frame(first))
    store = I.GraphStore(spark, str(tmp_path / "g"))
    store.full_load(Graph(n, e), r)
    second = {**first, "src/callee.rs": first["src/callee.rs"].replace("DataShelf", "DataRack")}
    change = frame({"src/callee.rs": second["src/callee.rs"]})
    cn, ce, cr = P.split_parsed(P.parse_files(change))
    store.apply(cn, ce, change.select("branch", F.col("path").alias("file")), cr)
    g = store.read()
    want_n, want_e, _ = P.build(frame(second))
    code = lambda df: {(x.name, x.kind) for x in df.where("kind not in ('file', 'folder')").collect()}
    assert code(g.nodes) == code(want_n)
    assert links(g, "calls") == links(Graph(want_n, want_e), "calls") == {("run", "compute_total"), ("run_guarded", "compute_total"), ("work", "helper")}
    other = P.build(spark.createDataFrame([("dev/x y", "a.py", "def f():\n    pass\n")], "branch string, path string, source_text string"))
    files = spark.createDataFrame([("dev/x y", "a.py")], "branch string, file string")
    store.apply(other[0], other[1], files, other[2])
    assert {r.branch for r in store.read().nodes.select("branch").distinct().collect()} == {"main", "dev/x y"} and code(store.read().branch("main").nodes) == code(want_n)
    state = "file://" + str(tmp_path / "state")
    assert I.last_indexed(spark, state, "main") is None
    seen = []
    changes = lambda last: seen.append(last) or change.withColumn("change", F.lit("Modified"))
    again = lambda df: P.split_parsed(P.parse_files(df))
    assert I.update(store, state, "main", "c1", changes, again) and not I.update(store, state, "main", "c1", changes, again) and I.update(store, state, "main", "c2", changes, again)
    assert seen == [None, "c1"] and I.last_indexed(spark, state, "main") == "c2" and code(store.read().branch("main").nodes) == code(want_n)
    assert links(store.read().branch("main"), "calls") == links(Graph(want_n, want_e), "calls")
    store.wipe("main", state)
    assert store.read().branch("main").nodes.count() == 0 and store.refs().where("branch = 'main'").count() == 0 and I.last_indexed(spark, state, "main") is None
    assert store.read().branch("dev/x y").nodes.count() > 0


def test_index_stream(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "g")
    n, e, r = P.build(spark.createDataFrame([("main", "src/caller.rs", SOURCES["src/caller.rs"])], "branch string, path string, source_text string"))
    store = I.GraphStore(spark, root)
    store.full_load(Graph(n, e), r)
    assert links(store.read(), "calls") == set()
    schema = "branch string, path string, change string, source_text string"
    spark.createDataFrame([("main", "src/callee.rs", "Added", SOURCES["src/callee.rs"])], schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = I.index_stream(stream, lambda df: P.split_parsed(P.parse_files(df)), store, str(tmp_path / "c"))
    q.awaitTermination()
    assert links(store.read(), "calls") == {("run", "compute_total"), ("run_guarded", "compute_total")}


def test_state_and_staleness(spark, tmp_path):
    p = str(tmp_path / "state")
    assert I.last_indexed(spark, p, "main") is None
    I.write_state(spark, p, "main", "abc")
    assert I.last_indexed(spark, p, "main") == "abc" and I.last_indexed(spark, p, "dev") is None
    assert I.stale("abc", "abc") is None and "def" in I.stale("abc", "def") and "2 files" in I.stale("abc", "abc", 2)


def test_stream_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "click", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    got = I.run_to_table(I.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    want = {(r.window_start, r.event_type): r.n for r in I.windowed_counts(df).collect()}
    closed = {(r.window_start, r.event_type): r.n for r in got.collect()}
    assert closed and all(want[k] == v for k, v in closed.items())
    deduped = I.run_to_table(I.deduplicated(stream, ["user_id"], "30 days").select("user_id"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert deduped.count() == 3
    assert I.sessions(df, "30 minutes").agg(F.sum("n")).first()[0] == 60
    bursts = I.debounced(df.select(F.lit("a").alias("path"), "ts"), "8 minutes")
    assert bursts.count() == 1


def test_files(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.py").write_text("x = 1\n")
    (root / "a" / "y.txt").write_text("no")
    (root / "big.py").write_text("#" * 600_000)
    (root / "gen").mkdir()
    (root / "gen" / "z.py").write_text("z = 1\n")
    got = {r.path for r in FS.read_sources(spark, str(root), ["gen/", "# note", ""]).collect()}
    assert got == {"a/x.py"}
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env={**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"})
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    first = FS.head_sha(str(root))
    assert {(r.path, r.change) for r in FS.git_changes(spark, str(root)).collect()} == {("a/x.py", "Added"), ("big.py", "Added"), ("gen/z.py", "Added")}
    (root / "a" / "x.py").write_text("x = 2\n")
    (root / "big.py").unlink()
    git("mv", "gen/z.py", "gen/w.py")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert {(r.path, r.change) for r in FS.git_changes(spark, str(root), first).collect()} == {("a/x.py", "Modified"), ("big.py", "Deleted"), ("gen/z.py", "Deleted"), ("gen/w.py", "Added")}
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, blob string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, blob string")
    assert {(r.path, r.change) for r in FS.manifest_changes(old, new).collect()} == {("b", "Modified"), ("c", "Deleted"), ("d", "Added")}


def test_hunks_and_log(spark):
    diff = ["--- a/x.py", "+++ b/x.py", "@@ -1,2 +3,4 @@", "+a", "@@ -9 +12 @@ def f", "@@ -20,2 +20,0 @@", "+++ b/y.py", "@@ -0,0 +1,2 @@"]
    df = spark.createDataFrame(list(enumerate(diff)), "seq int, line string")
    assert {(r.file, r.h_start, r.h_end) for r in FS.diff_hunks(df).collect()} == {("x.py", 3, 6), ("x.py", 12, 12), ("y.py", 1, 2)}
    log = ["commit 100", "", "3\t1\ta.py", "-\t-\tb.png", "commit 200", "5\t0\ta.py", "1\t1\tvendor/c.py"]
    rows = FS.numstat_log(spark.createDataFrame(list(enumerate(log)), "seq int, line string"))
    hot = {r.path: (r.touches, r.additions, r.deletions, r.last_changed) for r in A.hot_files(rows).collect()}
    assert hot == {"a.py": (2, 8, 1, 200), "b.png": (1, 0, 0, 100)}


def test_exports(built):
    g, _ = built
    assert X.dot_lines(g).first()["line"].startswith("digraph") and X.graphml_lines(g).first()["line"].startswith("<?xml")
    assert X.cypher_lines(g).where("line like '%:CALLS]%'").count() > 0 and X.json_lines(g).where("kind_of = 'symbol'").count() > 10
    ring = X.ring_layout(g)
    assert ring.count() == g.nodes.count()
    assert "<svg" in X.svg_page(g) and "</script>" in X.html_page(g) and X.html_page(g).count("</script>") == 1
    lines = {r.line for r in X.markdown_map(g).where("file = 'svc/main.go'").collect()}
    assert any(x.startswith("  - `Run`") for x in lines) and any(x.startswith("- `Job`") for x in lines)
    assert X.top_symbols(g).where("place = 1").first()["name"] == "compute_total"
    assert X.upsert_block("a", "b") == X.upsert_block(X.upsert_block("a", "c"), "b")
    aff = g.nodes.select("id").limit(3).withColumn("hop", F.lit(1))
    assert "LOW" in X.blast_report(aff, 1) and '"affected": 3' in X.blast_report(aff, 1, "json")


def test_resolution_caps_and_scopes(spark):
    nodes = [("m", f"f{i}", "function", "many", f"a{i}.py") for i in range(9)] + [("m", f"g{i}", "function", "few", f"b{i}.py") for i in range(8)] + [("m", "h", "function", "other", "x.go"), ("m", "k", "constant", "konst", "c.py")]
    n = spark.createDataFrame(nodes, "branch string, id string, kind string, name string, file string")
    refs = [("m", "s", "s.py", t, "calls", 3) for t in ("many", "few", "other", "konst", "str", None, "gone")] + [("m", "s", "s.py", "few", "calls", 2), ("m", "s", "s.py", "few", "imports", 1)]
    e, u = R.resolve_references(spark.createDataFrame(refs, "branch string, src string, src_file string, target_name string, ref_kind string, line int"), n)
    got = e.where("kind = 'calls'").collect()
    assert {r.dst for r in got} == {f"g{i}" for i in range(8)} and {r.confidence for r in got} == {"resolved"} and {r.line for r in got} == {2}
    assert {r.target_name for r in u.collect()} == {"other", "konst", "gone"}


def test_cycles_and_clusters(spark):
    def graph(edges, kind):
        ids = sorted({x for p in edges for x in p})
        n = spark.createDataFrame([("m", i, "function", i, i, "f.py", 1) for i in ids], "branch string, id string, kind string, name string, qualified_name string, file string, start_line int")
        return Graph(n, spark.createDataFrame([("m", a, b, kind, None, None) for a, b in edges], "branch string, src string, dst string, kind string, line int, confidence string"))

    assert A.import_cycles(graph([("a", "b"), ("b", "c")], "imports")).count() == 0
    assert {r.id for r in A.import_cycles(graph([("a", "b"), ("b", "a"), ("c", "c")], "imports")).collect()} == {"a", "b"}
    assert A.import_cycles(graph([("a", "b"), ("b", "c"), ("c", "a")], "imports")).select("component").distinct().count() == 1
    assert A.import_cycles(graph([("a", "b"), ("b", "a")], "calls")).count() == 0
    two = graph([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")], "calls")
    for f in (A.label_propagation, A.sequential_clusters):
        labels = {r.id: r.label for r in f(two).collect()}
        assert len({labels[i] for i in "abc"} & {labels[i] for i in "xyz"}) == 0
    assert A.cluster_report(two, A.sequential_clusters(two)).count() == 2
