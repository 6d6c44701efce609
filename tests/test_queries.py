"""Queries against their SQL in DuckDB, on a small fixture in the schema of the tables."""

import os
from datetime import datetime

import duckdb
import pytest

TABLES = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def core_queries():
    from weftgraph.plans import ORACLE

    return sorted(ORACLE)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
@pytest.mark.parametrize("name", core_queries())
def test_query_equals_sql(spark, name):
    from weftgraph.plans import ORACLE, QUERIES

    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f[:-8]} as select * from '{TABLES}/{f}'")
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want


def test_entry_without_the_llm_subpackage():
    import __spark_entry__ as e
    from weftgraph.plans import QUERIES

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_tokenizer_of_both_sides(spark):
    from pyspark.sql import functions as F

    from weftgraph.functions import columns as C

    names = ["HTTPClient", "parse_json-2", "fooBarBAZ", "a::b.c/d", "", "X", "Already done", "getURLFor"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", C.tokenize(F.col("n")).alias("t")).collect():
        assert list(r.t) == C.query_tokens(r.n)
    assert C.query_tokens("HTTPClient") == ["http", "client"]


def test_paths_and_predicates(spark):
    from pyspark.sql import functions as F

    from weftgraph.functions import columns as C

    rows = [("crates/a/src/x.rs", "crates/a"), ("pkg/src/x.py", "pkg"), ("src/x.py", "src"), ("apps/b/x.py", "apps/b"), ("x.py", "repository root"), ("a/b/x.py", "a")]
    df = spark.createDataFrame(rows, "f string, want string")
    assert all(r.got == r.want for r in df.select("want", C.cluster_for_file(F.col("f")).alias("got")).collect())
    tests = {"tests/a.py": True, "a/test_x.py": True, "a/x_test.go": True, "a/testing.rs": True, "a/contest.py": False, "a/XTest.java": True, "a/latest/x.py": False, "a/x.spec.ts": True, None: False}
    df = spark.createDataFrame(list(tests.items()), "f string, want boolean")
    assert all(r.got == r.want for r in df.select("want", C.is_test_file(F.col("f")).alias("got")).collect())
    one = spark.range(1).select(C.sanitize_branch(F.lit("1feat/a-b")).alias("b"), C.slugify(F.lit(" A b!C ")).alias("s"), C.symbol_candidate(F.lit("a::foo()")).alias("c"), C.symbol_candidate(F.lit("ab")).alias("d")).first()
    assert (one.b, one.s, one.c, one.d) == ("b_1feat__a_b", "a-b-c", "foo", None)


def test_budget_keeps_one_row_and_whole_prefixes(spark):
    from pyspark.sql import functions as F

    from weftgraph.operators.search import within_budget

    df = spark.createDataFrame([("g", i, "x" * 300) for i in range(20)] + [("h", 0, "y" * 9000)], "g string, i int, t string")
    got = within_budget(df, ["g"], [F.col("i")], 400)
    kept = sorted(r.i for r in got.where("g = 'g'").collect())
    assert kept == list(range(len(kept))) and 0 < len(kept) < 20 and got.where("g = 'h'").count() == 1
