"""Nearest vectors against brute force; packing and mixing by their rules."""

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import mixing as M
from weftgraph.llm import packing as K
from weftgraph.llm import tokens as T
from weftgraph.llm import vectors as V


def brute(rows, k):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = {}
    for a in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]
        out[ids[a]] = [ids[j] for j in order]
    return out


def test_nearest_equals_brute_force_on_few_and_recalls_on_many(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 384))
    rows = {f"v{i:04d}": (centres[i % 60] + 0.4 * rng.normal(size=384)).astype(np.float32).tolist() for i in range(1500)}
    df = spark.createDataFrame(list(rows.items()), "node_id string, vector array<float>")
    got = defaultdict(list)
    for r in V.nearest(df).orderBy("id", "place").collect():
        got[r.id].append(r.other)
    want = brute(rows, 5)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want))
    assert hits >= 0.98
    few = {k: rows[k] for k in list(rows)[:40]}
    got = defaultdict(list)
    for r in V.nearest(spark.createDataFrame(list(few.items()), "node_id string, vector array<float>")).orderBy("id", "place").collect():
        got[r.id].append(r.other)
    assert dict(got) == brute(few, 5)


def test_nearest_with_lists_below_lists(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 384))
    rows = {f"v{i:04d}": (centres[i % 150] + 0.3 * rng.normal(size=384)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "node_id string, vector array<float>")
    got = defaultdict(list)
    for r in V.nearest(df, list_size=16, block=100, sample=160).collect():
        got[r.id].append(r.other)
    want = brute(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want)) >= 0.95


def test_ids_with_several_vectors_take_the_first_by_value(spark):
    rng = np.random.default_rng(10)
    a, b = (rng.normal(size=384).astype(np.float32).tolist() for _ in range(2))
    low, high = (a, b) if a < b else (b, a)
    df = spark.createDataFrame([("x", low), ("y", low), ("y", high), ("z", high)], "node_id string, vector array<float>")
    got = {r.id: (r.other, round(r.cos, 6)) for r in V.nearest(df, k=1).collect()}
    assert got["x"] == ("y", 1.0) and got["y"] == ("x", 1.0) and got["z"][0] == "x"


def test_nearest_dirty_rows_and_hot_copies(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=384).astype(np.float32).tolist()
    rows = [(f"c{i:03d}", one) for i in range(30)] + [(f"d{i}", rng.normal(size=384).astype(np.float32).tolist()) for i in range(5)]
    rows += [("z", [0.0] * 384), ("s", [1.0] * 256), ("n", None), (None, one), ("c000", one), ("e", []), ("q", [float("nan")] + [1.0] * 383), ("h", [None] + [1.0] * 383)]
    df = spark.createDataFrame(rows, "node_id string, vector array<float>").selectExpr("*", "1 as id", "2 as v", "3 as cos")
    pairs = {(r.node_a, r.node_b) for r in V.similar_pairs(df).collect()}
    names = [f"c{i:03d}" for i in range(30)]
    want = set()
    for x in names:
        for y in [n for n in names if n != x][:5]:
            want.add(tuple(sorted((x, y))))
    assert pairs == want
    assert V.similar_pairs(df.limit(0)).count() == 0


def test_centroid_search_finds_the_nearest():
    rng = np.random.default_rng(7)
    c = rng.normal(size=(500, 64)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = c[rng.integers(500, size=300)] + 0.05 * rng.normal(size=(300, 64)).astype(np.float32)
    ids, _ = V.CentroidGraph(c).search(q, 1)
    assert (ids[:, 0] == (q @ c.T).argmax(1)).mean() >= 0.95


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
def test_packs_hold_every_item_once_and_waste_little(hist):
    cap = 50
    packs = K.plan_packs(hist, cap)
    used = defaultdict(int)
    for count, pattern in packs:
        assert count > 0 and sum(k * n for k, n in pattern) <= cap
        for k, n in pattern:
            used[k] += count * n
    assert dict(used) == hist
    total = sum(k * v for k, v in hist.items())
    assert sum(c for c, _ in packs) <= -(-total // cap) * 11 / 9 + 4 + sum(v for k, v in hist.items() if k > cap // 2)


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5] * 40 + [60, 100, 205, 0, 33, 67, 1, 99, 50, 50, 205, 305, 300, 200])] + [(99, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as piece_no", "2 as container_id", "3 as box_name")
    boxes = {"a": 100, "b": 64, "c": 7}
    out = K.pack(df, boxes).collect()
    for name, cap in boxes.items():
        got = [r for r in out if r.box_name == name]
        fill = defaultdict(int)
        per = defaultdict(int)
        for r in got:
            fill[r.container_id] += r.n_tokens
            per[r.doc_id] += r.n_tokens
        assert max(fill.values()) <= cap and dict(per) == {i: n for i, n in rows if n}
        assert {r.doc_id for r in got if r.piece_no > 0} == {i for i, n in rows if n > cap}
        assert len({(r.doc_id, r.piece_no) for r in got}) == len(got) and all(r.n_tokens == cap for r in got if r.piece_no + 1 < -(-dict(rows)[r.doc_id] // cap))
        assert sorted(fill) == list(range(len(fill)))
        if cap > 7:
            assert len(fill) <= 1 + sum(n for _, n in rows) // cap + 2
    assert K.pack(df.limit(0), boxes).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 90), st.integers(1, 5), min_size=1, max_size=12), st.integers(1, 40))
def test_offsets_number_every_piece_once(hist, cap):
    pieces, first = K.offsets(hist, cap)
    seen = defaultdict(list)
    for k, n in hist.items():
        for rank in range(n):
            if k <= cap:
                seen[k].append(rank)
                continue
            full, at_full, at_rest = first[k]
            seen[cap] += [at_full + rank * full + j for j in range(full)]
            if k % cap:
                seen[k % cap].append(at_rest + rank)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in pieces.items()}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(0, 400))
def test_fit_is_the_best_subset_sum(counts, budget):
    take = M.fit(counts, budget)
    assert all(0 < v <= counts[k] for k, v in take.items())
    got = sum(k * v for k, v in take.items())
    sums = {0}
    for k, v in counts.items():
        sums = {s + k * c for s in sums for c in range(v + 1)}
    assert got == max(s for s in sums if s <= budget)


def test_fit_takes_all_lengths_in_proportion():
    counts = {k: 1000 for k in range(3, 900, 7)}
    total = sum(k * v for k, v in counts.items())
    for budget in (10, 999, 123_457, 5_000_001, 40_000_000):
        take = M.fit(counts, budget)
        got = sum(k * v for k, v in take.items())
        assert got <= budget and budget - got <= 2
        if budget > 1_000_000:
            assert abs(sum(take.values()) / sum(counts.values()) - budget / total) < 0.01


def test_budgets_fill_what_small_sources_cannot_give():
    got = M.budgets({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 100, "c": 1000}, 1000)
    assert got == {"a": 642, "b": 100, "c": 257}
    assert M.budgets({"a": 0.5, "b": 0.5}, {"a": 10, "b": 0}, 1000) == {"a": 10, "b": 0}
    assert M.budgets({}, {}, 5) == {}


def test_mix(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(400)] + [(1000 + i, "b", 5) for i in range(40)] + [(2000, "c", 50), (2001, None, 3), (2002, "a", 0), (2003, "other", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 as uses", "2 as passes")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 4)], "source string, target_share double, max_repeats int")
    a = sum(n for _, s, n in rows if s == "a")
    used, report = M.mix(df, targets)  # b cannot give its share of all tokens and enters three times; a makes up for it
    rep = {r.source: r for r in report.collect()}
    assert rep["none"].actual_share == 0 and rep["b"].tokens == 600 and rep["b"].most_uses == 3 and rep["a"].tokens == a + 200 - 600
    used, report = M.mix(df, targets, total=1600)  # small enough for the shares among the sources that have documents
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["a"].actual_share - 0.625) < 0.002 and abs(rep["b"].actual_share - 0.375) < 0.002 and rep["a"].target_share == 0.5
    got = used.collect()
    assert all(r.uses <= {"a": 1, "b": 3}[r.source] for r in got) and {r.source for r in got} == {"a", "b"}
    for s in ("a", "b"):
        assert rep[s].tokens == sum(r.n_tokens * r.uses for r in got if r.source == s) and rep[s].documents == sum(r.source == s for r in got) and rep[s].most_uses == max(r.uses for r in got if r.source == s)
    assert sorted((r.doc_id, r.uses) for r in got) == sorted((r.doc_id, r.uses) for r in M.mix(df, targets, total=1600)[0].collect())
    used, report = M.mix(df.limit(0), targets)
    assert used.count() == 0 and report.count() == 3


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|> 页面 " * 2000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df).collect()}
    enc = T.encoder()
    assert got[1] == len(enc.encode_ordinary("hello world")) == 2 and got[2] == got[3] == 0 and got[4] > 4000
    assert enc.decode(enc.encode_ordinary("a  b\n\tc 页")) == "a  b\n\tc 页"
