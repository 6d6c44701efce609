"""Most similar vectors for every vector, by balanced posting lists.

Centroids are fitted on a bounded sample and searched by a graph in memory.
Vectors near a border are stored in several lists; which lists a vector
searches is pruned by the ratio of its distances to their centroids. A list
that is still too long is cut into lists of its own, with centroids fitted in
the cluster, so the number of lists grows with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import checkpointed

#: The centroids of a level are fitted on at most so many vectors (below the first level, for each list); every vector is indexed.
SAMPLE = 20_000
#: Sample vectors for each centroid at least, and vectors wanted in a list.
SAMPLE_PER_LIST, LIST_SIZE = 8, 256
#: A list with more members is cut into lists of its own; below that level, into blocks that are compared in pairs.
BLOCK = 8_192
MEMBER_LISTS, MEMBER_RATIO = 2, 1.15
SEARCH_LISTS, SEARCH_RATIO = 4, 1.25
#: Up to so many centroids are all entries of the graph; a larger graph is walked.
ENTRIES = 512


def balanced_centroids(x: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Means of a balanced hierarchy: groups are halved along their two-means axis at the median."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(x))]
    while len(groups) < n_lists:
        groups.sort(key=len)
        big = groups.pop()
        if len(big) < 2:
            groups.append(big)
            break
        v = x[big]
        a, b = v[rng.integers(len(v))], v[rng.integers(len(v))]
        for _ in range(4):
            side = v @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = v[side].mean(0), v[~side].mean(0)
        axis = v @ (a - b)
        order = np.argsort(axis, kind="stable")
        half = len(big) // 2
        groups += [big[order[:half]], big[order[half:]]]
    c = np.stack([x[g].mean(0) for g in groups]).astype(np.float32)
    for _ in range(2):  # two rounds of means by nearest centroid, empty ones stay
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        seen = np.bincount(near, minlength=len(c)) > 0
        c[seen] = sums[seen]
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class CentroidGraph:
    """Centroids with their nearest neighbours as a graph, searched best first in batches."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, entries: int = ENTRIES, seed: int = 11) -> None:
        self.c = centroids
        n = len(centroids)
        self.whole = n <= entries
        if self.whole:
            return
        degree = min(degree, max(1, n - 1))
        near = []
        for i in range(0, n, 1024):
            s = centroids[i : i + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            near.append(np.argsort(-s, axis=1, kind="stable")[:, :degree])
        self.near = np.concatenate(near).astype(np.int32)
        self.entry = np.sort(np.random.default_rng(seed).permutation(n)[: max(entries // 8, int(n**0.5))]).astype(np.int32)

    def search(self, q: np.ndarray, k: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of about the k nearest centroids of each row of q, best first."""
        parts = [self._search(q[i : i + batch], k) for i in range(0, len(q), batch)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def _search(self, q: np.ndarray, k: int, beam: int = 48, steps: int = 14, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.c)
        k = min(k, n)
        if self.whole:
            s = q @ self.c.T
            pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sims = np.take_along_axis(s, pick, 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            return np.take_along_axis(pick, order, 1).astype(np.int32), np.take_along_axis(sims, order, 1)
        s = q @ self.c[self.entry].T
        start = min(beam, len(self.entry))
        pick = np.argsort(-s, axis=1, kind="stable")[:, :start]
        ids = self.entry[pick]
        sims = np.take_along_axis(s, pick, 1)
        done = np.zeros(ids.shape, bool)
        rows = np.arange(len(q))[:, None]
        for _ in range(steps):
            open_ = np.where(done, -9.0, sims)
            best = np.argsort(-open_, axis=1, kind="stable")[:, :width]
            if (np.take_along_axis(open_, best, 1) <= -9).all():
                break
            np.put_along_axis(done, best, True, 1)
            new = self.near[np.take_along_axis(ids, best, 1)].reshape(len(q), -1)
            found = np.einsum("bnd,bd->bn", self.c[new], q)
            ids = np.concatenate([ids, new], 1)
            sims = np.concatenate([sims, found], 1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], 1)
            # one entry for each id: sort by id, the expanded copy first
            order = np.lexsort((~done, ids), axis=1)
            ids, sims, done = ids[rows, order], sims[rows, order], done[rows, order]
            twice = np.zeros(ids.shape, bool)
            twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
            sims = np.where(twice, -9.0, sims)
            done |= twice
            keep = np.argsort(-sims, axis=1, kind="stable")[:, : min(beam, n)]
            ids, sims, done = ids[rows, keep], sims[rows, keep], done[rows, keep]
        return ids[:, :k], sims[:, :k]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x, dtype=np.float32)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096].astype(np.float64)
        out[i : i + 4096] = y / np.linalg.norm(y, axis=1, keepdims=True)
    return out


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Rows that take part: id, v. Null, other lengths, all zero and not finite vectors and null keys do not."""
    ok = df.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return ok.where((norm > 0) & (norm < float("inf")) & ~F.isnan(norm))


def _copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """(id, key of its vector), (key, its k + 1 smallest ids with their place), and whether some ids had several vectors.

    Of several vectors of an id the first by value stands; only the vectors of
    such ids are moved for that. Both stages of the smallest ids are top-k by
    salt, so a vector that a third of all ids share is no single task's work.
    """
    vk = F.concat_ws(":", F.xxhash64("v"), F.hash("v"))
    pairs = checkpointed(rows.select("id", vk.alias("vk")).distinct())
    several = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    torn = not several.isEmpty()
    members = pairs
    if torn:
        first = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")).select("id", vk.alias("vk"))
        members = checkpointed(pairs.join(several, "id", "left_anti").unionByName(first))
    by_salt = Window.partitionBy("vk", "salt").orderBy("id")
    then = Window.partitionBy("vk").orderBy("id")
    top = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(by_salt)).where(F.col("r") <= k + 1)
    top = top.withColumn("r", F.row_number().over(then)).where(F.col("r") <= k + 1).select("vk", "id", "r")
    return members, checkpointed(top), torn


_PLACED = "list long, mb int, qb int, searches boolean, stored boolean, vk string, raw binary"


def _assign(graph: CentroidGraph, blocks: np.ndarray, base: int, vk: np.ndarray, raw: np.ndarray, searches: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    """Rows (list, block of members, block of searchers, ...) of vectors: the lists that store and that they search.

    A list of one block gets a vector once. In a list of m blocks a member goes
    with its own block to every block of searchers, and so do searchers.
    """
    u = _unit(raw)
    lists, sims = graph.search(u, max(SEARCH_LISTS, MEMBER_LISTS))
    d = np.sqrt(np.maximum(2 - 2 * sims.astype(np.float64), 1e-12))
    rank = np.arange(lists.shape[1])[None, :]
    search = (d <= SEARCH_RATIO * d[:, :1] + 1e-9) & (rank < SEARCH_LISTS) & searches[:, None]
    member = (d <= MEMBER_RATIO * d[:, :1] + 1e-9) & (rank < MEMBER_LISTS) & stored[:, None]
    a, j = np.nonzero(search | member)
    at, isq, ism = lists[a, j], search[a, j], member[a, j]
    m = blocks[at].astype(np.int64)
    own = np.array([hash_of(x) for x in vk], dtype=np.int64)[a] % m
    one = np.nonzero(m == 1)[0]
    cols = [[a[one], at[one], own[one], own[one], isq[one], ism[one]]]
    for i in np.nonzero(m > 1)[0]:
        t = np.arange(m[i])
        mine = np.full(m[i], own[i])
        if ism[i]:
            cols.append([np.full(m[i], a[i]), np.full(m[i], at[i]), mine, t, isq[i] & (t == own[i]), np.ones(m[i], bool)])
        if isq[i]:
            t = t[t != own[i]] if ism[i] else t
            cols.append([np.full(len(t), a[i]), np.full(len(t), at[i]), t, np.full(len(t), own[i]), np.ones(len(t), bool), np.zeros(len(t), bool)])
    who, at, mb, qb, isq, ism = (np.concatenate(c) for c in zip(*cols, strict=True))
    data = pa.array(np.ascontiguousarray(raw).view(f"V{raw.shape[1] * 4}").ravel().tolist(), pa.binary()).take(pa.array(who))
    return pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int64) + base), pa.array(mb.astype(np.int32)), pa.array(qb.astype(np.int32)), pa.array(isq), pa.array(ism), pa.array(vk[who], pa.string()), data],
        names=["list", "mb", "qb", "searches", "stored", "vk", "raw"],
    )


def _fit(x: np.ndarray, n: float, list_size: int, block: int) -> tuple[CentroidGraph, np.ndarray, int]:
    """A graph of centroids for n vectors of which x are a sample, and the blocks expected of each list."""
    n_lists = int(max(1, min(round(n / list_size), len(x) // SAMPLE_PER_LIST)))
    graph = CentroidGraph(balanced_centroids(x, n_lists))
    near = graph.search(x, 1)[0][:, 0] if n_lists > 1 else np.zeros(len(x), np.int32)
    expected = np.bincount(near, minlength=n_lists) * (n / len(x)) * MEMBER_LISTS
    return graph, np.maximum(1, np.ceil(expected / block)).astype(np.int32), n_lists


def _raws(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _cut_long_lists(placed: DataFrame, dim: int, list_size: int, block: int, sample: int) -> DataFrame:
    """Lists of more than ``block`` members are cut into lists of their own.

    For each of them centroids are fitted on at most ``sample`` of its members,
    in the cluster; its vectors, spread by salt, then find their lists among
    those. Nothing but the numbers of the long lists comes to the driver.
    """
    placed = checkpointed(placed)
    sizes = placed.groupBy("list").agg(F.count_if("stored").alias("n")).where(F.col("n") > block)
    if sizes.isEmpty():
        return placed
    wide = 1 << 24
    share = F.least(F.lit(1.0), F.lit(0.9 * sample) / F.col("n"))
    drawn = placed.where("stored").join(sizes, "list").where(F.pmod(F.xxhash64("vk", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).select("list", "n", "raw")

    def fit(table: pa.Table) -> pa.Table:
        x = _unit(_raws(table.column("raw"), dim)[:sample])
        graph, blocks, _ = _fit(x, table.column("n")[0].as_py(), list_size, block)
        return pa.table({"list": pa.array([table.column("list")[0].as_py()] * len(graph.c), pa.int64()), "sub": pa.array(range(len(graph.c)), pa.int32()), "blocks": pa.array(blocks), "c": pa.array([c.tobytes() for c in graph.c], pa.binary())})

    centroids = checkpointed(drawn.groupBy("list").applyInArrow(fit, "list long, sub int, blocks int, c binary"))
    salts = F.ceil(F.col("n") / F.lit(4 * block)).cast("int")
    many = sizes.select("list", salts.alias("salts"))
    left = placed.join(many, "list").withColumn("salt", F.pmod(F.xxhash64("vk"), F.col("salts")).cast("int"))
    right = centroids.join(many, "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def place(rows: pa.Table, cents: pa.Table) -> pa.Table:
        schema = pa.schema([("list", pa.int64()), ("mb", pa.int32()), ("qb", pa.int32()), ("searches", pa.bool_()), ("stored", pa.bool_()), ("vk", pa.string()), ("raw", pa.binary())])
        if not rows.num_rows or not cents.num_rows:
            return schema.empty_table()
        cents = cents.sort_by("sub")
        graph, blocks = CentroidGraph(_raws(cents.column("c"), dim)), cents.column("blocks").to_numpy()
        vk = np.array(rows.column("vk").to_pylist(), dtype=object)
        base = (rows.column("list")[0].as_py() + 1) * wide
        out = _assign(graph, blocks, base, vk, _raws(rows.column("raw"), dim), rows.column("searches").to_numpy(zero_copy_only=False), rows.column("stored").to_numpy(zero_copy_only=False))
        return pa.Table.from_batches([out], schema)

    cut = left.select("list", "salt", "searches", "stored", "vk", "raw").groupBy("list", "salt").cogroup(right.select("list", "salt", "sub", "blocks", "c").groupBy("list", "salt")).applyInArrow(place, _PLACED)
    return placed.join(many, "list", "left_anti").unionByName(cut)


def nearest(
    df: DataFrame, key: str = "node_id", vector: str = "vector", dim: int = 384, k: int = 5, min_cos: float | None = None,
    list_size: int = LIST_SIZE, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """The k most similar other keys of every key by cosine: id, other, cos, place (1..k).

    Ties go to the smaller key. ``min_cos`` leaves out less similar ones as
    early as they are found. Equal vectors are searched once and all their
    keys get results; those with the k + 1 smallest keys can be results, which
    is exact. A table with fewer than two usable vectors gives no rows. The
    centroids of the first level, at most ``sample`` / SAMPLE_PER_LIST, are
    broadcast; if the lists they give are longer than ``block``, a second level
    is fitted and searched in the cluster.
    """
    spark = df.sparkSession
    rows = usable_vectors(df, key, vector, dim)
    members, smallest, torn = _copies(rows, k)
    n = smallest.where("r = 1").count()
    if n == 0:
        return spark.createDataFrame([], "id string, other string, cos double, place int")
    # one row for each distinct vector: equal ones meet on the map side already
    reps = rows.groupBy(F.concat_ws(":", F.xxhash64("v"), F.hash("v")).alias("vk")).agg(F.min("v").alias("v"))
    if torn:
        reps = reps.join(smallest.where("r = 1").select("vk"), "vk", "left_semi")
    share = min(1.0, 1.2 * sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(sample) if share < 1 else rows.select("v").limit(sample)
    x = np.unique(_unit(_matrix(drawn.toArrow().column("v"), dim)), axis=0)
    graph, blocks, n_lists = _fit(x, n, list_size, block)
    deep = n / n_lists > 2 * list_size and n * MEMBER_LISTS / n_lists > block
    if deep:
        blocks = np.ones(n_lists, np.int32)
    shared = spark.sparkContext.broadcast((graph, blocks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, nb = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vk = np.array(batch.column("vk").to_pylist(), dtype=object)
                yes = np.ones(len(vk), bool)
                if len(vk):
                    yield _assign(g, nb, 0, vk, _matrix(batch.column("v"), dim), yes, yes)

    placed = reps.select("vk", "v").mapInArrow(assign, _PLACED)
    if deep:
        placed = _cut_long_lists(placed, dim, list_size, block, sample)

    def join(table: pa.Table) -> pa.Table:
        keys = np.array(table.column("vk").to_pylist(), dtype=object)
        number = np.unique(keys.astype(str), return_inverse=True)[1].astype(np.int32)
        raw = _raws(table.column("raw"), dim)
        u = _unit(raw)
        q = np.nonzero(table.column("searches").to_numpy(zero_copy_only=False))[0]
        m = np.nonzero(table.column("stored").to_numpy(zero_copy_only=False))[0]
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        floor = -2.0 if min_cos is None else min_cos - 1e-5
        um = u[m]
        for at in range(0, len(q), 1024) if len(m) else ():
            qi = q[at : at + 1024]
            s = u[qi] @ um.T
            s[number[qi][:, None] == number[m][None, :]] = -3
            take = min(k + 1, s.shape[1])
            top = np.argpartition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take :]
            r, c = np.nonzero(np.take_along_axis(s, top, 1) > floor)
            out_a.append(qi[r])
            out_b.append(m[top[r, c]])
            take = min(k + 1, s.shape[0])  # the members' best among these searchers, too
            top = np.argpartition(s, s.shape[0] - take, axis=0)[s.shape[0] - take :]
            r, c = np.nonzero(np.take_along_axis(s, top, 0) > floor)
            out_a.append(m[c])
            out_b.append(qi[top[r, c]])
        a, b = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
        norm = np.sqrt(np.einsum("nd,nd->n", raw, raw, dtype=np.float64))
        cos = np.zeros(len(a))
        for at in range(0, len(a), 2048):  # in double precision
            i, j = a[at : at + 2048], b[at : at + 2048]
            cos[at : at + 2048] = np.einsum("nd,nd->n", raw[i].astype(np.float64), raw[j].astype(np.float64)) / (norm[i] * norm[j])
        keep = (cos >= (-2.0 if min_cos is None else min_cos)) & (number[a] != number[b])
        return pa.table({"a": pa.array(keys[a[keep]], pa.string()), "b": pa.array(keys[b[keep]], pa.string()), "cos": pa.array(cos[keep])})

    cand = placed.groupBy("list", "mb", "qb").applyInArrow(join, "a string, b string, cos double")
    cand = cand.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    # of the vectors near a vector only the k nearest matter; the ids that share them follow
    w = Window.partitionBy("a").orderBy(F.round("cos", 9).desc(), "b")
    near = checkpointed(cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("a", "b", "cos"))
    others = smallest.select(F.col("vk").alias("b"), F.col("id").alias("other"))
    from_near = near.join(others, "b").select(F.col("a").alias("vk"), "other", "cos")
    own = smallest.select("vk", F.col("id").alias("other"), F.lit(1.0).alias("cos"))
    per = Window.partitionBy("vk").orderBy(F.round("cos", 9).desc(), "other")
    pool = from_near.unionByName(own).withColumn("r", F.row_number().over(per)).where(F.col("r") <= k + 1).select("vk", "other", "cos", "r")
    joined = members.join(pool, "vk").where("id <> other")
    last = Window.partitionBy("id").orderBy("r")
    return joined.withColumn("place", F.row_number().over(last)).where(F.col("place") <= k).select("id", "other", "cos", "place")


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) & 0x7FFFFFFFFFFFFFFF


def similar_pairs(df: DataFrame, k: int = 5, min_cos: float = 0.8) -> DataFrame:
    """Unordered pairs of node ids of which one is among the other's k nearest, at ``min_cos`` or more."""
    n = nearest(df, "node_id", "vector", 384, k, min_cos)
    return n.select(F.least("id", "other").alias("node_a"), F.greatest("id", "other").alias("node_b")).distinct()
