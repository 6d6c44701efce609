"""Breadth-first search from many seeds, with one bit for each seed.

The frontier joins of ``traverse`` write a row for each seed and node, hop by
hop; from hundreds of hubs that is most pairs there are. Here the steps of the
graph are numbered, packed (a few bytes each) and sent once to every task. A
task takes a block of seeds, searches all hops in memory and gives its rows as
it goes, so only the packed steps are shuffled and nothing else is stored.

A task holds the steps of one branch, so graphs have a bound (``STEPS``);
beyond it ``traverse`` goes on with frontier joins, which find the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import checkpointed, shuffle_width

#: Steps of all branches that a task may hold; one takes some 30 bytes while they are sorted.
STEPS = 12_000_000
#: Bytes of a bit set of the nodes; a task holds four. A word has 64 seeds.
BITS = 48 << 20
#: Rows in a packed piece, list members in a batch of results.
PIECE, BATCH = 250_000, 400_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, from 0 without gaps: the place in the partition behind those of the partitions before."""
    df = checkpointed(df)
    counts = sorted(df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.spark_partition_id()) if offsets else F.lit(0)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.withColumn(name, (at + start).cast("int"))


STEP, NODE, SEED = range(3)
_PIECES = "branch string, block int, what int, data binary"


def _pack(batches: Iterator) -> Iterator:
    """branch, block, what, x, y, s to branch, block, what, data: pieces of many rows, sorted and compressed."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = pa.schema([("branch", pa.string()), ("block", pa.int32()), ("what", pa.int32()), ("data", pa.binary())])
    keys = ["branch", "block", "what"]

    def packed(held: list) -> Iterator:
        t = pa.Table.from_batches(held).sort_by([(k, "ascending") for k in ("y", "x")])
        for key in t.group_by(keys).aggregate([]).to_pylist():
            own = t
            for k in keys:
                own = own.filter(pc.equal(own[k], key[k]))
            own, sink = own.select(["x", "y", "s"]).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(own)
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in key.items()} | {"data": [sink.getvalue().to_pybytes()]}, out)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PIECE:
            yield from packed(held)
            held, n = [], 0
    if n:
        yield from packed(held)


def _blocks(steps: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """branch, block, what, data: for every block of seeds the whole packed graph of its branch, in one partition.

    steps: branch, x, y (numbers); nodes: branch, x, y, s; seeds: branch, x, s.
    A branch has a block for each 64 seeds, as many as partitions at most, each
    in another partition. Every block takes a copy of the graph, so there are no
    more than two partitions a core: shuffle partitions grow with the input, and
    copies of a growing graph for each of them would grow with its square.
    """
    spark = steps.sparkSession
    width = min(shuffle_width(spark), 2 * spark.sparkContext.defaultParallelism)
    seeds = checkpointed(seeds.where("branch is not null"))
    one, none = F.lit(0), F.lit(None).cast("string").alias("s")
    per = checkpointed(seeds.groupBy("branch").agg(F.least(F.lit(width), F.ceil(F.count_distinct("s") / 64)).cast("int").alias("blocks")))
    rows = steps.select("branch", one.alias("block"), F.lit(STEP).alias("what"), "x", "y", none).unionByName(nodes.select("branch", one.alias("block"), F.lit(NODE).alias("what"), "x", "y", "s"))
    graph = rows.where("branch is not null").mapInArrow(_pack, _PIECES)
    graph = checkpointed(graph).join(per, "branch").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    own = seeds.join(per, "branch").withColumn("block", F.pmod(F.xxhash64("s"), "blocks").cast("int"))
    own = own.repartition(width, "branch", "block").select("branch", "block", F.lit(SEED).alias("what"), "x", one.alias("y"), "s").mapInArrow(_pack, _PIECES)
    both = graph.select(*own.columns).unionByName(own)
    return both.repartitionById(width, F.pmod(F.hash("branch").cast("bigint") + F.col("block"), F.lit(width)).cast("int"))


def _read(pieces: list):
    """The rows x, y, s of packed pieces."""
    import pyarrow as pa

    read = [pa.ipc.open_stream(x).read_all() for x in pieces]
    return pa.concat_tables(read) if read else pa.table({"x": pa.array([], pa.int32()), "y": pa.array([], pa.int32()), "s": pa.array([], pa.string())})


def _gather(batches: Iterator) -> Iterator:
    """[branch, steps, nodes, seeds] for each block of a partition. Nothing here holds the tables, so who empties the list may free them."""
    import pyarrow as pa

    held: dict = {}
    for b in batches:
        for branch, block, what, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            held.setdefault((branch, block), {}).setdefault(what, []).append(data)
    for key in sorted(held):
        own = held.pop(key)
        if NODE in own and SEED in own:
            yield [key[0], *(_read(own.pop(k, [])) for k in (STEP, NODE, SEED))]


def _column(t, name: str):
    """A packed column of numbers; null is -1."""
    import pyarrow.compute as pc

    return pc.fill_null(t[name], -1).to_numpy()


class _Lists:
    """The steps sorted by target, or by source: for each the members of its list."""

    def __init__(self, key, other):
        import numpy as np

        both = key.astype(np.int64)
        both <<= 32
        both |= other
        both.sort()
        self.other = both.astype(np.int32)  # the lower half
        both >>= 32
        key = both.astype(np.int32)
        self.starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(both) else np.zeros(0, np.int64)
        self.keys = key[self.starts]
        self.sizes = np.diff(np.r_[self.starts, len(both)])

    def ranges(self, n: int):
        """Start and size of the list of each of n keys."""
        import numpy as np

        start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        start[self.keys], size[self.keys] = self.starts, self.sizes
        return start, size


def _spans(start, size):
    """The places of several ranges, one range behind the other."""
    import numpy as np

    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _ored(values, keys, out) -> None:
    """out[key] |= value; keys may repeat."""
    import numpy as np

    if len(keys):
        o = np.argsort(keys, kind="stable")
        k = keys[o]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out[k[at]] |= np.bitwise_or.reduceat(values[o], at)


def _search(depth: int, both_ways: bool, named: bool):
    """Rows branch, id, hop, seeds for the blocks of a partition.

    Steps lead from x to the node y. ``named``: x is a name, y of a node its
    name, and a hop leads on from the names of the nodes it reached; seeds are
    names and no rows. Else x is a node as well, and seeds are rows of hop 0.
    """

    def block(given: list) -> Iterator:
        import numpy as np
        import pyarrow as pa

        branch, steps, nodes, seeds = given
        given.clear()
        out = pa.schema([("branch", pa.string()), ("id", pa.string()), ("hop", pa.int32()), ("seeds", pa.list_(pa.string()))])
        number, name_of = _column(nodes, "x"), _column(nodes, "y")
        n, ids = len(number), nodes["s"].combine_chunks()
        shown = ids.is_valid().to_numpy(zero_copy_only=False)
        place = np.full(int(number.max()) + 1, -1, np.int32)
        place[number] = np.arange(n, dtype=np.int32)
        x, y, seed_at = _column(steps, "x"), place[_column(steps, "y")], _column(seeds, "x")
        del steps, nodes, number
        if named:
            names = np.unique(np.concatenate([x, name_of[name_of >= 0], seed_at]))
            ranked = lambda a: np.searchsorted(names, a).astype(np.int32)
            m, x, seed_at = len(names), ranked(x), ranked(seed_at)
            by_name = np.argsort(name_of, kind="stable").astype(np.int32)
            by_name = by_name[name_of[by_name] >= 0]
            names_of = ranked(name_of[by_name])
            first = np.flatnonzero(np.r_[True, names_of[1:] != names_of[:-1]]) if len(names_of) else np.zeros(0, np.int64)
        else:
            m, x, seed_at = n, place[x], place[seed_at]
        into = _Lists(*((np.r_[y, x], np.r_[x, y]) if both_ways else (y, x)))
        back = into if both_ways else _Lists(x, y)
        outof, (start, size) = back.other, back.ranges(m)
        del x, y, place, name_of, back
        pa.default_memory_pool().release_unused()
        coded = seeds["s"].combine_chunks().dictionary_encode()
        labels, code = coded.dictionary, coded.indices.to_numpy()

        def reached(front, seen):
            """What a word of the frontier newly reaches: over the steps of the frontier if these are few, else over all."""
            new, act = np.zeros(n, np.uint64), np.flatnonzero(front)
            if size[act].sum() * 16 < len(outof):
                _ored(np.repeat(front[act], size[act]), outof[_spans(start[act], size[act])], new)
            else:
                new[into.keys] = np.bitwise_or.reduceat(front[into.other], into.starts)
            new &= ~seen
            return new

        def rows(new, hop, own):
            """The nodes with the seeds of their bits."""
            width = 64 * len(new)
            hit = np.flatnonzero(np.bitwise_or.reduce(new, axis=0).astype(bool) & shown)
            for at in np.split(hit, range(BATCH // width, len(hit), BATCH // width)):
                if len(at):
                    bits = np.unpackbits(np.ascontiguousarray(new[:, at].T).view(np.uint8), bitorder="little").view(bool)
                    count = bits.reshape(len(at), width).sum(axis=1)
                    which = np.flatnonzero(bits) - np.repeat(np.arange(len(at)) * width, count)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), own.take(pa.array(which)))
                    yield pa.RecordBatch.from_arrays([pa.array([branch] * len(at), pa.string()), ids.take(pa.array(at)), pa.array(np.full(len(at), hop, np.int32)), lists], schema=out)

        most = 64 * max(1, min(8, BITS // (8 * max(n, m))))
        for low in range(0, len(labels), most):
            own = labels.slice(low, most)
            words = -(-len(own) // 64)
            front, seen = np.zeros((words, m), np.uint64), np.zeros((words, n), np.uint64)
            mine = np.flatnonzero((code >= low) & (code < low + most))
            bit = code[mine].astype(np.int64) - low
            np.bitwise_or.at(front, (bit // 64, seed_at[mine]), np.uint64(1) << (bit % 64).astype(np.uint64))
            if not named:
                seen |= front
                yield from rows(front, 0, own)
            for hop in range(1, depth + 1):
                new = np.empty((words, n), np.uint64)
                for w in range(words):
                    new[w] = reached(front[w], seen[w])
                if not new.any():
                    break
                yield from rows(new, hop, own)
                if hop < depth:
                    seen |= new
                    front = new
                    if named:
                        front = np.zeros((words, m), np.uint64)
                        for f, w in zip(front, new, strict=True):
                            if len(first):
                                f[names_of[first]] = np.bitwise_or.reduceat(w[by_name], first)

    def run(batches: Iterator) -> Iterator:
        for own in _gather(batches):
            yield from block(own)

    return run


def search(steps: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, both_ways: bool = False, named: bool = False) -> DataFrame:
    """Breadth-first search: branch, seed, id, hop, each id once for each seed at its least hop.

    steps: branch, x, y; nodes: branch, x, y (the number of the name or null),
    s (the id, null: passed through but no row); seeds: branch, x, s.
    """
    found = _blocks(steps, nodes, seeds).mapInArrow(_search(depth, both_ways, named), "branch string, id string, hop int, seeds array<string>")
    return found.select("branch", F.explode("seeds").alias("seed"), "id", "hop")


def _trace(most: int, sep: str | None):
    """Rows branch, from_name, to_name, hops, path for the blocks of a partition: seeds are sources, nodes with y = 1 are targets.

    A queue in order of the paths and lists in order of the names make the
    first way to a name its smallest shortest path.
    """

    def block(given: list) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        branch, steps, nodes, seeds = given
        given.clear()
        out = pa.schema([("branch", pa.string()), ("from_name", pa.string()), ("to_name", pa.string()), ("hops", pa.int32()), ("path", pa.list_(pa.string()) if sep is None else pa.string())])
        nodes = nodes.take(pc.sort_indices(nodes["s"].cast(pa.binary())))
        number, n, names = _column(nodes, "x"), nodes.num_rows, nodes["s"].combine_chunks()
        target = _column(nodes, "y") == 1
        place = np.full(int(number.max()) + 1, -1, np.int32)
        place[number] = np.arange(n, dtype=np.int32)
        lists = _Lists(place[_column(steps, "x")], place[_column(steps, "y")])
        start, size = lists.ranges(n)
        held, rows, first = [], 0, np.zeros(n, np.int64)

        def flushed() -> pa.RecordBatch:
            flat, hops = np.concatenate([p.ravel() for p in held]), np.concatenate([np.full(len(p), p.shape[1] - 1, np.int32) for p in held])
            offsets = np.r_[0, np.cumsum(hops + 1)].astype(np.int32)
            take = lambda at: names.take(pa.array(at))
            path = pa.ListArray.from_arrays(pa.array(offsets), take(flat))
            return pa.RecordBatch.from_arrays(
                [pa.array([branch] * len(hops), pa.string()), take(flat[offsets[:-1]]), take(flat[offsets[1:] - 1]), pa.array(hops), path if sep is None else pc.binary_join(path, sep)], schema=out
            )

        for source in place[np.unique(_column(seeds, "x"))]:
            unseen, missing = np.ones(n, bool), int(target.sum())
            levels = [(np.array([source], np.int32), None)]
            for hop in range(1, most + 1):
                at = levels[-1][0]
                ways = size[at]
                to, parent = lists.other[_spans(start[at], ways)], np.repeat(np.arange(len(at)), ways)
                fresh = np.flatnonzero(unseen[to] & target[to] if hop == most else unseen[to])
                to = to[fresh]
                order = np.arange(len(to))
                first[to[::-1]] = order[::-1]
                kept = first[to] == order
                to, parent = to[kept], parent[fresh][kept]
                if not len(to):
                    break
                unseen[to] = False
                levels.append((to, parent))
                hit = np.flatnonzero(target[to])
                if len(hit):
                    path, back = np.empty((len(hit), hop + 1), np.int32), hit
                    for k in range(hop, -1, -1):
                        path[:, k] = levels[k][0][back]
                        back = levels[k][1][back] if k else back
                    held.append(path)
                    rows, missing = rows + len(hit), missing - len(hit)
                    if rows * 6 >= BATCH:
                        yield flushed()
                        held.clear()
                        rows = 0
                if not missing:
                    break
        if held:
            yield flushed()

    def run(batches: Iterator) -> Iterator:
        for own in _gather(batches):
            yield from block(own)

    return run


def paths(steps: DataFrame, names: DataFrame, sources: DataFrame, most: int, sep: str | None = None) -> DataFrame:
    """The smallest of the shortest paths of at most so many steps from every source to every target of its branch.

    steps: branch, x, y; names: branch, x, y (1: a target), s; sources: branch,
    x, s. With ``sep`` a path is one text, joined by it, and no array.
    """
    kind = "array<string>" if sep is None else "string"
    return _blocks(steps, names, sources).mapInArrow(_trace(most, sep), f"branch string, from_name string, to_name string, hops int, path {kind}")
