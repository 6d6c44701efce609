"""Documents packed into containers of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import grouped_rank


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns: (number of containers, [(length, times), ...]).

    Shortest pack first: lengths go from long to short, each to the open packs
    with the most room, as often as it fits; what is left over opens packs.
    Counts of equal patterns are kept together, so the work depends on the
    number of distinct lengths and not on the number of items.
    """
    rooms: dict[int, list[list]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    import heapq

    heap: list[int] = []

    def put(room: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if not count:
            return
        if room == 0:
            done.append((count, pattern))
            return
        if room not in rooms:
            rooms[room] = []
        if not rooms[room]:
            heapq.heappush(heap, -room)
        rooms[room].append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length > capacity or length <= 0:
            raise ValueError("items are longer than 0 and no longer than the capacity")
        while left:
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            if not heap or -heap[0] < length:
                each = capacity // length
                full, rest = divmod(left, each)
                put(capacity - each * length, full, [(length, each)])
                if rest:
                    put(capacity - rest * length, 1, [(length, rest)])
                break
            room = -heap[0]
            count, pattern = rooms[room].pop()
            each = room // length
            if left >= each:
                packs = min(count, left // each)
                times = each
            else:
                packs, times = 1, left
            left -= packs * times
            put(room, count - packs, pattern)
            put(room - times * length, packs, [*pattern, (length, times)])
    for slots in rooms.values():
        done += [(c, p) for c, p in slots]
    return done


def placements(packs: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each length the ranges of ranks that patterns take: length, start, times, base (first container)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for count, pattern in packs:
        for length, times in pattern:
            start = used.get(length, 0)
            rows.append((length, start, times, base))
            used[length] = start + count * times
        base += count
    return pd.DataFrame(rows, columns=["length", "start", "times", "base"]).sort_values(["length", "start"], ignore_index=True)


def offsets(histogram: dict[int, int], capacity: int) -> tuple[dict[int, int], dict[int, tuple[int, int, int]]]:
    """(numbers of pieces by length, and per length above the capacity: full pieces of an item, first full piece, first rest).

    Items longer than the capacity are cut into full pieces and a rest. Full
    pieces and rests are ranked behind the whole items of their length, in the
    order of the lengths they come from; so a single rank within each length
    of items is enough for every capacity.
    """
    pieces = {k: v for k, v in histogram.items() if k <= capacity}
    first = {}
    for k in sorted(x for x in histogram if x > capacity):
        full, rest = divmod(k, capacity)
        first[k] = (full, pieces.get(capacity, 0), pieces.get(rest, 0))
        pieces[capacity] = pieces.get(capacity, 0) + full * histogram[k]
        if rest:
            pieces[rest] = pieces.get(rest, 0) + histogram[k]
    return pieces, first


def pack(items: DataFrame, capacities: dict[str, int], key: str = "doc_id", stable: bool = False) -> DataFrame:
    """Containers of each capacity: box_name, container_id, key, piece_no, n_tokens.

    items: key (unique), n_tokens; ``stable`` if checkpointed or a written
    table. An item longer than a capacity is cut into full pieces, each a
    container of its own, and a rest that is packed like an item. Items without
    tokens go to no container; an empty table gives no rows. Items are ranked
    once within their exact length, in hash buckets, so a length of any number
    of items is spread; the plans of all capacities are then looked up by
    length and rank in one pass without further shuffles. What comes to the
    driver and is broadcast has a row for each distinct length, and the plans
    not many more.
    """
    spark = items.sparkSession
    live = items.where("n_tokens > 0").select(key, "n_tokens").withColumn("__tie", F.col(key).cast("string"))
    histogram = {int(r[0]): int(r[1]) for r in live.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}
    plans = []
    for name, capacity in sorted(capacities.items()):
        pieces, first = offsets(histogram, capacity)
        plans.append((name, capacity, placements(plan_packs(pieces, capacity)), first))
    shared = spark.sparkContext.broadcast(plans)
    kind = items.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.int64(1) << 40
        tables = []
        for name, capacity, p, first in shared.value:
            p = p.astype(np.int64)
            tables.append((name, capacity, p["length"].to_numpy() * wide + p["start"].to_numpy(), p["start"].to_numpy(), p["times"].to_numpy(), p["base"].to_numpy(), first))
        for pdf in batches:
            keys, size, rank = pdf[key].to_numpy(), pdf["n_tokens"].to_numpy(np.int64), pdf["__rank"].to_numpy(np.int64)
            for name, capacity, edge, start, times, base, first in tables:
                long = np.nonzero(size > capacity)[0]
                short = np.nonzero(size <= capacity)[0]
                full, at_full, at_rest = (np.array([first[int(s)] for s in size[long]], np.int64).reshape(-1, 3)).T
                nth = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
                rest = size[long] % capacity
                some = rest > 0
                # whole items, full pieces, rests
                which = np.concatenate([short, np.repeat(long, full), long[some]])
                piece = np.concatenate([np.zeros(len(short), np.int64), nth, full[some]])
                length = np.concatenate([size[short], np.full(len(nth), capacity, np.int64), rest[some]])
                place_ = np.concatenate([rank[short], np.repeat(at_full + rank[long] * full, full) + nth, (at_rest + rank[long])[some]])
                at = np.searchsorted(edge, length * wide + place_, side="right") - 1
                yield pd.DataFrame({"box_name": name, "container_id": base[at] + (place_ - start[at]) // times[at], key: keys[which], "piece_no": piece.astype(np.int32), "n_tokens": length})

    ranked = grouped_rank(live, ["n_tokens"], "__tie", out="__rank", stable=stable)
    return ranked.select(key, "n_tokens", "__rank").mapInPandas(place, f"box_name string, container_id bigint, `{key}` {kind}, piece_no int, n_tokens bigint")
