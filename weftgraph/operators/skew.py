"""Aggregation and ranking that keep their balance when a few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import checkpointed, shuffle_width


def heavy_keys(df: DataFrame, keys: list[str], per_task: int | None = None) -> DataFrame:
    """Keys that hold more rows than one task should get, with their number of salts.

    Every row is counted; the partial count runs before the shuffle, so no task
    sees more than one row for each key and input partition. A key is heavy
    above ``per_task`` rows, by default a quarter of an even share. At most
    four keys for each shuffle partition can exceed that, which bounds the
    result and makes it safe to broadcast.
    """
    width = shuffle_width(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if per_task is None:
        total = counts.agg(F.sum("__n")).first()[0] or 0
        per_task = max(1, total // (4 * width))
    return counts.where(F.col("__n") > per_task).select(
        *keys, F.least(F.lit(4 * width), F.ceil(F.col("__n") / F.lit(per_task))).cast("int").alias("__salts")
    )


def salted(df: DataFrame, keys: list[str], spread: list[str], per_task: int | None = None) -> DataFrame:
    """Adds ``__salt``: 0 for light keys, a hash of ``spread`` for heavy ones.

    The salt is drawn by a hash and not by a random generator: a task that runs
    again after the loss of an executor must draw the same salt, or rows would
    be lost or counted twice. Rows that agree in ``spread`` share a salt, so
    distinct values of different salts never overlap.
    """
    heavy = heavy_keys(df, keys, per_task)
    heavy = heavy.select(*[F.col(k).alias(f"__heavy_{i}") for i, k in enumerate(keys)], "__salts")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__heavy_{i}")) for i, k in enumerate(keys)])
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__salts")))
    joined = df.join(F.broadcast(heavy), on, "left")  # bounded by 4 x the number of shuffle partitions
    return joined.select(*df.columns, F.coalesce(salt, F.lit(0)).cast("int").alias("__salt"))


def salted_distinct_count(
    df: DataFrame, keys: list[str], value: str, out: str, per_task: int | None = None
) -> DataFrame:
    """Distinct non-null ``value`` for each key, exact, in two salted stages.

    Stage one reduces (key, salt) to its distinct values and their number.
    Salts are disjoint in ``value``, so stage two adds the partial numbers by
    the original key. Null keys form a group of their own; a key whose values
    are all null counts 0; an empty table gives no rows.
    """
    narrow = df.select(*keys, F.col(value).alias("__value"))
    s = salted(narrow, keys, ["__value"], per_task)
    part = s.groupBy(*keys, "__salt", "__value").agg(F.lit(1).alias("__one"))
    part = part.groupBy(*keys, "__salt").agg(F.count("__value").alias("__part"))
    return part.groupBy(*keys).agg(F.sum("__part").cast("bigint").alias(out))


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: list[Column],
    merge: list[Column],
    spread: list[str],
    per_task: int | None = None,
) -> DataFrame:
    """Two-stage salted aggregation for any aggregate that merges.

    ``partial`` runs by (key, salt) and must alias its columns; ``merge``
    combines those columns by key.
    """
    s = salted(df, keys, spread, per_task)
    return s.groupBy(*keys, "__salt").agg(*partial).groupBy(*keys).agg(*merge)


def in_degree(edges: DataFrame, kind: str = "calls", min_degree: int = 0, per_task: int | None = None) -> DataFrame:
    """In-degree of each dst on each branch: the distinct callers, exact, without skew.

    Repeated rows of one caller count once. A null dst was never resolved and
    is left out; a null src adds nothing; a null branch is a branch of its own.
    Columns: branch, dst, in_degree.
    """
    calls = edges.where((F.col("kind") == kind) & F.col("dst").isNotNull()).select("branch", "dst", "src")
    out = salted_distinct_count(calls, ["branch", "dst"], "src", "in_degree", per_task)
    return out.where(F.col("in_degree") >= min_degree) if min_degree > 0 else out


def grouped_rank(df: DataFrame, group: list[str], tie: str, buckets: int = 256, out: str = "rank", stable: bool = False) -> DataFrame:
    """A 0-based rank inside each group, by a hash of ``tie`` and then ``tie``, without one task per group.

    ``tie`` must be unique in its group. Rows fall into hash buckets; the
    counts of (group, bucket) are added up to offsets, and the rank inside a
    bucket is added to its offset. A group of any size is so spread over
    ``buckets`` tasks. The rows are checkpointed first unless they are
    ``stable`` already (checkpointed or a written table): both passes then read
    the same bytes. Null groups are groups; ties cannot occur.
    """
    from pyspark.sql import Window as W

    h = F.xxhash64(F.col(tie))
    base = (df if stable else checkpointed(df)).withColumn("__h", h).withColumn("__b", F.pmod(F.shiftrightunsigned(h, 17), F.lit(buckets)).cast("int"))
    counts = base.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    # at most `buckets` rows for each group
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    inner = W.partitionBy(*group, "__b").orderBy("__h", tie)
    ranked = base.withColumn("__r", F.row_number().over(inner) - 1)
    keys = [*group, "__b"]
    offsets = offsets.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(keys)], "__o")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(keys)])
    return ranked.join(offsets, on).select(*df.columns, (F.col("__r") + F.col("__o")).cast("bigint").alias(out))
