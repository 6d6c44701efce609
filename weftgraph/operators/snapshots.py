"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import checkpointed, shuffle_width


def row_digests(df: DataFrame, keys: list[str], set_columns: list[str], ignore: list[str]) -> Column:
    """A 128-bit digest of a row's content.

    Every column is written with its name into JSON, nulls included, so a null
    differs from an empty text and neighbouring columns cannot run together.
    ``set_columns`` are compared as sets: sorted, without repeats.
    """
    parts = []
    for c in sorted(set(df.columns) - set(ignore) - set(keys)):
        parts.append((F.array_sort(F.array_distinct(F.col(c))) if c in set_columns else F.col(c)).alias(c))
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def _chunk_bounds(divisor: int):
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, snapshot and key; a chunk begins at each key whose hash divides."""
        last: tuple | None = None
        label_now = ""
        for pdf in batches:
            if not len(pdf):
                continue
            group = pdf["__group"].to_numpy()
            snap = pdf["__snap"].to_numpy()
            key = pdf["__key"].to_numpy()
            cut = pdf["__cut"].to_numpy() % divisor == 0
            new = np.ones(len(pdf), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (snap[1:] != snap[:-1])
            new[0] = last != (group[0], snap[0])
            start = np.where(cut, key, np.where(new, "", None))
            if start[0] is None:
                start[0] = label_now
            filled = pd.Series(start, dtype=object).ffill().to_numpy()
            label_now, last = filled[-1], (group[-1], snap[-1])
            pdf["__chunk"] = filled
            yield pdf[["__group", "__snap", "__key", "__digest", "__part", "__chunk"]]

    return label


def snapshot_changes(
    df: DataFrame,
    group: str = "branch",
    snap: str = "snap_no",
    key: str = "id",
    version: str = "loaded_at",
    set_columns: tuple[str, ...] = ("annotations",),
    mean_chunk: int = 64,
) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the one before it.

    1. Of several rows for a key within a snapshot the one loaded last stands;
       of several loaded at once, the one with the greatest digest.
    2. Rows are range-partitioned by (group, key) over all snapshots together
       and sorted. A chunk begins wherever the hash of a key is divisible by
       ``mean_chunk``: its bounds depend on content, so a row that comes or
       goes disturbs its own chunk only.
    3. Chunks of consecutive snapshots whose digests agree are discarded. A
       chunk's digest is its count and 128 bits over the keys and contents of
       its rows. Only the rows of the other chunks are joined and classified.

    A snapshot without a predecessor gives no rows. A key that returns after a
    gap is added. Null keys and null groups are left out. A branch with any
    share of all rows is spread by key. Columns: group, snap, key, delta_kind.
    """
    spark = df.sparkSession
    digest = row_digests(df, [group, snap, key], list(set_columns), [version])
    rows = (
        df.where(F.col(group).isNotNull() & F.col(snap).isNotNull() & F.col(key).isNotNull())
        .select(
            F.col(group).alias("__group"), F.col(snap).cast("bigint").alias("__snap"), F.col(key).alias("__key"),
            F.col(version).alias("__v"), digest.alias("__digest"),
        )
        .groupBy("__group", "__snap", "__key")
        .agg(F.max(F.struct("__v", "__digest"))["__digest"].alias("__digest"))
        .withColumn("__cut", F.abs(F.hash("__key")))
    )
    ordered = (
        rows.repartitionByRange(shuffle_width(spark), "__group", "__key")
        .sortWithinPartitions("__group", "__snap", "__key")
        .withColumn("__part", F.spark_partition_id())
    )
    schema = T.StructType(
        [T.StructField("__group", rows.schema["__group"].dataType), T.StructField("__snap", T.LongType()), T.StructField("__key", rows.schema["__key"].dataType)]
        + [T.StructField("__digest", T.StringType()), T.StructField("__part", T.IntegerType()), T.StructField("__chunk", T.StringType())]
    )
    # Both passes below must see the same chunks, also after a lost executor: range bounds are sampled.
    labelled = checkpointed(ordered.mapInPandas(_chunk_bounds(mean_chunk), schema))

    w_next = "lead(__snap) over (partition by __group order by __snap)"
    snaps = labelled.select("__group", "__snap").distinct().selectExpr("__group", "__snap", f"{w_next} as __next")
    prev = snaps.where("__next is not null").select("__group", F.col("__snap"), F.col("__next").alias("__at"), F.lit(0).alias("__new"))
    w_prev = "lag(__snap) over (partition by __group order by __snap)"
    cur = (
        labelled.select("__group", "__snap").distinct().selectExpr("__group", "__snap", f"{w_prev} as __before")
        .where("__before is not null").select("__group", "__snap", F.col("__snap").alias("__at"), F.lit(1).alias("__new"))
    )
    roles = checkpointed(prev.unionByName(cur))  # two rows for each snapshot

    # the key is part of what is summed: a key renamed, or two that swap their contents, change the chunk's digest
    chunk_key = ["__group", "__part", "__chunk"]
    sums = labelled.groupBy(*chunk_key, "__snap").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("__key", "__digest")).alias("a"), F.bit_xor(F.xxhash64("__digest", F.lit(1), "__key")).alias("b")
    )
    sided = sums.join(roles, ["__group", "__snap"])
    side = lambda k: F.max(F.when(F.col("__new") == k, F.struct("n", "a", "b")))
    unmatched = (
        sided.groupBy(*chunk_key, "__at").agg(side(0).alias("old"), side(1).alias("new"))
        .where(~F.col("old").eqNullSafe(F.col("new"))).select(*chunk_key, "__at")
    )
    left = labelled.join(roles, ["__group", "__snap"]).join(unmatched, [*chunk_key, "__at"], "left_semi")
    both = left.groupBy("__group", "__at", "__key").agg(
        F.max(F.when(F.col("__new") == 0, F.col("__digest"))).alias("old"),
        F.max(F.when(F.col("__new") == 1, F.col("__digest"))).alias("new"),
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(
        F.col("__group").alias(group), F.col("__at").alias(snap), F.col("__key").alias(key), kind.alias("delta_kind")
    ).where(F.col("delta_kind").isNotNull())
