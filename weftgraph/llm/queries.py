"""Queries of the text and vector problems. Where SQL can express one, its SQL stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import docs as D
from weftgraph.llm import mixing, packing, provenance, residue, tokens, unparsable, vectors
from weftgraph.session import checkpointed, shipped


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(df: DataFrame, tasks: int = 4) -> DataFrame:
    """More partitions for Python work than a small table's files would give."""
    wanted = tasks * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return unparsable.unparsable_files(_t(spark, sf, "source_files")).select("file_id")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return unparsable.unparsable_rates(_t(spark, sf, "source_files"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_handwritten(_t(spark, sf, "source_files"), _t(spark, sf, "library_files")).select("file_id")


def p5_handwritten(spark: SparkSession, sf: str) -> DataFrame:
    """What remains when the files not written by hand are left out."""
    files = _t(spark, sf, "source_files")
    bad = provenance.not_handwritten(files, _t(spark, sf, "library_files"))
    return provenance.current_files(files.select("file_id", "repo", "file", "loc", "source_text", "parsed_at")).join(bad, "file_id", "left_anti").select("file_id", "repo", "file", "loc")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.similar_pairs(_t(spark, sf, "node_vectors"))


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    n = vectors.nearest(_t(spark, sf, "node_vectors"))
    return n.select(F.col("id").alias("node_id"), F.col("other").alias("neighbour_id"), F.round("cos", 6).alias("cosine"), "place")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return D.function_pairs(_t(spark, sf, "nodes")).select("branch", "id")


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.function_pairs(_t(spark, sf, "nodes"))


def _counts(spark: SparkSession, sf: str, keep: tuple[str, ...]) -> DataFrame:
    return checkpointed(tokens.token_counts(_spread(_t(spark, sf, "documents").select("text", *keep)), keep=keep))


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in a container of each capacity."""
    boxes = {r["box_name"]: int(r["capacity"]) for r in _t(spark, sf, "pack_limits").collect()}
    return packing.pack(_counts(spark, sf, ("doc_id",)), boxes, stable=True)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each capacity."""
    limits = _t(spark, sf, "pack_limits").groupBy("box_name").agg(F.max("capacity").alias("capacity"))
    used = p8_packing(spark, sf).groupBy("box_name").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"))
    return limits.join(used, "box_name").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_counts(spark, sf, ("doc_id", "source")), _t(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_counts(spark, sf, ("doc_id", "source")), _t(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_documents(_t(spark, sf, "documents")).select("doc_id")


def p10_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_documents(_t(spark, sf, "documents"))


def p10_templates(spark: SparkSession, sf: str) -> DataFrame:
    """The message templates found in all documents, with their verdicts."""
    return residue.templates(_t(spark, sf, "documents"))


QUERIES = shipped({
    "p1_found": p1_found, "p1_rates": p1_rates, "p5_found": p5_found, "p5_handwritten": p5_handwritten, "p6_found": p6_found, "p6_neighbours": p6_neighbours,
    "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_packing": p8_packing, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_reasons": p10_reasons, "p10_templates": p10_templates,
})

_COSINES = """
with v as (select node_id as id, min(vector) as v from node_vectors where node_id is not null and len(vector) = 384 group by node_id),
u as (select id, v, sqrt(list_inner_product(v::double[], v::double[])) as n from v),
w as (select id, v::double[] as v, n from u where n > 0 and isfinite(n)),
ranked as (
  select id, other, cos, row_number() over (partition by id order by round(cos, 9) desc, other) as place from (
    select a.id, b.id as other, list_inner_product(a.v, b.v) / (a.n * b.n) as cos from w a join w b on a.id <> b.id))
"""

ORACLE = {
    "p6_found": _COSINES + "select distinct least(id, other) as node_a, greatest(id, other) as node_b from ranked where place <= 5 and cos >= 0.8",
}
