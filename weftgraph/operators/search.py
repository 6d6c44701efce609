"""Lexical, vector and hybrid search, and budgets on results."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import columns as C
from weftgraph.schema import RRF_K, SIMILARITY_FLOOR


#: Shorter tokens of a query fetch no candidates.
MIN_TOKEN = 3


def candidates(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes worth a score: name or qualified name holds the query or one of its tokens.

    For a query of 4 to 20 characters every node of a branch that has no such
    node is one, so that misspelt queries can be matched by edit distance. The
    plain filter reaches the scan; nothing else is scored where there are
    candidates. There is no cap on their number.
    """
    low = query.strip().lower()
    parts = dict.fromkeys([low, *(t for t in C.query_tokens(query.strip()) if len(t) >= MIN_TOKEN)])
    has = F.lit(False)
    for t in parts:
        has = has | F.lower("name").contains(t) | F.lower("qualified_name").contains(t)
    found = nodes.where(has)
    if not 4 <= len(low) <= 20:
        return found
    return found.unionByName(nodes.join(found.select("branch").distinct(), "branch", "left_anti").select(nodes.columns))


def lexical(nodes: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Candidates that match a query with their score, best first: by score, length of name and qualified name."""
    if not query.strip():
        return nodes.withColumn("score", F.lit(0)).limit(0)
    hits = candidates(nodes, query).withColumn("score", C.lexical_score(query)).where(F.col("score").isNotNull())
    return hits if limit is None else hits.orderBy(F.desc("score"), F.length("name"), "qualified_name", "branch", "id").limit(min(limit, 200))


def node_text(nodes: DataFrame) -> DataFrame:
    """What is embedded of a node: kind, qualified name, signature, documentation, tokens of the name and of its last segment."""
    last = F.element_at(F.split("qualified_name", r"::|\."), -1)
    text = F.concat_ws(" ", "kind", "qualified_name", "def_signature", "def_doc", F.concat_ws(" ", C.tokenize(F.col("name"))), F.concat_ws(" ", C.tokenize(last)))
    return nodes.select("branch", F.col("id").alias("node_id"), text.alias("text"))


def hash_embed(texts: pd.Series, dim: int = 384) -> pd.Series:
    """An offline embedding: signed hashes of words and of three-letter runs, normalised."""
    import zlib

    out = []
    for t in texts.fillna(""):
        v = np.zeros(dim, np.float32)
        for w in t.lower().split():
            for piece in {w, *(w[i : i + 3] for i in range(len(w) - 2))}:
                h = zlib.crc32(piece.encode())
                v[h % dim] += 1.0 if h & 0x8000_0000 else -1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


def embed(texts: DataFrame, encode=hash_embed) -> DataFrame:
    """branch, node_id, vector: ``encode`` maps a series of texts to a series of vectors; any model can stand in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"branch": pdf["branch"], "node_id": pdf["node_id"], "vector": encode(pdf["text"])})

    schema = T.StructType([T.StructField("branch", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    return texts.select("branch", "node_id", "text").mapInPandas(run, schema)


def maintain(index: DataFrame, nodes: DataFrame, encode=hash_embed) -> DataFrame:
    """The index without vectors of dead nodes and with those of new ones."""
    live = nodes.select("branch", F.col("id").alias("node_id"))
    kept = index.select("branch", "node_id", "vector").join(live, ["branch", "node_id"], "left_semi")
    new = node_text(nodes).join(index.select("branch", "node_id"), ["branch", "node_id"], "left_anti")
    return kept.unionByName(embed(new, encode))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", floor: float | None = SIMILARITY_FLOOR, block: int = 512) -> DataFrame:
    """The k most similar rows of ``vectors`` for each query: query_id, key, similarity, place.

    queries: query_id, vector. They are sent to the rows in blocks of ``block``
    and each task keeps k for each query, so one pass over the rows serves a
    block and what is shuffled does not grow with the rows. Rows of another
    length, null and zero vectors match nothing; ties go to the smaller key.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    out = None
    rows = ((r["query_id"], np.array(r["vector"], np.float64)) for r in queries.where("vector is not null").toLocalIterator())
    rows = (x for x in rows if np.linalg.norm(x[1]) > 0)
    while part := list(itertools.islice(rows, block)):  # the driver holds one block at a time
        ids = [i for i, _ in part]
        dim = max(len(v) for _, v in part)
        q = np.stack([v / np.linalg.norm(v) if len(v) == dim else np.zeros(dim) for _, v in part])
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best = [[] for _ in ids]
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["v"]]]
                if not len(pdf):
                    continue
                x = np.array(pdf["v"].tolist(), np.float64)
                n = np.linalg.norm(x, axis=1)
                ok = n > 0
                s = (x[ok] / n[ok, None]) @ q.T
                keys = pdf["k"].to_numpy()[ok]
                for j in range(len(ids)):
                    cand = best[j] + [(-round(float(a), 9), b) for a, b in zip(s[:, j], keys, strict=True) if floor is None or a >= floor]
                    best[j] = sorted(cand)[:k]
            got = [(ids[j], b, -a) for j in range(len(ids)) for a, b in best[j]]
            yield pd.DataFrame(got, columns=["query_id", "k", "similarity"])

        near = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"query_id {qkind}, k {kind}, similarity double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], f"query_id {qkind}, `{key}` {kind}, similarity double, place int")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "k")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", F.col("k").alias(key), F.round("similarity", 6).alias("similarity"), "place")


def reciprocal_rank_fusion(lists: list[DataFrame], by: list[str], limit: int | None = None) -> DataFrame:
    """Sum of 1 / (60 + place) over ranked lists (by..., id, place): by..., id, rrf, place. Ties go to the smaller id."""
    every = lists[0].select(*by, "id", "place")
    for x in lists[1:]:
        every = every.unionByName(x.select(*by, "id", "place"))
    fused = every.groupBy(*by, "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("place"))), 9).alias("rrf"))
    w = Window.partitionBy(*by).orderBy(F.desc("rrf"), "id")
    out = fused.withColumn("place", F.row_number().over(w))
    return out if limit is None else out.where(F.col("place") <= limit)


def hybrid(nodes: DataFrame, index: DataFrame, query: str, limit: int = 10, encode=hash_embed) -> DataFrame:
    """Lexical and vector search of one branch fused by rank; without vectors the lexical list alone. id, rrf, place."""
    lex = lexical(nodes, query, limit)
    w = Window.orderBy(F.desc("score"), F.length("name"), "qualified_name", "id")  # at most `limit` rows
    a = lex.withColumn("place", F.row_number().over(w)).select(F.lit(query).alias("query"), "id", "place")
    if index.isEmpty():
        return reciprocal_rank_fusion([a], ["query"], limit)
    q = nodes.sparkSession.createDataFrame([(query, list(map(float, encode(pd.Series([query]))[0])))], "query_id string, vector array<double>")
    near = cosine_top_k(index, q, 2 * limit, "node_id", "vector")
    b = near.select(F.col("query_id").alias("query"), F.col("node_id").alias("id"), "place")
    fused = reciprocal_rank_fusion([a, b], ["query"], 3 * limit)
    live = nodes.where("kind <> 'section'").select("id").distinct()
    out = fused.join(live, "id", "left_semi")
    again = Window.partitionBy("query").orderBy(F.desc("rrf"), "id")
    return out.withColumn("place", F.row_number().over(again)).where(F.col("place") <= limit).select("query", "id", "rrf", "place")


def search_envelope(hits: DataFrame) -> DataFrame:
    """Hits with the first lines of signature (120 characters) and documentation (180)."""
    return hits.select(
        "branch", "id", "name", "kind", "file", "start_line", "score",
        C.first_line(F.col("def_signature"), 120).alias("signature"), C.first_line(C.doc_text(F.col("def_doc")), 180).alias("summary"),
    )


def within_budget(df: DataFrame, by: list[str], order: list, tokens: int = 2000) -> DataFrame:
    """The longest prefix of each group whose JSON takes at most four bytes a token of the budget (400 at least); one row always stays."""
    room = 4 * max(tokens, 400)
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    w = Window.partitionBy(*by).orderBy(*order)
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__bytes", F.sum(size).over(run)).withColumn("__at", F.row_number().over(w)).where((F.col("__bytes") <= room) | (F.col("__at") == 1)).drop("__bytes", "__at")
