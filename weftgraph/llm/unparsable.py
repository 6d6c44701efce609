"""Source files that do not parse in the language of their extension."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import grammars, lexing
from weftgraph.llm.provenance import current_files

#: Characters of a chunk.
CHUNK = 2_048
#: Neighbouring maps that are composed in one step of the reduction.
FAN_IN = 16
#: Languages whose maps are exact: what they find unbalanced is invalid. Markup and nested formats can mislead the maps of the others.
EXACT = frozenset(["go", "rust", "java"])


def cut(text: str, size: int = CHUNK) -> list[str]:
    """Chunks of about ``size`` characters that end at line ends; a longer line stays whole."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", min(len(text), at + size) - 1)
        end = len(text) if end < 0 else end + 1
        out.append(text[at:end])
        at = end
    return out or [""]


def _normal(text: str) -> str:
    return text.replace("\r\n", "\n")


def chunk_maps(chunk: str, lang: str, first: bool) -> dict[str, tuple]:
    """The chunk's lexer map; a file's first chunk begins in code."""
    return {s: lexing.chunk_map(chunk, lang, s) for s in ([lexing.CODE] if first else lexing.STATES[lang])}


def _pack(m: dict[str, tuple]) -> str:
    return json.dumps(m)


def _unpack(s: str) -> dict[str, tuple]:
    return {k: tuple(v) for k, v in json.loads(s).items()}


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, number, map) in order of key and number: neighbours of one key and number // FAN_IN are composed."""
    key, run, out = None, -1, None
    for k, no, m in rows:
        if (k, no // FAN_IN) == (key, run):
            out = lexing.compose(out, m)
            continue
        if out is not None:
            yield key, run, out
        key, run, out = k, no // FAN_IN, m
    if out is not None:
        yield key, run, out


def _frames(rows: Iterator[tuple], size: int = 4_096) -> Iterator[pd.DataFrame]:
    while block := list(itertools.islice(rows, size)):
        yield pd.DataFrame([(k, no, _pack(m)) for k, no, m in block], columns=["file_id", "chunk_no", "map"])


_MAPS = "file_id bigint, chunk_no bigint, map string"


def balances(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file_id, balanced of every file (file_id, lang, source_text): its chunks' maps, composed associatively.

    Chunks go to tasks in runs of ``FAN_IN`` neighbours, so a file of any
    length is no single task's work; each round composes up to ``FAN_IN``
    neighbours again, until one map is left of each file. balanced is null
    where templates or comments nest deeper than the maps tell.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(fid, lang, no, part) for fid, lang, text in zip(pdf["file_id"], pdf["lang"], pdf["source_text"], strict=True) for no, part in enumerate(cut(_normal(text), chunk))]
            yield pd.DataFrame(rows, columns=["file_id", "lang", "chunk_no", "chunk"])

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(_runs((k, no, chunk_maps(c, lang, no == 0)) for pdf in batches for k, no, lang, c in zip(pdf["file_id"], pdf["chunk_no"], pdf["lang"], pdf["chunk"], strict=True)))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(_runs((k, no, _unpack(m)) for pdf in batches for k, no, m in zip(pdf["file_id"], pdf["chunk_no"], pdf["map"], strict=True)))

    run = F.expr(f"chunk_no div {FAN_IN}")
    spread = files.mapInPandas(chunks, "file_id bigint, lang string, chunk_no bigint, chunk string").repartition("file_id", run)
    m = spread.sortWithinPartitions("file_id", "chunk_no").mapInPandas(maps, _MAPS)
    longest = files.agg(F.max(F.length("source_text"))).first()[0] or 0
    runs = longest // chunk // FAN_IN + 1  # a chunk ends at a line's end, so there are at most so many of a file
    while runs > 1:
        m = m.repartition("file_id", run).sortWithinPartitions("file_id", "chunk_no").mapInPandas(again, _MAPS)
        runs = -(-runs // FAN_IN)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [lexing.balanced(_unpack(s)[lexing.CODE]) for s in pdf["map"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "balanced": pd.array(ok, dtype="boolean")})

    return m.mapInPandas(judge, "file_id bigint, balanced boolean")


def unparsable_files(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Files whose text is not valid syntax: file_id and reason ('brackets' or 'statement').

    The composed lexer maps settle which files end in code with every bracket
    closed. In Go, Rust and Java a file that does not is flagged by that alone;
    in the other languages once the grammar has rejected it too. Files that
    balance are parsed statement by statement with the local grammars; each
    distinct shape of a statement is parsed once in a worker. Null, blank and
    comment-only texts are valid; files of unknown extension are not judged; of
    files delivered twice the last stands. The size of a chunk does not change
    the result.
    """
    cur = current_files(files.select("file_id", "file", "source_text", "parsed_at"))
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))
    known = F.create_map([x for k, v in lexing.LANGUAGE.items() for x in (F.lit(k), F.lit(v))])
    src = cur.select("file_id", known[ext].alias("lang"), "source_text").where("lang is not null and trim(source_text) <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fid, lang, text, ok in zip(pdf["file_id"], pdf["lang"], pdf["source_text"], pdf["balanced"], strict=True):
                bad = ok is not None and not pd.isna(ok) and not ok
                if bad and lang in EXACT or not grammars.valid(_normal(text), lang):
                    rows.append((fid, "brackets" if bad else "statement"))
            yield pd.DataFrame(rows, columns=["file_id", "reason"])

    return src.join(balances(src, chunk), "file_id").select("file_id", "lang", "source_text", "balanced").mapInPandas(run, "file_id bigint, reason string")


def unparsable_rates(files: DataFrame) -> DataFrame:
    """Share of unparsable files per repo and language of the extension. Null repos form a group."""
    bad = unparsable_files(files).select("file_id", F.lit(1).alias("bad"))
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))
    known = F.create_map([x for k, v in lexing.LANGUAGE.items() for x in (F.lit(k), F.lit(v))])
    cur = current_files(files.select("file_id", "repo", "file", "source_text", "parsed_at")).select("file_id", "repo", known[ext].alias("language"))
    return (
        cur.join(bad, "file_id", "left").groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_unparsable"))
        .withColumn("share", F.round(F.col("n_unparsable") / F.col("n_files"), 6))
    )
