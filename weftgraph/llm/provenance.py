"""Source files that were not written by hand in their repository.

Generated code, minified scripts, vendored copies and data stored as code. A
multi-pattern automaton finds generation notices in file headers; path rules
know vendored directories, lock files and suffixes; measures of the code tell
minified files and data; shingles find altered copies of library files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phrases of generation notices, lower case: those that a tool writes of its own work, and warnings that follow from it.
MADE = [
    "generated by", "generated from", "generated using", "generated with", "generated via", "generated file", "generated code", "generated source", "generated automatically", "automatically generated", "file is generated", "file was generated", "code is generated", "code was generated",
    "auto-generated", "autogenerated", "machine-generated", "machine generated", "machine-written", "machine written", "produced automatically", "automatically produced", "automatically created", "produced by", "created automatically", "compiled from", "compiled by", "transpiled from", "emitted by",
    "regenerate with", "to regenerate", "re-run the generator", "output, sha", "automatisch erzeugt", "automatisch generiert", "généré automatiquement", "généré par", "generado automáticamente", "generado por", "gerado automaticamente", "gerado por", "自动生成", "自動生成",
]
MARKS = ["@generated", "<auto-generated", "<autogenerated"]
WARNINGS = [
    "do not edit", "do not modify", "do not change", "don't edit", "don't modify", "don't change", "never edit", "not edit by hand", "edits will be lost", "changes will be lost", "changes will be overwritten", "any change here is", "any changes here", "will be overwritten", "is overwritten", "are overwritten",
    "nicht von hand", "nicht manuell", "nicht bearbeiten", "nicht ändern", "ne pas modifier", "ne pas éditer", "no editar", "no modificar", "não edite", "não editar", "请勿修改", "请勿编辑", "不要修改", "编集しない", "編集しない", "編集しないで",
]
#: Phrases that tell that a file is written by hand now, whatever else its header says.
BY_HAND = [
    "used to be generated", "once generated", "originally generated", "formerly generated", "no longer generated", "not generated", "edited by hand", "by hand since", "maintained by hand", "hand-maintained", "hand maintained", "hand-written", "hand written", "handwritten", "written by hand", "hand-edited",
]
#: What may stand before a phrase of making in its clause: the file itself, not a thing that the code makes.
_ITSELF = frozenset(
    "this the a an file files code source sources module class package document output script header content contents of is was has been be are were it entirely whole entire fully automatically auto and warning note notice attention caution important please bitte diese dieser datei wurde ist wird von ce fichier a été est "
    "este archivo arquivo fue foi es é generated do not edit modify change don't by hand danger achtung any manual your local or because since so as never change changes edit edits here stub stubs bindings binding all here copyright".split()
)
#: What may follow a phrase of making that does not name its tool: the file or nothing; anything else is what the code makes.
_OF_FILE = re.compile(r"\s*(?:$|[.!;:,)*/\]>—–-]|(?:files?|code|sources?|stubs?|bindings?|by|from|using|with|via|on|at|for|contents?|output|and|do|don't|please)\b|[^\x00-\x7f])")
#: What may follow a warning in its clause: the file, or how; anything else is what must not be edited.
_AFTER = re.compile(
    r"\s*(?:$|[.!;:,)*/\]>—–-]|(?:(?:this|the|it|any|its)\s+)?(?:generated\s+)?(?:file|code|source|output|it|this|contents?|here)\b(?!\s+(?:of|in|for|order))|(?:it\s+)?(?:by hand|manually|directly|anything)\b|(?:as|because|since|instead|changes|edits|all|your)\b|[^\x00-\x7f])"
)

# Directories and file names of vendored and generated code.
VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|external|externals|deps|godeps|pods|carthage|site-packages|jspm_packages|extern|contrib/vendor)/[^/]+(?:/|$)", re.I)
GENERATED_DIR = re.compile(r"(?:^|/)(?:gen|generated|autogen|auto-?generated|__generated__|generated-sources|generated-src|_generated)/", re.I)
GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|_grpc\.\w+|_pb\.(?:js|ts|rb)|\.pb(?:\.\w+)*\.(?:go|cc|h|dart)|\.pb\.go|_gen\.\w+|_generated\.\w+|\.gen(?:erated)?\.\w+|\.g\.(?:dart|cs|ts)|\.designer\.\w+|_autogen\.\w+|(?:^|/)zz_generated[.\w]*|_string\.go\Z(?!.))$", re.I
)
MINIFIED_NAME = re.compile(r"(?:[.-](?:min|bundle|pack(?:ed)?|prod)\.(?:js|mjs|cjs|jsx|css|ts)|\.chunk\.js|-min\.js)$", re.I)
LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|go\.sum|composer\.lock|gemfile\.lock|uv\.lock|pipfile\.lock)$", re.I)


def automaton():
    """One automaton for all phrases; it is built once in each worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("made", MADE), ("mark", MARKS), ("warning", WARNINGS), ("hand", BY_HAND)):
        for p in phrases:
            a.add_word(p, (kind, p))
    a.make_automaton()
    return a


_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!\[|include|define|if|!)|/\*|\*|<!--|--|;|\"\"\"|''')")
_PREAMBLE = re.compile(r"^\s*(?:package [\w.]+;?|#!.*|['\"]use strict['\"];?|\"\"\"|'''|\*/|-->|[}{\])]*|#!\[.*|// @ts-\w+|from __future__ .*)\s*$")


def header(text: str) -> list[str]:
    """Comment lines at the head of a file, up to the first code."""
    out, block = [], ""
    for line in text.lstrip("﻿").splitlines():
        s = line.strip()
        if block:
            out.append(s)
            if block in s:
                block = ""
            continue
        if s.startswith("/*") and "*/" not in s:
            block = "*/"
        elif s.startswith("<!--") and "-->" not in s:
            block = "-->"
        elif s[:3] in ('"""', "'''") and s.count(s[:3]) == 1:
            block = s[:3]
        elif not _COMMENT_LINE.match(line) and not _PREAMBLE.match(line):
            break
        out.append(s)
    return out


_QUOTES = re.compile(r"'[^'\n]{1,60}'(?!\w)|\"[^\"\n]{1,60}\"|`[^`\n]{1,60}`|“[^”\n]{1,60}”")
_CLAUSE = re.compile(r"(?<=[.!?;:])\s+|\s[—–-]\s")
_WORDS = re.compile(r"[^\W\d_]+(?:'[a-z]+)?")


def generation_notice(text: str, auto) -> bool:
    """Whether the header says that a tool made this file; a header about generation is none.

    Quoted phrases are talked about. A phrase of making counts if its clause
    says it of the file itself; a warning counts if it is against edits of the
    file as a whole. A header that says that the file is kept by hand has none.
    """
    found = False
    for line in header(text):
        low = _QUOTES.sub(" ", line.lower())
        hits = [(end - len(p) + 1, end + 1, k, p) for end, (k, p) in auto.iter(low)]
        if not hits:
            continue
        if any(k == "hand" for *_, k, _ in hits):
            return False
        if found:
            continue
        starts = [0, *(m.end() for m in _CLAUSE.finditer(low))]
        for at, end, kind, phrase in hits:
            if phrase[0].isascii() and phrase[0].isalpha() and at and (low[at - 1].isalnum()):
                continue
            before = low[max(x for x in starts if x <= at) : at]
            if not _ITSELF.issuperset(_WORDS.findall(before)) and phrase.isascii():
                continue
            if kind == "made":
                found = not phrase.endswith(("generated", "automatically", "written", "produced", "created")) or bool(_OF_FILE.match(low, end))
                found = found and not re.match(r"s?\s*(?:code|files?|sources?)? ?(?:are|were|has|have|must|may|can)\b", low[end:])
            elif kind == "warning" and not phrase.endswith(("lost", "overwritten", "here is", "here", "build")):
                found = bool(_AFTER.match(low, end))
            else:
                found = True
            if found:
                break
    return found


_NOISE = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`?)|(?P<h>#[^\n]*)", re.S
)
_DEFINES = re.compile(r"\b(?:def|func|fn|function|impl|trait|return|if|for|while|switch|match|lambda)\b|=>|\bpublic\s+\w+\s+\w+\(")
_LITERAL = re.compile(r"-?\b0[xX][0-9a-fA-F_]+[uUlL]?\d*\b|-?\b\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?[uUiIlLfF]?\d*\b|\b(?:true|false|null|None|True|False|nil|undefined)\b|\"\"")
_TABLE = re.compile(r"[\[({][\s\[\](){},:;\"0-9a-fA-FxX_.+-]*[\])}]")


def measures(text: str, python: bool) -> tuple[int, float, float, bool]:
    """Longest code line, share of white space in it, share of literals in the code, and whether anything is defined.

    Comments are left out and strings stand as empty, but their length counts as literal.
    """
    literal = 0
    out, at = [], 0
    for m in _NOISE.finditer(text):
        if m["h"] is not None and not python:
            continue
        out.append(text[at : m.start()])
        if m["s"] is not None:
            literal += len(m[0])
            out.append('""')
        at = m.end()
    out.append(text[at:])
    code = "".join(out)
    lines = code.split("\n")
    longest = max(lines, key=len) if lines else ""
    white = sum(c.isspace() for c in longest.strip()) / max(1, len(longest.strip()))
    body = [x for x in lines if x.strip() and not re.match(r"\s*(?:import|from|use|package|#include|module|@|//)", x)]
    joined = "\n".join(body)
    numbers = sum(len(m[0]) + 1 for m in _LITERAL.finditer(joined))
    keys = sum(len(m[0]) for m in re.finditer(r"\"\"\s*:", joined))
    solid = len(re.sub(r"\s+", "", joined)) + literal
    share = min(1.0, (literal + numbers + keys) / max(1, solid))
    return len(longest.strip()), white, share, bool(_DEFINES.search(joined))


def verdict(file: str | None, text: str | None, auto) -> str | None:
    """'vendored', 'generated', 'minified', 'data' or None for one file, without comparison to libraries."""
    path = (file or "").replace("\\", "/")
    if VENDOR_DIR.search(path):
        return "vendored"
    if LOCK_NAME.search(path) or GENERATED_DIR.search(path) or GENERATED_NAME.search(path):
        return "generated"
    if MINIFIED_NAME.search(path):
        return "minified"
    if not text or not text.strip():
        return None
    if generation_notice(text, auto):
        return "generated"
    longest, white, share, defines = measures(text, path.endswith((".py", ".pyi")))
    if longest >= 300 and white <= 0.16 and share < 0.75:
        return "minified"
    if len(text) >= 200 and not defines and share >= 0.75:
        return "data"
    return None


_TOKEN = re.compile(r"\w+")


def shingles(text: str, size: int = 5) -> list[int]:
    """Distinct shingles of ``size`` words as 64-bit hashes; a shorter text is one shingle."""
    import xxhash

    words = _TOKEN.findall(text)
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    return list({xxhash.xxh3_64_intdigest(" ".join(words[i : i + size])) - (1 << 63) for i in range(n)})


def _shingled(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t or "", size) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n": [len(s) for s in sets], "s": sets})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, n int, s array<bigint>")


#: Library shingles up to this number are broadcast; more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


#: Shingles that the contained side has at least: fewer lines come about by chance.
LEAST_SHINGLES = 12


def library_copies(files: DataFrame, libraries: DataFrame, size: int = 5, least: float = 0.8, at_least: int = LEAST_SHINGLES) -> DataFrame:
    """file_id of files whose shingles agree with those of a library file: containment either way of at least ``least``.

    The side that is contained must have ``at_least`` shingles, unless the texts
    have all of theirs in common.

    A copy of the whole file with lines added or changed keeps most of its
    shingles. Identical texts are compared once. Shingles of the library are
    counted first and broadcast only below a bound. Empty texts match nothing.
    """
    texts = files.select("file_id", F.xxhash64("source_text").alias("k"), "source_text").where("length(source_text) > 0")
    distinct = texts.groupBy("k").agg(F.min("source_text").alias("source_text"))
    mine = _shingled(distinct, "k", "source_text", size).select("k", "n", F.explode("s").alias("s"))
    lib = libraries.where("length(source_text) > 0").select(F.concat_ws("\x01", "lib", "lib_version", "file").alias("lk"), "source_text")
    theirs = _shingled(lib, "lk", "source_text", size).select(F.col("k").alias("lk"), F.col("n").alias("ln"), F.explode("s").alias("s"))
    if theirs.count() <= BROADCAST_SHINGLES:
        theirs = F.broadcast(theirs)
    hits = mine.join(theirs, "s").groupBy("k", "lk").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("ln").alias("ln"))
    side = lambda n: (F.col("c") / F.col(n) >= least) & (F.col(n) >= at_least)
    alike = hits.where(side("n") | side("ln") | (F.col("c") == F.col("n")) & (F.col("c") == F.col("ln"))).select("k").distinct()
    return texts.select("file_id", "k").join(alike, "k", "left_semi").select("file_id").distinct()


def current_files(files: DataFrame) -> DataFrame:
    """Of files delivered again, the row parsed last."""
    w = Window.partitionBy("file_id").orderBy(F.col("parsed_at").desc_nulls_last(), F.col("source_text").desc_nulls_last())
    return files.where("file_id is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def not_handwritten(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """file_id and reason ('vendored', 'generated', 'minified', 'data') of files that were not written by hand.

    A null text or path only leaves fewer signs; an empty file is handwritten
    unless its path says otherwise. Files delivered twice count once.
    """
    cur = current_files(files.select("file_id", "file", "source_text", "parsed_at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton()
        for pdf in batches:
            why = [verdict(f, t, auto) for f, t in zip(pdf["file"], pdf["source_text"], strict=True)]
            out = pd.DataFrame({"file_id": pdf["file_id"], "reason": why})
            yield out[out["reason"].notna()]

    own = cur.select("file_id", "file", "source_text").mapInPandas(run, "file_id bigint, reason string")
    copies = library_copies(cur, libraries).withColumn("reason", F.lit("vendored"))
    return own.unionByName(copies).groupBy("file_id").agg(F.max("reason").alias("reason"))
