"""Sources: file trees, version-control output, and their filters."""

from __future__ import annotations

import fnmatch
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import MAX_SOURCE_BYTES, SUPPORTED_EXTENSIONS


def glob_regex(pattern: str) -> str:
    """An ignore pattern as a regular expression on a path or any of its parents."""
    p = pattern.strip().rstrip("/")
    anchored = p.startswith("/") or "/" in p.strip("/")
    body = fnmatch.translate(p.lstrip("/").replace("**/", "\0").replace("**", "\1")).replace("(?s:", "(?:")
    body = body.replace("\0", "(?:.*/)?").replace("\1", ".*").replace("\\Z", "").replace("\\z", "")
    return ("^" if anchored else "(?:^|/)") + body + "(?:/|$)"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is covered by ignore patterns; a later '!pattern' brings paths back. Blank lines and # are comments."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        out = F.when(path.rlike(glob_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)).isin(SUPPORTED_EXTENSIONS)


def watched(path: Column) -> Column:
    """Paths that a watcher reacts to: supported extensions without cjs and markdown, outside of build and dependency folders."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return ext.isin([e for e in SUPPORTED_EXTENSIONS if e not in ("cjs", "markdown")]) & ~path.rlike(r"(^|/)(\.git|target|node_modules|dist|vendor)/")


def read_sources(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Source files below a folder: path (relative), n_bytes, source_text. Larger files than 512 KiB are left out at the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_SOURCE_BYTES)
    base = "/" + root.replace("file://", "").strip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base), "")
    files = raw.select(path.alias("path"), F.col("length").alias("n_bytes"), F.col("content").cast("string").alias("source_text"))
    return files.where(supported(F.col("path")) & ~ignored(F.col("path"), ignore or []))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two manifests (path, blob): path, change ('Added', 'Modified', 'Deleted')."""
    o = old.select("path", F.col("blob").alias("ob"))
    n = new.select("path", F.col("blob").alias("nb"))
    j = o.join(n, "path", "full")
    change = F.when(F.col("ob").isNull(), "Added").when(F.col("nb").isNull(), "Deleted").when(F.col("ob") != F.col("nb"), "Modified")
    return j.select("path", change.alias("change")).where("change is not null")


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def head_sha(repo: str) -> str:
    return _git(repo, "rev-parse", "HEAD").strip()


def git_changes(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """Changed files since a commit, or all of HEAD: path, change. Renames and copies count as added, the old path as deleted."""
    empty = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # fixed value: the id of the empty tree
    rows = []
    for line in _git(repo, "diff", "--name-status", "-M", since or empty, "HEAD").splitlines():
        kind, *paths = line.split("\t")
        if kind[0] == "R":
            rows += [(paths[0], "Deleted"), (paths[1], "Added")]
        else:
            rows.append((paths[-1], {"A": "Added", "C": "Added", "D": "Deleted"}.get(kind[0], "Modified")))
    return spark.createDataFrame(rows, "path string, change string").where(supported(F.col("path")))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """Hunks of unified diffs: lines (seq, line) to file, h_start, h_end, by the new side. Empty hunks are left out.

    Each line knows its file by the last header before it.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("diff_id").orderBy("seq")
    named = lines if "diff_id" in lines.columns else lines.withColumn("diff_id", F.lit(0))
    file = F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 4096), "^b/", "")), ignorenulls=True).over(w)
    start = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 1)
    count = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 2)
    h = named.withColumn("file", file).where(start != "").select(
        "diff_id", "file", start.cast("int").alias("h_start"), F.when(count == "", 1).otherwise(count.cast("int")).alias("c")
    )
    return h.where("c > 0 and file <> '/dev/null'").select("diff_id", "file", "h_start", (F.col("h_start") + F.col("c") - 1).alias("h_end"))


def numstat_log(lines: DataFrame) -> DataFrame:
    """Log lines 'commit <epoch>' and 'added<TAB>deleted<TAB>path' (log_id, seq, line) to path, additions, deletions, ts. Binary files count 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("log_id").orderBy("seq")
    named = lines if "log_id" in lines.columns else lines.withColumn("log_id", F.lit(0))
    ts = F.last(F.when(F.col("line").rlike(r"^commit \d+$"), F.regexp_extract("line", r"(\d+)", 1).cast("bigint")), ignorenulls=True).over(w)
    p = F.split("line", "\t")
    n = lambda i: F.coalesce(F.expr(f"try_cast(split(line, '\\t')[{i}] as bigint)"), F.lit(0))
    return named.withColumn("ts", ts).where(F.size(p) == 3).select(p[2].alias("path"), n(0).alias("additions"), n(1).alias("deletions"), "ts")
