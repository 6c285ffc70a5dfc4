"""File trees and archives as tables (path, length, content)."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.temporal import let

# Fixed values of the target behaviour.
TEXT_EXTENSIONS = (
    ".py .java .cpp .c .h .txt .md .rst .json .yaml .yml .xml .html .css .sql .sh .bat"
).split()
IGNORE_PATTERNS = (
    "__pycache__ *.pyc .git .svn .DS_Store *.log .pytest_cache .mypy_cache"
).split()


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: path relative to it, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    return files.select(F.substring(rel, F.lit(len(base) + 1), F.length(rel)).alias("path"), "length", "content")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot, lower case, '' if none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^./]+)$", 1))


def glob_regex(pattern: str, fold: bool = False) -> str:
    """Anchored Java regex of a shell pattern (``*``, ``?``, ``[..]``)."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return ("(?isuU)" if fold else "(?s)") + f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """A pattern hits if it matches any part of the path, or is a substring of it."""
    cond = F.lit(False)
    parts = F.split(path, "/")
    for p in patterns:
        cond = cond | F.exists(parts, _matches(glob_regex(p))) | path.contains(p)
    return cond


def _matches(regex: str):
    return lambda x: x.rlike(regex)


def source_tree_scan(files: DataFrame, extra_ignores: list[str] = ()) -> DataFrame:
    """Files not ignored, by path."""
    hit = ignored(F.col("path"), [*IGNORE_PATTERNS, *extra_ignores])
    return files.where(~hit).orderBy("path")


def text_file_scan(files: DataFrame) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(TEXT_EXTENSIONS))


def skipped_files(files: DataFrame, limit: int) -> DataFrame:
    """(path, length) of the files a size limit leaves out."""
    return files.where(F.col("length") > limit).select("path", "length")


def decoded(files: DataFrame, limit: int | None, strict: bool) -> DataFrame:
    """Files, up to ``limit`` bytes if given, with ``content`` as text.

    Undecodable files are dropped if ``strict``; otherwise bad bytes are
    left out. The size test comes before the content is touched.
    """
    small = files if limit is None else files.where(F.col("length") <= limit)
    if dict(files.dtypes)["content"] == "string":
        return small
    if strict:
        text = F.try_validate_utf8(F.col("content").cast("string"))
        return small.withColumn("content", text).where(F.col("content").isNotNull())
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return small.withColumn("content", text)


def file_search(files: DataFrame, pattern: str, max_results: int | None = None) -> DataFrame:
    """Paths that match a glob (whole path) or hold a text, case ignored."""
    if "*" in pattern or "?" in pattern:
        hit = F.col("path").rlike(glob_regex(pattern, fold=True))
    else:
        hit = F.lower("path").contains(pattern.lower())
    found = files.where(hit).select("path").orderBy("path")
    return found.limit(max_results) if max_results else found


def matching_patterns(files: DataFrame, patterns: list[str], distinct: bool = False) -> DataFrame:
    """Files whose name matches a pattern; once per matching pattern unless ``distinct``."""
    name = basename(F.col("path"))
    hits = F.array(*[F.when(name.rlike(glob_regex(p)), F.lit(p)) for p in patterns])
    hits = F.array_compact(hits)
    if distinct:
        return files.where(F.size(hits) > 0)
    return files.withColumn("pattern", F.explode(hits))


# Line breaks as text readers see them.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_number, line): one row per line, from 1."""
    def trimmed(parts: Column) -> Column:
        last = F.element_at(parts, -1) == ""
        return F.slice(parts, 1, F.size(parts) - last.cast("int"))

    parts = let(F.split("content", LINE_BREAKS, -1), trimmed)  # split once per file
    rest = [c for c in files.columns if c not in ("content", "length")]
    out = files.select(*rest, F.posexplode(parts).alias("at", "line"))
    return out.withColumn("line_number", (F.col("at") + 1).cast("int")).drop("at")


def content_search(files: DataFrame, pattern: str, file_patterns: list[str] | None = None,
                   is_regex: bool = False, max_results: int | None = None, size_limit: int | None = None) -> DataFrame:
    """Matching lines (file_path, line_number, line_content, match_score), case ignored."""
    chosen = matching_patterns(files, file_patterns) if file_patterns else text_file_scan(files)
    rx = f"(?iuU){pattern}" if is_regex else "(?iuU)" + re.escape(pattern)
    texts = decoded(chosen, size_limit, strict=False).select("path", "length", "content")
    if not is_regex:  # a file without the text has no line with it
        texts = texts.where(F.col("content").rlike(rx))
    hits = lines_of(texts)
    hits = hits.where(F.col("line").rlike(rx)).select(
        F.col("path").alias("file_path"), "line_number",
        F.regexp_replace("line", r"^\s+|\s+$", "").alias("line_content"), F.lit(1.0).alias("match_score"))
    hits = hits.orderBy("file_path", "line_number")
    return hits.limit(max_results) if max_results else hits


def files_searched(files: DataFrame, file_patterns: list[str] | None = None, size_limit: int | None = None) -> DataFrame:
    chosen = matching_patterns(files, file_patterns) if file_patterns else text_file_scan(files)
    chosen = chosen if size_limit is None else chosen.where(F.col("length") <= size_limit)
    return chosen.agg(F.count("*").alias("total_files_searched"))


BAD_ARCHIVE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)
MEMBER_SCHEMA = "archive string, path string, length bigint, content binary, error string"


def archive_scan(archives: DataFrame) -> DataFrame:
    """Members of zip and wheel archives given as (path, content).

    One row per member; an archive that is damaged, encrypted or packed by an
    unknown method gives one row with ``error``, and no members.
    """
    columns = ["archive", "path", "length", "content", "error"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        members = [m for m in z.infolist() if not m.is_dir()]
                        for m in members:  # to the end and its checksum, block by block
                            with z.open(m) as f:
                                while f.read(2**20):
                                    pass
                        for m in members:
                            data = z.read(m)
                            rows.append((name, m.filename, len(data), data, None))
                            size += len(data)
                            if size > 2**24:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, size = [], 0
                except BAD_ARCHIVE:
                    rows.append((name, None, None, None, f"Invalid or corrupted archive: {name}"))
        yield pd.DataFrame(rows, columns=columns)

    wanted = archives.where(F.lower("path").rlike(r"\.(zip|whl)$")).select("path", "content")
    return wanted.mapInPandas(unpack, MEMBER_SCHEMA)


def codebase_language(files: DataFrame, group: str) -> DataFrame:
    """``python`` for a group with any .py file, else ``unknown``."""
    is_py = F.bool_or(F.col("path").endswith(".py"))
    return files.groupBy(group).agg(F.when(is_py, "python").otherwise("unknown").alias("language"))
