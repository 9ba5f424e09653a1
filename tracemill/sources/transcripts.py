"""Discovery of transcript files and their scan into numbered records."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tracemill.functions import text as tx
from tracemill.operators import ordinals
from tracemill.sources import shared

#: Where each dialect keeps its transcripts under a home directory (fixed values).
ROOTS = (("claude", ".claude/projects"), ("codex", ".codex/sessions"))
FILES = "source string, path string, mtime timestamp, session_ord long"
PATTERN = "*.jsonl"


@dataclass(frozen=True)
class Transcripts:
    """Folders that hold transcripts, and the files found there: source, path (as shown), uri (as the lines carry it),
    mtime, found (the place of its folder among the folders), and session_ord once they are chosen."""

    roots: tuple[str, ...]
    files: DataFrame


def _name() -> Column:
    """The file that a row comes from, as its path is spelt, with its scheme."""
    return F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


@F.pandas_udf(T.StringType())
def _real(uris: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Where a file on a mounted disk really is, so that one that links reach twice is one."""
    for batch in uris:
        yield batch.map(lambda u: os.path.realpath(u[7:]) if u.startswith("file://") else u)


def _exists(spark: SparkSession, uri: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _uri(home: Path | str) -> str:
    return str(home).rstrip("/") if "://" in str(home) else f"file://{Path(home).expanduser().absolute()}".rstrip("/")  # as it is spelt, blanks and all


def discover(spark: SparkSession, homes: list[Path | str], source: str = "all") -> Transcripts:
    """Every transcript: homes in order, each file once however it is reached.

    Spark lists the folders, in any store that its readers open; what the files hold is not read, and no list of them
    comes to the driver's Python or into a plan. Empty files and names that begin with a dot or an underscore are passed
    over, as by all of Spark's readers.
    """
    roots = [(dialect, f"{_uri(home)}/{under}") for home in homes for dialect, under in ROOTS if source in ("all", dialect)]
    roots = [(n, dialect, uri) for n, (dialect, uri) in enumerate(roots) if _exists(spark, uri)]
    if not roots:
        return Transcripts((), spark.createDataFrame([], "source string, path string, uri string, mtime timestamp, found int"))
    listed = None
    for n, dialect, uri in roots:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(uri)
        one = reader.select(F.lit(dialect).alias("source"), _name().alias("uri"), F.col("_metadata.file_modification_time").alias("mtime"), F.lit(n).alias("found"))
        listed = one if listed is None else listed.unionByName(one)
    first = listed.groupBy(_real("uri").alias("real")).agg(F.min(F.struct("found", "mtime", "uri", "source")).alias("f"))
    files = first.select("f.source", F.regexp_replace("f.uri", "^file://", "").alias("path"), "f.uri", "f.mtime", "f.found")
    return Transcripts(tuple(uri for *_, uri in roots), files)


def choose(found: Transcripts, since: dt.datetime | None = None, newest: int = 0) -> Transcripts:
    """Files from ``since`` on (inclusive), numbered from the oldest on, at most the ``newest`` of them.

    Of equal times the folder found first comes first, then the path."""
    files = found.files if since is None else found.files.where(F.col("mtime") >= F.lit(since))
    files = ordinals.numbered(files, ["mtime", "found", "uri"], "session_ord")
    if newest:
        files = files.where(F.col("session_ord") >= files.count() - newest)
    return replace(found, files=shared.keep(files, "files"))


def file_table(chosen: Transcripts) -> DataFrame:
    return chosen.files.select("source", "path", "mtime", "session_ord")


def read_lines(spark: SparkSession, chosen: Transcripts) -> DataFrame:
    """source, path, mtime, session_ord, line, raw: lines are numbered from 1, blank and broken ones included.

    Only files as new as the oldest chosen one are opened: their time is in the reader's own metadata. A file of any size
    is read in splits by many tasks: a line's number is its place in its split, after the lines of the splits before.
    Bytes that are no UTF-8 become U+FFFD; no more than one line is held at a time.
    """
    oldest = chosen.files.agg(F.min("mtime")).first()[0]
    if oldest is None:
        return spark.createDataFrame([], f"{FILES}, line int, raw string")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN)
    lines = reader.text(list(chosen.roots)).where(F.col("_metadata.file_modification_time") >= F.lit(oldest))
    lines = lines.select(_name().alias("uri"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.make_valid_utf8("value").alias("raw"))
    return numbered(lines).join(chosen.files, "uri").select("source", "path", "mtime", "session_ord", "line", "raw")


def numbered(lines: DataFrame) -> DataFrame:
    """lines (uri, split, at, raw) with their number in the file; ``at`` ascends within a split."""
    counts = lines.groupBy("uri", "split").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("uri").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    splits = counts.select("uri", "split", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    placed = lines.withColumn("place", F.row_number().over(W.partitionBy("uri", "split").orderBy("at")))
    return placed.join(splits, ["uri", "split"]).select("uri", (F.col("ahead") + F.col("place")).cast("int").alias("line"), "raw")


def number_lines(texts: DataFrame, column: str) -> DataFrame:
    """Each line of a text as a row, with its number from 1; any line end counts, the one at the end opens no line."""
    whole = F.regexp_replace(F.col(column), r"(\r\n|\r|\n)\z", "")
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.posexplode(F.split(whole, r"\r\n|\r|\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def records(lines: DataFrame) -> DataFrame:
    """The lines that are JSON objects, as variants in the column rec; others are passed over.

    A line is parsed once: a filter over the parsed column would be pushed below it and parse again. What parses and
    begins with a brace is an object.
    """
    shown = lines.where(F.ltrim("raw", F.lit(" \t\r\n")).startswith("{"))
    parsed = F.filter(F.array(F.try_parse_json(F.trim("raw"))), lambda r: r.isNotNull())
    return shown.select(*(c for c in lines.columns if c != "raw"), F.explode(parsed).alias("rec"))


def stream_lines(spark: SparkSession, root: str, source: str) -> DataFrame:
    """New files under a folder as they come, whole: detection needs all of a file's lines."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    whole = reader.load(root).select(F.lit(source).alias("source"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    return number_lines(whole, "value")
