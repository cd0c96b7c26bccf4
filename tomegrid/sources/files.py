"""Files in and out: directory scans, Markdown, JSON Lines."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomegrid.functions.strings import unify_newlines
from tomegrid.model import CHUNK, TOLERANT_CHUNK


def scan(spark: SparkSession, folder: str, suffix: str, *, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files with a suffix in any letter case; contents are not read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return got.where(F.endswith(F.lower("path"), F.lit(suffix.lower()))).select("path", "length", "modificationTime")


def matches(path: Column, suffix: str, *, recursive: bool) -> Column:
    """The same test on a catalog's paths."""
    own = F.endswith(F.lower(path), F.lit(suffix.lower()))
    return own if recursive else own & ~F.contains(path, F.lit("/"))


def name_below(path: Column, root: str) -> Column:
    """A file's path below a folder, decoded; ``root`` is the folder as ``root_of`` gives it."""
    own = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # a path's plus is a plus
    bare = F.regexp_replace(own, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    return F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).otherwise(bare)


def root_of(spark: SparkSession, folder: str) -> str:
    """The absolute path of a folder without its scheme and authority, ended by a slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"


def read_markdown(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """(file_name, text) of Markdown files, universal newlines; the name is the path below the folder, so equal base names stay apart."""
    got = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[mM][dD]").text(folder, wholetext=True)
    return got.select(name_below(F.col("_metadata.file_path"), root_of(spark, folder)).alias("file_name"), unify_newlines(F.col("value")).alias("text"))


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of any producer's *.jsonl files, schema on read; blank lines are skipped, a malformed line is an error.

    ``file_name`` is the path below the folder; the further parts of a long file (see ``write_chunks``) have the name of its first.
    A folder without such files is an error, as is one that does not exist.
    """
    if spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(folder).select("path").isEmpty():
        raise FileNotFoundError(f"no *.jsonl files in {folder}")
    got = spark.read.schema(TOLERANT_CHUNK).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json(folder)
    name = name_below(F.col("_metadata.file_path"), root_of(spark, folder))
    return got.withColumn("file_name", F.regexp_replace(name, r"\.part\d+(\.chunked\.jsonl)$", "$1"))


#: Rows of one written file at most; longer ones go on in parts.
ROWS_PER_FILE = 100_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or as a URI of any scheme the executors can reach."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(folder)) if "://" not in folder else fs.FileSystem.from_uri(folder)


def save_lines(rows: DataFrame, folder: str) -> DataFrame:
    """(name, lines) of the files written below a folder: one for each run of equal names of (name, line), as the rows come.

    A file is written under a name of its own and then moved, so a task that is run again replaces whole files by equal ones.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        name, out, n, made, temporary = None, None, 0, [], ""

        def close() -> None:
            if out is not None:
                out.close()
                system.move(temporary, f"{root}/{name}")
                made.append((name, n))

        for b in batches:
            for own, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != name:
                    close()
                    name, n = own, 0
                    parent = f"{root}/{name}".rpartition("/")[0]
                    system.create_dir(parent, recursive=True)
                    temporary = f"{parent}/.{uuid.uuid4().hex}.tmp"
                    out = system.open_output_stream(temporary)
                out.write((line + "\n").encode())
                n += 1
        close()
        yield pa.RecordBatch.from_pydict({"name": pa.array([m[0] for m in made], pa.string()), "lines": pa.array([m[1] for m in made], pa.int64())})

    return rows.select("name", "line").mapInArrow(write, "name STRING, lines BIGINT")


def stem(name: Column) -> Column:
    """A relative file name without its last suffix; steps up or to the root are taken out, so it stays below the folder."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", ""), r"(^|/)(\.\.?/|/)+", "$1")


def write_chunks(chunks: DataFrame, folder: str, *, by: Column | None = None, ordinal: Column | None = None) -> int:
    """Chunks as JSON Lines, <stem>.chunked.jsonl for each source file; returns the number of files. A document without chunks leaves none.

    Lines stand in the order of ``ordinal`` (a chunk's place in its file), and its range tells the part: rows from ROWS_PER_FILE on go to
    <stem>.part1.chunked.jsonl and so on, each written by one task, so no file's size rests on one. Without an ordinal
    rows are placed by a hash of their content among as many parts as the source has rows for.
    """
    source = by if by is not None else F.col("metadata.source_file")
    line = F.to_json(F.struct(*CHUNK.fieldNames()), {"ignoreNullFields": "false"})
    rows = chunks.select(F.coalesce(source, F.lit("none")).alias("source"), line.alias("line"), (ordinal if ordinal is not None else F.lit(None)).cast("bigint").alias("ordinal"))
    if ordinal is None:
        counts = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_FILE)).alias("parts"))
        rows = rows.join(counts.where("parts > 1"), "source", "left").withColumn("part", F.pmod(F.xxhash64("line"), F.coalesce("parts", F.lit(1))))
    else:
        rows = rows.withColumn("part", F.floor(F.col("ordinal") / F.lit(ROWS_PER_FILE)))
    name = F.concat(stem(F.col("source")), F.when(F.col("part") > 0, F.concat(F.lit(".part"), F.col("part").cast("string"))).otherwise(""), F.lit(".chunked.jsonl"))
    placed = rows.withColumn("name", name).repartition("name").sortWithinPartitions("name", "ordinal")
    return save_lines(placed, folder).count()


def write_markdown(docs: DataFrame, folder: str) -> int:
    """Markdown documents (file_name, text) as <relative stem>.md below ``folder``; existing ones are replaced. Returns their number."""
    named = docs.where(F.col("text").isNotNull()).select(F.concat(stem(F.col("file_name")), F.lit(".md")).alias("name"), F.col("text").alias("line"))
    return save_lines(named, folder).count()


def copy_files(plan: DataFrame, source: str, target: str) -> DataFrame:
    """(ref, bytes) of the files copied: the plan's existing references, from one folder to another of any file system.

    Only the references travel; each task reads and writes its own files. Missing ones are skipped, as are those outside the folder.
    """

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (origin, from_), (system, to) = opened(source), opened(target)
        for b in batches:
            done = []
            for ref in b.column(0).to_pylist():
                info = origin.get_file_info(f"{from_}/{ref}")
                if info.type == fs.FileType.File and ".." not in ref.split("/"):
                    system.create_dir(f"{to}/{ref}".rpartition("/")[0], recursive=True)
                    with origin.open_input_stream(info.path) as i, system.open_output_stream(f"{to}/{ref}") as o:
                        while piece := i.read(1 << 20):
                            o.write(piece)
                    done.append((ref, info.size))
            yield pa.RecordBatch.from_pydict({"ref": pa.array([d[0] for d in done], pa.string()), "bytes": pa.array([d[1] for d in done], pa.int64())})

    return plan.where("exists").select("ref").distinct().mapInArrow(copy, "ref STRING, bytes BIGINT")
