"""Session helpers: table access by directory and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so Python stages can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tomegrid-code-")) / "tomegrid_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(Path(root.name) / source.relative_to(root)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one table; columns are pruned by whatever consumes it."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row, spread over ``tomegrid.spread`` partitions where the caller sets that.

    A table of the size this is built for has pieces enough, so by default it is read as it lies and no rows move; whoever has a small
    one in few files and many cores asks for the exchange.
    """
    df = table(spark, sf_dir, name)
    spread = int(spark.conf.get("tomegrid.spread", "0"))
    return df.repartition(spread) if spread else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; that value is never replaced. Where it is unset
    the session must be local (tests), and a temporary folder is used. On any other master an unset
    folder is an error, because a machine-local path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = f"file://{tempfile.mkdtemp(prefix='tomegrid-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def write_shared(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> str:
    """Write a table under the shared folder, cutting lineage; returns its path."""
    path = f"{shared_dir(df.sparkSession)}/tomegrid/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from the shared folder: later stages survive lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))
