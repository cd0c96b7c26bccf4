"""Duplicates hidden by formatting: an incremental ledger of canonical-key counts.

The canonical key of a chunk is a 128-bit digest of the words of its body, in order, and of its header's
fields, in any order. The ledger is a Parquet table bucketed by key, its base, and the aggregates of batches since, its
deltas. A batch is aggregated to one row per key (map-side first, so a key that holds a third of all rows costs one row
per task) and appended as a delta, so what it costs goes by its own size. Reading full-outer-joins the base with the
deltas' rows of the matching buckets, adding counts and keeping the earliest representative; the base is stored in its
buckets, so only the deltas are exchanged. Once the deltas hold a share of the base's keys, or are many, the same join is written as the
new base, with more buckets if its keys ask for them. Each generation is written aside; a manifest, made current by a rename, names
the base and its deltas, so a job that dies half-way leaves the ledger as it was.

Defined results: null content and bodies without a word are left out; equal rows count once each; an empty
batch changes nothing; extra columns are ignored; the kept row is the smallest id (no ties, ids are unique;
where ids repeat, each row counts).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomegrid.llm.text import body, header_fields, word_string
from tomegrid.session import cut, shared_dir

#: Keys a bucket holds at most after a compaction, the share of the base that deltas may reach, and how many there may be, before one.
KEYS_PER_BUCKET, COMPACT_SHARE, MAX_DELTAS = 1_000_000, 0.25, 16


def copy_key(content: Column) -> Column:
    """Digest shared by copies; null where the body has no word."""
    words = word_string(body(content))
    plain = F.concat(F.array_join(header_fields(content), "\x1f"), F.lit("\x1e"), words)
    return F.when(words != "", F.unhex(F.md5(plain)))


def keyed(chunks: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, key) of the rows that have a key, plus the named extra columns."""
    got = chunks.where(F.col("content").isNotNull()).select("row_id", copy_key(F.col("content")).alias("key"), *carry)
    return got.where(F.col("key").isNotNull())


class CopyLedger:
    """Counts of canonical keys over all batches merged so far. ``buckets`` is the number it starts with."""

    SCHEMA = "key BINARY, kept_id BIGINT, copies BIGINT"

    def __init__(self, spark: SparkSession, path: str, *, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or 2 * spark.sparkContext.defaultParallelism

    def _files(self):
        """Hadoop file system of the ledger, and its manifest folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _manifest(self) -> dict:
        """What is current: number, next generation, base, its buckets and keys, deltas (generation, keys), last stream batch."""
        fs, root = self._files()
        done = [int(n[:-5]) for s in (fs.listStatus(root) if fs.exists(root) else ()) if (n := s.getPath().getName()).endswith(".json")]
        if not done:
            return {"at": -1, "next": 0, "base": None, "buckets": self.buckets, "keys": 0, "deltas": [], "batch": -1}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"{max(done)}.json"))
        told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # a line for each delta
        stream.close()
        return told | {"at": max(done)}

    def _publish(self, told: dict) -> None:
        """Make a state current: the manifest appears whole, by a rename."""
        fs, root = self._files()
        path, at = self.spark._jvm.org.apache.hadoop.fs.Path, told["at"] + 1
        out = fs.create(path(root, f"{at}.tmp"), True)
        out.write(bytearray(json.dumps(told | {"at": at}).encode()))
        out.close()
        if not fs.rename(path(root, f"{at}.tmp"), path(root, f"{at}.json")):
            raise RuntimeError(f"another writer has made state {at} of {self.path}")

    def _base(self, told: dict) -> DataFrame:
        """The base as a bucketed table, so that a join on the key needs no exchange of it."""
        name = f"copy_ledger_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {told['buckets']} BUCKETS LOCATION '{self.path}/gen={told['base']}'")
        return self.spark.table(name)

    def _deltas(self, told: dict) -> DataFrame:
        """One row per key of all deltas."""
        got = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/gen={g}" for g, _ in told["deltas"]))
        return got.groupBy("key").agg(F.min("kept_id").alias("new_id"), F.sum("copies").alias("new_copies"))

    def _joined(self, told: dict) -> DataFrame:
        if told["base"] is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        if not told["deltas"]:
            return self._base(told)
        both = self._base(told).join(self._deltas(told), "key", "full_outer")
        return both.select("key", F.least("kept_id", "new_id").alias("kept_id"), (F.coalesce("copies", F.lit(0)) + F.coalesce("new_copies", F.lit(0))).alias("copies"))

    def rows(self) -> DataFrame:
        """The whole ledger: key, kept_id, copies."""
        return self._joined(self._manifest())

    def _write(self, rows: DataFrame, gen: int, buckets: int | None) -> int:
        """A generation, bucketed or plain; returns its number of rows, from the files' footers."""
        path = f"{self.path}/gen={gen}"
        if buckets is None:
            rows.write.mode("overwrite").parquet(path)
        else:
            name = f"copy_ledger_{uuid.uuid4().hex}"
            rows.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
        return self.spark.read.schema(self.SCHEMA).parquet(path).count()

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Add a batch of keyed rows (row_id, key). A stream's batch that is replayed is not added twice."""
        told = self._manifest()
        if batch_id is not None and batch_id <= told["batch"]:
            return
        counts = batch.groupBy("key").agg(F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
        gen, first = told["next"], told["base"] is None
        told |= {"next": gen + 1, "batch": told["batch"] if batch_id is None else batch_id}
        n = self._write(counts, gen, told["buckets"] if first else None)
        if first:
            told |= {"base": gen, "keys": n}
        elif n:
            told["deltas"] = [*told["deltas"], [gen, n]]
        self._publish(told)
        if len(told["deltas"]) > MAX_DELTAS or sum(k for _, k in told["deltas"]) > max(KEYS_PER_BUCKET, COMPACT_SHARE * told["keys"]):
            self.compact()

    def compact(self) -> None:
        """Write base and deltas as a new base; its buckets follow its keys."""
        told = self._manifest()
        if not told["deltas"]:
            return
        buckets = max(told["buckets"], -(-(told["keys"] + sum(k for _, k in told["deltas"])) // KEYS_PER_BUCKET))
        n = self._write(self._joined(told), told["next"], buckets)
        self._publish(told | {"next": told["next"] + 1, "base": told["next"], "buckets": buckets, "keys": n, "deltas": []})

    def follow(self, chunks: DataFrame, checkpoint: str) -> None:
        """Merge a stream of chunks batch by batch to the end of what is there; it can be stopped and taken up again."""
        add = lambda rows, n: self.merge(keyed(rows), n)
        chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collapse(chunks: DataFrame, *, batches: int = 2, buckets: int | None = None) -> DataFrame:
    """The ledger (key, kept_id, copies) after feeding the table in ``batches`` by time of arrival.

    Keys are computed in one scan and written once; the span of arrival and the batches come from these small rows.
    Rows without an arrival time come with the first batch.
    """
    spark = chunks.sparkSession
    keys = cut(keyed(chunks, carry=("loaded_at",)), "copy-keys")
    span = keys.agg(F.min("loaded_at").alias("lo"), F.max("loaded_at").alias("hi")).first()
    if span.lo is None or span.lo == span.hi:
        batch = F.lit(0)
    else:
        width = (span.hi - span.lo) / batches
        batch = reduce(lambda a, b: a + b, [(F.coalesce(F.col("loaded_at") >= F.lit(span.lo + width * i), F.lit(False))).cast("int") for i in range(1, batches)], F.lit(0))
    ledger = CopyLedger(spark, f"{shared_dir(spark)}/tomegrid/ledger-{uuid.uuid4().hex}", buckets=buckets)
    for i in range(batches):
        ledger.merge(keys.where(batch == i).select("row_id", "key"))
    return ledger.rows()
