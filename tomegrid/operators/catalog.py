"""Collections as catalog tables: create, append, load, describe, drop."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomegrid.model import COLLECTION, DEFAULT_DIM
from tomegrid.operators import loading

#: Model of last resort (fixed value).
FALLBACK_MODEL = "BAAI/bge-small-en-v1.5"


def load_config(path: str) -> dict | None:
    """Model configuration of a JSON file; None where it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def model_dim(config: dict | None, name: str) -> int:
    """Configured dimension of a model, else the configured default, else 384."""
    if not config:
        return DEFAULT_DIM
    return int((config.get("text_model_dim") or {}).get(name) or config.get("default_dim") or DEFAULT_DIM)


def default_model(config: dict | None) -> tuple[str, int]:
    """(name, dimension) used when nothing else is asked."""
    if not config:
        return FALLBACK_MODEL, DEFAULT_DIM
    name = config.get("default_text_model") or FALLBACK_MODEL
    return name, model_dim(config, name)


@dataclass
class Collection:
    """One stored collection: a table partitioned by chapter whose comment names its embedding model."""

    spark: SparkSession
    name: str
    model: str
    dim: int

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, *, drop_existing: bool = True) -> bool:
        """Make the empty table; an existing one is dropped first, or kept. Returns whether it was made."""
        if self.exists():
            if not drop_existing:
                return False
            self.spark.sql(f"DROP TABLE {self.name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in COLLECTION.fields)
        about = loading.describe(self.model, self.dim).replace("'", "")
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (chapter) COMMENT '{about}'")
        return True

    def append(self, rows: DataFrame, *, skip_existing: bool = False, placed: bool = False) -> None:
        """Add collection rows; vectors must have the collection's dimension. Rows already stored can be left out. ``placed`` rows are clustered already."""
        checked = rows.withColumn(
            "text_vector", F.when(F.size("text_vector") == self.dim, F.col("text_vector")).otherwise(F.raise_error(F.lit("text vector of another dimension")))
        )
        new = loading.skip_existing(checked, self.rows()) if skip_existing else checked
        order = [f.name for f in COLLECTION.fields if f.name != "chapter"] + ["chapter"]
        new = new.select(*order)
        (new if placed else loading.clustered(new)).write.insertInto(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*COLLECTION.fieldNames())

    def load(self) -> DataFrame:
        """The rows, cached for repeated searches; warns where the stored model is another one."""
        loading.warn_on_mismatch((self.model, self.dim), metadata(self.spark, self.name))
        return self.rows().cache()

    def close(self) -> None:
        self.spark.catalog.uncacheTable(self.name)
        self.rows().unpersist()

    def stats(self) -> dict:
        got = loading.stats(self.rows(), self.name, ["text_vector", "image_vector"]).first()
        return {"name": got.name, "num_entities": got.num_entities, "schema": got.fields.split(","), "indexes": got.indexes.split(",")}


def metadata(spark: SparkSession, name: str) -> tuple[str, int] | None:
    """(model, dimension) a stored collection was made with; None where it is absent or doesn't say."""
    if not spark.catalog.tableExists(name):
        return None
    about = next((r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect() if r.col_name == "Comment"), "")
    got = spark.range(1).select(loading.parse_meta(F.lit(about)).alias("m")).first().m
    return (got.text_model, got.text_dim) if got else None
