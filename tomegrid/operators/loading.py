"""Chunks to collection rows, and what is known about a collection."""

from __future__ import annotations

import warnings

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomegrid.functions.strings import blank_to_null
from tomegrid.model import DEFAULT_DIM, TEXT_LIMIT_BYTES


def chapter_from_file(name: Column) -> Column:
    """File name without .chunked.jsonl, or without its last suffix."""
    return F.when(F.endswith(name, F.lit(".chunked.jsonl")), F.regexp_replace(name, r"\.chunked\.jsonl$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def pick_text(text: Column, content: Column) -> Column:
    return F.coalesce(blank_to_null(text), blank_to_null(content), F.lit(""))


def pick_chunk_id(chunk_id: Column, id_: Column, chapter: Column, ordinal: Column) -> Column:
    """Given id, else chapter_ordinal; the ordinal runs over the file, so fallbacks never repeat."""
    return F.coalesce(blank_to_null(chunk_id), blank_to_null(id_), F.concat_ws("_", chapter, ordinal.cast("string")))


def dim_of(models: DataFrame, dims: DataFrame, *, default: int | None = None) -> DataFrame:
    """(model_name, text_dim) of the asked models: configured, else the default, else 384."""
    known = dims.groupBy("model_name").agg(F.min("text_dim").alias("text_dim"))
    return models.join(known, "model_name", "left").select("model_name", F.coalesce("text_dim", F.lit(default), F.lit(DEFAULT_DIM)).alias("text_dim"))


def parse_meta(description: Column) -> Column:
    """struct(text_model, text_dim) of a packed collection description; null where it has none."""
    pattern = r"text_model=([^,]+),\s*text_dim=(\d+)"
    return F.when(
        F.regexp_like(description, F.lit(pattern)),
        F.struct(F.regexp_extract(description, pattern, 1).alias("text_model"), F.regexp_extract(description, pattern, 2).cast("int").alias("text_dim")),
    )


def describe(model: str, dim: int, about: str = "Document chunks") -> str:
    return f"{about}. text_model={model}, text_dim={dim}"


def warn_on_mismatch(expected: tuple[str, int], found: tuple[str, int] | None) -> bool:
    """Warn, never fail, where a collection was made with another model."""
    if found is not None and found != expected:
        warnings.warn(f"collection uses {found[0]} ({found[1]}), the session {expected[0]} ({expected[1]})", stacklevel=2)
        return True
    return False


def merge_image_paths(found: Column, given: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_union(F.coalesce(found, F.array().cast("array<string>")), F.coalesce(given, F.array().cast("array<string>")))))


def collection_rows(chunks: DataFrame, text_vector: Column, image_vector: Column, *, id_: Column | None = None) -> DataFrame:
    """Rows of the stored collection from prepared chunks (chunk_id, text, image_paths, source_file, chapter, ordinal); ids by file and ordinal unless given."""
    over = F.octet_length("text") > TEXT_LIMIT_BYTES
    checked = F.when(over, F.raise_error(F.lit("text over the stored limit"))).otherwise(F.col("text"))
    return chunks.select(
        (id_ if id_ is not None else F.xxhash64("source_file", "ordinal")).alias("id"), "chunk_id", text_vector.cast("array<float>").alias("text_vector"), image_vector.cast("array<float>").alias("image_vector"),
        checked.alias("text"), "image_paths", "source_file", "chapter", (F.size("image_paths") > 0).alias("has_image"),
    )


def clustered(rows: DataFrame, *, by: str = "chapter", within: str = "id") -> DataFrame:
    """Rows placed for a write partitioned by chapter: ranges of (chapter, id), so a chapter has as many tasks as its share of the rows and a small one a single file.

    The ranges are found by a pass over the rows, so rows are best placed before their vectors are computed.
    """
    return rows.repartitionByRange(by, within)


def skip_existing(new: DataFrame, stored: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """New rows whose key isn't stored yet; a null key is always new."""
    return new.join(stored.select(key).distinct(), key, "left_anti")


def load_summary(chunks: DataFrame, *, batch: int = 32) -> DataFrame:
    """Per file: chunks, images and insert batches."""
    return chunks.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.size("image_paths")).alias("images"), F.ceil(F.count(F.lit(1)) / F.lit(batch)).cast("bigint").alias("batches")
    )


def vector_means(vectors: DataFrame, *, key: str, vector: str) -> DataFrame:
    """(key, mean): mean vector of each group, not normalised again; partial sums of whole vectors, one row a group and task. Null vectors are left out."""
    given = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return given.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))


def vector_mean(vectors: DataFrame, *, key: str, vector: str) -> DataFrame:
    """(key, pos, value): the components of ``vector_means``."""
    return vector_means(vectors, key=key, vector=vector).select(key, F.posexplode("mean").alias("pos", "value"))


def stats(rows: DataFrame, name: str, indexed: list[str]) -> DataFrame:
    """One row: name, entities, schema field names, indexed field names."""
    return rows.agg(F.count(F.lit(1)).alias("num_entities")).select(
        F.lit(name).alias("name"), "num_entities", F.lit(",".join(rows.columns)).alias("fields"), F.lit(",".join(indexed)).alias("indexes")
    )
