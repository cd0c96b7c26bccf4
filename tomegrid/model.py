"""Schemas of the document pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Document", "Section", "Chapter", "Paragraph", "Clause")]
    + [T.StructField("contains_tables", T.BooleanType()), T.StructField("contains_images", T.BooleanType()), T.StructField("source_file", T.StringType())]
)
#: Chunk as written to JSON Lines.
CHUNK = T.StructType([T.StructField("id", T.StringType()), T.StructField("metadata", METADATA), T.StructField("content", T.StringType()), T.StructField("created_at", T.StringType())])
#: Chunk as read from any producer: absent fields come as null.
TOLERANT_CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("metadata", T.StructType([*METADATA.fields, T.StructField("image_paths", T.ArrayType(T.StringType()))])),
        T.StructField("text", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("image_paths", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.StringType()),
    ]
)
#: The stored collection.
COLLECTION = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("text_vector", T.ArrayType(T.FloatType(), False)),
        T.StructField("image_vector", T.ArrayType(T.FloatType(), False)),
        T.StructField("text", T.StringType()),
        T.StructField("image_paths", T.ArrayType(T.StringType())),
        T.StructField("source_file", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("has_image", T.BooleanType()),
    ]
)
IMAGE_DIM = 512
DEFAULT_DIM = 384
TEXT_LIMIT_BYTES = 65_535
