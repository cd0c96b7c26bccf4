"""The whole pipeline behind one object: ingest folders of documents, search by text, image or both."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomegrid.functions.embedding import HashingEmbedder, TextEmbedder, embed_text
from tomegrid.model import IMAGE_DIM
from tomegrid.operators import chunking, images, loading, search
from tomegrid.operators.catalog import Collection
from tomegrid.session import cut, ship_package
from tomegrid.sources import files


class Engine:
    """Ingest and search over one collection. ``make`` builds the text embedder, once per worker."""

    def __init__(self, spark: SparkSession, collection: str = "chunks", make: Callable[[], TextEmbedder] = HashingEmbedder):
        ship_package(spark)
        self.spark, self.make = spark, make
        model = make()
        self._model = model
        self.collection = Collection(spark, collection, model.name, model.dim)

    def chunk_folder(self, folder: str, target: str, *, recursive: bool = False, strict: bool = True) -> None:
        """Markdown files to JSON Lines chunks."""
        chunked = chunking.chunk_documents_strict if strict else chunking.chunk_documents
        done = chunked(files.read_markdown(self.spark, folder, recursive=recursive))
        files.write_chunks(chunking.chunk_objects(done, carry=("ordinal",)), target, ordinal=F.col("ordinal"))

    def load_folder(self, folder: str, *, catalog: DataFrame | None = None, image_vectors: DataFrame | None = None, skip_existing: bool = False) -> DataFrame:
        """JSON Lines chunks into the collection; returns the summary per file.

        ``catalog`` (path, is_file) resolves image references, else they are kept as written. ``image_vectors``
        (path, image_vector) gives the vectors whose mean is a chunk's; chunks without any get the zero vector.
        """
        got = files.read_chunks(self.spark, folder)
        file = F.coalesce("metadata.source_file", "file_name")
        text = loading.pick_text(F.col("text"), F.col("content"))
        refs = loading.merge_image_paths(images.extract_refs(text), F.coalesce("metadata.image_paths", "image_paths"))
        rows = got.select(file.alias("source_file"), "chunk_id", "id", text.alias("text"), refs.alias("refs")).withColumn("chapter", loading.chapter_from_file(F.col("source_file")))
        # numbered once and written, so a row has one number whatever is joined to it; ids go on from those stored
        rows = cut(rows.withColumn("ordinal", F.monotonically_increasing_id()), "load")
        if catalog is not None:
            resolved = images.resolve(rows.select("ordinal", "chapter", F.explode("refs").alias("ref")).distinct(), catalog, keys=["ordinal"])
            rows = rows.join(resolved, "ordinal", "left")
        else:
            rows = rows.withColumn("image_paths", F.col("refs"))
        rows = rows.withColumn("image_paths", F.coalesce("image_paths", F.array().cast("array<string>")))
        rows = rows.withColumn("chunk_id", loading.pick_chunk_id(F.col("chunk_id"), F.col("id"), F.col("chapter"), F.col("ordinal")))
        zero = F.array_repeat(F.lit(0.0), IMAGE_DIM)
        if image_vectors is not None:
            parts = rows.select("ordinal", F.explode("image_paths").alias("path")).distinct().join(image_vectors, "path").select("ordinal", "image_vector")
            vectors = loading.vector_means(parts, key="ordinal", vector="image_vector").withColumnRenamed("mean", "image_vector")
            rows = rows.join(vectors, "ordinal", "left").withColumn("image_vector", F.coalesce("image_vector", zero))
        else:
            rows = rows.withColumn("image_vector", zero)
        if skip_existing:
            rows = loading.skip_existing(rows, self.collection.rows())
        first = self.collection.rows().agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        placed = loading.clustered(rows, within="ordinal")
        self.collection.append(loading.collection_rows(placed, embed_text(F.col("text"), self.make), F.col("image_vector"), id_=F.col("ordinal") + F.lit(first)), placed=True)
        return loading.load_summary(rows)

    def _vector(self, query: str) -> list[float]:
        return np.asarray(self._model.encode([query])[0], dtype=float).tolist()

    def search_text(self, query: str, limit: int = 5, *, chapter: str | None = None, with_images_only: bool = False) -> DataFrame:
        where = search.both(search.chapter_is(chapter), F.col("has_image") if with_images_only else None)
        return self._hits(search.top_k(self.collection.rows(), self._vector(query), limit, vector="text_vector", where=where), "text")

    def search_image(self, vector: list[float], limit: int = 5, *, chapter: str | None = None) -> DataFrame:
        return self._hits(search.top_k(self.collection.rows(), vector, limit, vector="image_vector", where=search.chapter_is(chapter)), "image")

    def search_hybrid(self, query: str, vector: list[float] | None = None, limit: int = 5, *, text_weight: float = 0.7, image_weight: float = 0.3) -> DataFrame:
        """Fused search; without an image it is the text search."""
        if vector is None:
            return self.search_text(query, limit)
        return search.hybrid_hits(self.search_text(query, 2 * limit), self.search_image(vector, 2 * limit), limit, text_weight=text_weight, image_weight=image_weight)

    @staticmethod
    def _hits(rows: DataFrame, search_type: str) -> DataFrame:
        return rows.select("id", "score", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), "image_paths", "source_file", "chapter", "has_image", F.lit(search_type).alias("search_type"))
