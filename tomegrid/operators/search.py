"""Filtered top-k similarity search: one query, blocks of queries, fusion of two modalities, coarse index, rerank.

A single query is a literal: filter, score projection, TakeOrderedAndProject. Many queries are broadcast, BLOCK_BYTES of vectors at
most in one scan (more go in several), every partition keeps its own top k per query from matrix products, and the survivors are ranked.
Scores are rounded to six places before they are ranked, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tomegrid.functions.strings import base_name
from tomegrid.functions.vectors import as_double, cosine, dot, literal, norm

#: Bytes of query vectors sent to every task at once, and queries of one matrix product.
BLOCK_BYTES, TILE = 64 << 20, 2048
#: Rows of a cell that one task writes, on average.
ROWS_PER_PIECE = 500_000


def one_vector(rows: DataFrame, *, id_col: str, id_value: int, vector: str) -> list[float]:
    """The stored vector of one id, on the driver."""
    got = rows.where(F.col(id_col) == id_value).select(vector).first()
    if got is None:
        raise KeyError(id_value)
    return [float(x) for x in got[0]]


def scored(rows: DataFrame, query: list[float], *, vector: str) -> DataFrame:
    """Rows with their cosine to the query; the query's norm is computed once, a zero norm on either side gives 0."""
    size = float(np.linalg.norm(np.asarray(query, dtype=float)))
    v = F.col(vector)
    score = F.coalesce(F.try_divide(dot(v, literal(query)), norm(v) * F.lit(size)), F.lit(0.0))
    return rows.withColumn("score", F.round(score, 6))


def top_k(rows: DataFrame, query: list[float], k: int, *, vector: str, id_col: str = "id", where: Column | None = None) -> DataFrame:
    """The k best rows, filtered before they are scored."""
    kept = rows if where is None else rows.where(where)
    return scored(kept, query, vector=vector).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def chapter_is(chapter: str | int | None) -> Column | None:
    """Equality filter on the chapter; nothing asked, no filter."""
    return None if chapter in (None, "") else F.col("chapter") == F.lit(chapter)


def both(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector: str, query_id: str = "query_id", query_vector: str = "query_vector", block: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows of every query; ids equal to the query's are left out."""
    spark = rows.sparkSession
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vector)).alias("dim")).first()
    blocks = max(1, -(-asked.n // (block or max(1, BLOCK_BYTES // (8 * max(1, asked.dim or 1))))))
    placed = queries.select(F.col(query_id).alias("q"), as_double(F.col(query_vector)).alias("v"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(part: DataFrame) -> DataFrame:
        got = part.collect()  # at most a block and its spread
        ids = np.array([r.q for r in got], dtype=np.int64)
        known = spark.sparkContext.broadcast((ids, np.array([r.v for r in got], dtype=float)))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, m = known.value
            if not len(own):
                return
            size = np.linalg.norm(m, axis=1)
            tiles = [slice(i, i + TILE) for i in range(0, len(own), TILE)]
            best = [(np.zeros((len(own[t]), 0), dtype=np.int64), np.zeros((len(own[t]), 0))) for t in tiles]
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.asarray(v, dtype=float) for v in b["v"]])
                i, norms = b["id"].to_numpy(dtype=np.int64), np.linalg.norm(x, axis=1)
                for at, t in enumerate(tiles):
                    length = size[t][:, None] * norms[None, :]
                    s = np.round(np.divide(m[t] @ x.T, length, out=np.zeros_like(length), where=length > 0), 6)
                    s[own[t][:, None] == i[None, :]] = -np.inf
                    score, ident = np.concatenate([best[at][1], s], axis=1), np.concatenate([best[at][0], np.broadcast_to(i, s.shape)], axis=1)
                    order = np.lexsort((ident, -score), axis=1)[:, :k]
                    best[at] = np.take_along_axis(ident, order, 1), np.take_along_axis(score, order, 1)
            top_id, top_score = (np.concatenate([x[j] for x in best]) for j in (0, 1))
            if top_id.shape[1]:
                keep = np.isfinite(top_score)
                yield pd.DataFrame({query_id: np.repeat(own, keep.sum(1)), id_col: top_id[keep], "score": top_score[keep]})

        return rows.select(F.col(id_col).alias("id"), as_double(F.col(vector)).alias("v")).mapInPandas(search, f"{query_id} BIGINT, {id_col} {id_type}, score DOUBLE")

    parts = [run(placed if blocks == 1 else placed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)) for i in range(blocks)]
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_col)))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid(text_hits: DataFrame, image_hits: DataFrame, k: int, *, text_weight: float = 0.7, image_weight: float = 0.3, id_col: str = "id") -> DataFrame:
    """Fusion of two hit lists by weighted score sum. ``score`` stays the single-modality score (text preferred), ``fused_score`` ranks."""
    t = text_hits.select(id_col, F.col("score").alias("text_score"))
    i = image_hits.select(id_col, F.col("score").alias("image_score"))
    zero = F.lit(0.0)
    fused = F.coalesce(F.col("text_score"), zero) * text_weight + F.coalesce(F.col("image_score"), zero) * image_weight
    both_ = t.join(i, id_col, "full_outer").select(
        id_col, F.coalesce("text_score", "image_score").alias("score"), F.round(fused, 6).alias("fused_score"), F.when(F.col("text_score").isNotNull(), "text").otherwise("image").alias("search_type")
    )
    return both_.orderBy(F.desc("fused_score"), F.asc(id_col)).limit(k)


def hybrid_hits(text_hits: DataFrame, image_hits: DataFrame, k: int, *, text_weight: float = 0.7, image_weight: float = 0.3, id_col: str = "id") -> DataFrame:
    """Fusion as ``hybrid`` does it, of whole hit rows of equal columns: each list is read once, the text list's row is kept where both have one."""
    marked = text_hits.withColumn("is_text", F.lit(True)).unionByName(image_hits.withColumn("is_text", F.lit(False)))
    of = lambda text: F.coalesce(F.max(F.when(F.col("is_text") == text, F.col("score"))), F.lit(0.0))
    kept = F.struct(*[c for c in text_hits.columns if c != id_col])
    fused = marked.groupBy(id_col).agg(F.max_by(kept, F.col("is_text")).alias("hit"), F.round(of(True) * text_weight + of(False) * image_weight, 6).alias("fused_score"))
    return fused.select(id_col, "hit.*", "fused_score").orderBy(F.desc("fused_score"), F.asc(id_col)).limit(k)


def hit_format(hits: DataFrame, search_type: str) -> DataFrame:
    """Result rows: missing text as '', image paths decoded from their JSON text, the constant search type."""
    return hits.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("image_paths", F.from_json(F.coalesce("image_paths", F.lit("[]")), "array<string>")).withColumn("search_type", F.lit(search_type))


def backfill_text(hits: DataFrame, stored: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Blank texts of hits, filled from the stored rows of the same id."""
    full = stored.select(F.col(id_col), F.col("text").alias("stored_text"))
    return hits.join(full, id_col, "left").withColumn("text", F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("stored_text"), F.lit(""))).drop("stored_text")


def snippets(hits: DataFrame, *, chars: int = 200, id_col: str = "id") -> DataFrame:
    """Hits for display: rank, score to four places, beginning of the text, three image names and their number."""
    names = F.transform(F.slice("image_paths", 1, 3), base_name)
    return hits.select(
        F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_col))).alias("rank"), id_col, F.round("score", 4).alias("score"), F.substring("text", 1, chars).alias("snippet"),
        F.array_join(names, ",").alias("images"), F.size("image_paths").alias("n_images"),
    )


def rerank(candidates: DataFrame, second: Column, k: int, *, by: str, id_col: str) -> DataFrame:
    """Two stages: the given candidates of each query, scored again by ``second``, the k best kept."""
    again = candidates.withColumn("rerank_score", F.round(second, 6))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rerank_score"), F.asc(id_col)))
    return again.withColumn("rank", rank).where(F.col("rank") <= k)


class CoarseIndex:
    """Inverted lists by k-means cell. Fitted on at most ``sample`` rows (documented bound, chosen by id hash); every row is indexed."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, rows: DataFrame, *, id_col: str, vector: str, cells: int = 32, sample: int = 100_000, rounds: int = 15, seed: int = 7) -> "CoarseIndex":
        got = rows.select(F.col(id_col).alias("id"), as_double(F.col(vector)).alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        x = np.array([r.v for r in got], dtype=float)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            at = (x @ c.T).argmax(1)
            c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return cls(c)

    def nearest(self, vector: Column, n: int) -> Column:
        """The n nearest cells of a vector column, by inner product with the centroids; ties go to the smaller cell."""
        c = self.centroids

        @pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            near = np.round(np.stack(v.tolist()).astype(float) @ c.T, 9)
            return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return cells(vector)

    def place(self, rows: DataFrame, *, id_col: str, vector: str) -> DataFrame:
        """(id, v, cell) of every row."""
        return rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.element_at(self.nearest(F.col(vector), 1), 1).alias("cell"))

    def store(self, rows: DataFrame, path: str, *, id_col: str, vector: str) -> None:
        """Write the index: centroids, and every row under its cell, so a search reads the probed cells only. A cell is written in pieces of about ROWS_PER_PIECE rows."""
        spark = rows.sparkSession
        pieces = max(1, -(-rows.count() // (len(self.centroids) * ROWS_PER_PIECE)))
        self.place(rows, id_col=id_col, vector=vector).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(pieces))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cell INT, centroid ARRAY<DOUBLE>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> tuple["CoarseIndex", DataFrame]:
        """A written index and its rows (id, v, cell)."""
        centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # one row a cell
        return cls(np.array([r.centroid for r in centroids], dtype=float)), spark.read.parquet(f"{path}/rows")

    def search_one(self, placed: DataFrame, query: list[float], k: int, *, probes: int) -> DataFrame:
        """The k best of the probed cells for one query: other cells' files are not read."""
        cells = np.argsort(-np.round(self.centroids @ np.asarray(query, dtype=float), 9), kind="stable")[:probes]
        return top_k(placed.where(F.col("cell").isin(*map(int, cells))), query, k, vector="v")

    def search(self, placed: DataFrame, queries: DataFrame, k: int, *, probes: int) -> DataFrame:
        """(query_id, id, score, rank) of placed rows (see ``place``): exact scores within the probed cells; joined on the cell, not broadcast."""
        asked = queries.select("query_id", "query_vector", F.explode(self.nearest(F.col("query_vector"), probes)).alias("cell"))
        hits = asked.join(placed, "cell").where(F.col("id") != F.col("query_id")).select("query_id", "id", F.round(cosine(F.col("query_vector"), F.col("v")), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)
