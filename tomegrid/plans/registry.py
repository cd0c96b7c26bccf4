"""Queries of the core operators over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomegrid.functions import vectors
from tomegrid.functions.embedding import HashingEmbedder, embed_image, embed_text
from tomegrid.model import IMAGE_DIM
from tomegrid.operators import chunking, images, loading, markdown, rag, search
from tomegrid.session import shared_dir, ship_package, table, wide_table, write_shared
from tomegrid.sources import docx, files
from tomegrid.streaming.ingest import ingest_available

TEXT_DIM = 64
#: Ids of the vectors that play the text and image query in the single-query searches.
TEXT_QUERY, IMAGE_QUERY, K = 20, 40, 10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _md(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "md_files")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared one."""
    ship_package(spark)
    return f"{shared_dir(spark)}/tomegrid/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------------------


@query
def scan_glob_filter(spark, d):
    c = table(spark, d, "file_catalog")
    kept = F.lit(False)
    for s in images.IMAGE_SUFFIXES:
        kept = kept | files.matches(F.col("path"), s, recursive=True)
    return c.where("is_file").where(kept).select("path", (~F.contains("path", F.lit("/"))).alias("top_level"))


@query
def doc_lines(spark, d):
    return chunking.doc_lines(_md(spark, d))


@query
def jsonl_scan(spark, d):
    """Written as JSON Lines and read back through the tolerant schema."""
    c = table(spark, d, "chunked").select("id", "metadata", "content", "created_at")
    path = _folder(spark, "jsonl")
    files.write_chunks(c, path)
    return files.read_chunks(spark, path).select("id", loading.pick_text(F.col("text"), F.col("content")).alias("text"))


@query
def docx_rels(spark, d):
    return images.image_relations(table(spark, d, "docx_rels"))


@query
def docx_to_md(spark, d):
    """Every Markdown file as a DOCX archive, and back to Markdown."""

    def pack(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"path": b["file_name"], "content": [docx.build_docx([x for x in t.splitlines() if x.strip()]) for t in b["text"]]})

    got = _md(spark, d).where(F.col("text").isNotNull()).mapInPandas(pack, "path STRING, content BINARY")
    return docx.docx_to_markdown(got)


@query
def table_rows_to_md(spark, d):
    """A pipe table of each chapter's titles."""
    rows = table(spark, d, "toc").groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("title_id", "title"))).alias("rows"))
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(c, F.lit("\n"), F.lit("<br>")) for c in cells)), F.lit(" |"))
    body = F.array_join(F.transform("rows", lambda r: line(r.title_id.cast("string"), r.title)), "\n")
    return rows.select("chapter", F.concat_ws("\n", line(F.lit("N"), F.lit("Название")), F.lit("|---|---|"), body).alias("md"))


@query
def chunk_sink_roundtrip(spark, d):
    """Chunks as files and back: the name each file has, its chunks and characters."""
    path = _folder(spark, "sink")
    files.write_chunks(table(spark, d, "chunked"), path, ordinal=F.col("row_id"))
    back = files.read_chunks(spark, path).groupBy("file_name")
    return back.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))


@query
def markdown_tree(spark, d):
    """The Markdown files written below two folders under equal names, one of them odd, and scanned again to all depths."""
    path = _folder(spark, "tree")
    md = _md(spark, d).where(F.col("text").isNotNull() & (F.col("text") != ""))
    files.write_markdown(md.select(F.explode(F.array(F.lit("a/"), F.lit("b/c +d%/"))).alias("below"), "file_name", "text").select(F.concat("below", "file_name").alias("file_name"), "text"), path)
    return files.read_markdown(spark, path, recursive=True).select("file_name", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def scan_files(spark, d):
    """Files found by suffix, at the top only and to all depths."""
    path = _folder(spark, "scan")
    named = _md(spark, d).select(F.when(F.length("file_name") % 2 == 0, F.concat(F.lit("sub dir/"), "file_name")).otherwise(F.col("file_name")).alias("file_name"), F.lit("x").alias("text"))
    files.write_markdown(named, path)
    found = lambda deep: files.scan(spark, path, ".MD", recursive=deep).select(files.name_below(F.col("path"), files.root_of(spark, path)).alias("file_name"), F.lit(deep).alias("recursive"))
    return found(True).unionByName(found(False))


@query
def image_copy_plan(spark, d):
    return images.copy_plan(images.markdown_image_refs(_md(spark, d)), table(spark, d, "file_catalog"))


@query
def image_name_dedup(spark, d):
    return images.image_names(images.resolve_members(table(spark, d, "docx_rels")))


@query
def path_resolve_priority(spark, d):
    return images.resolve_members(table(spark, d, "docx_rels"))


# --- extract stage -----------------------------------------------------------------------------------------


def _html(spark, d):
    """HTML pages made of the Markdown files: a heading, then one paragraph a line, image links as tags."""
    text = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"!\[([^\]\n]*)\]\(([^)\n]*)\)", '<img src="$2" alt="$1">')
    return _md(spark, d).select("file_name", F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), "file_name", F.lit("</h1><p>"), F.replace(text, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p></body></html>")).alias("html"))


@query
def html_to_markdown(spark, d):
    return _html(spark, d).select("file_name", markdown.html_to_markdown(F.col("html")).alias("md"))


@query
def html_pipeline(spark, d):
    return _html(spark, d).select("file_name", markdown.html_pipeline(F.col("html"), F.lit("image_x")).alias("md"))


@query
def img_tag_to_md(spark, d):
    """Image links turned to tags and back: the files' own text, but for empty alts, which get the base name."""
    tags = F.regexp_replace("text", r"!\[([^\]\n]*)\]\(([^)\n]*)\)", '<img src="$2" alt="$1">')
    return _md(spark, d).select("file_name", markdown.image_tags_to_markdown(tags).alias("md"))


def _uri(c):
    return F.concat(F.lit("data:image/png;base64,"), F.base64(c.cast("binary")))


@query
def md_data_uri_extract(spark, d):
    t = table(spark, d, "toc").select("title_id", F.concat(F.lit("x ![]("), _uri(F.col("title")), F.lit(") y")).alias("md"))
    return t.select("title_id", markdown.markdown_data_uris(F.col("md"), F.lit("image_toc")).alias("md"))


@query
def data_uri_extract(spark, d):
    """Each chapter's titles as embedded images of one page, every third one twice; equal bytes get numbered names."""
    toc = table(spark, d, "toc")
    rows = toc.unionAll(toc.where("title_id % 3 = 0")).groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("title_id", "title"))).alias("rows"))
    page = rows.select("chapter", F.array_join(F.transform("rows", lambda r: F.concat(F.lit('<img src="'), _uri(r.title), F.lit('">'))), "").alias("html"))
    return markdown.html_data_uris(page, key="chapter", text="html")


def _marked(text):
    return F.regexp_replace(text, r"\. ", ". #G0 12 ")


@query
def clean_hidden_tags_md(spark, d):
    return _md(spark, d).select("file_name", markdown.clean_hidden_tags(_marked(F.col("text"))).alias("md"))


@query
def clean_hidden_tags_para(spark, d):
    return chunking.doc_lines(_md(spark, d)).select("doc", "pos", markdown.clean_hidden_tags_paragraph(_marked(F.col("line"))).alias("line"))


@query
def merge_split_headers(spark, d):
    return markdown.merge_split_headers(chunking.doc_lines(_md(spark, d)))


# --- chunk stage -------------------------------------------------------------------------------------------


@query
def classify_lines(spark, d):
    got = chunking.classify_lines(chunking.doc_lines(_md(spark, d)))
    return got.select("doc", "pos", "kind", *(F.coalesce("set_" + c, F.lit("")).alias("set_" + c.lower()) for c in chunking.LEVELS))


@query
def carry_forward_metadata(spark, d):
    got = chunking.carry_forward(chunking.classify_lines(chunking.doc_lines(_md(spark, d))))
    return got.select("doc", "pos", "kind", *(F.col(c).alias(c.lower()) for c in chunking.LEVELS))


def _lower(df):
    return df.select("doc", "ordinal", *(F.col(c).alias(c.lower()) for c in chunking.LEVELS), "text")


@query
def chunk_documents(spark, d):
    return _lower(chunking.chunk_documents(_md(spark, d)))


@query
def chunk_documents_strict(spark, d):
    return _lower(chunking.chunk_documents_strict(_md(spark, d)))


@query
def chunk_objects(spark, d):
    """Chunks in the form they are written in, the time of writing left out."""
    o = chunking.chunk_objects(chunking.chunk_documents_strict(_md(spark, d)), carry=("doc", "ordinal"))
    return o.select("doc", "ordinal", "id", "content", F.col("metadata.source_file").alias("source_file"), F.col("metadata.contains_tables").alias("contains_tables"), F.col("metadata.contains_images").alias("contains_images"), F.col("created_at").isNotNull().alias("stamped"))


@query
def context_header(spark, d):
    c = table(spark, d, "chunked").where(F.col("metadata").isNotNull())
    levels = [F.coalesce(F.col(f"metadata.{x}"), F.lit("")) for x in chunking.LEVELS]
    return c.select("row_id", chunking.context_header(*levels).alias("header"))


@query
def chunk_flags(spark, d):
    return chunking.with_flags(table(spark, d, "chunked").where(F.col("content").isNotNull()).select("row_id", F.col("content").alias("text"))).select("row_id", "contains_tables", "contains_images")


@query
def chunk_ids(spark, d):
    c = table(spark, d, "chunked").where(F.col("content").isNotNull())
    level = lambda n: F.coalesce(F.col(f"metadata.{n}"), F.lit(""))
    return c.select("row_id", chunking.chunk_id(F.coalesce("metadata.source_file", F.lit("")), F.col("row_id"), F.col("content"), level("Clause"), level("Paragraph")).alias("chunk_id"))


@query
def image_refs(spark, d):
    return images.markdown_image_refs(_md(spark, d))


# --- embed and load stage ----------------------------------------------------------------------------------


@query
def model_dim_lookup(spark, d):
    dims = table(spark, d, "model_dims")
    asked = dims.select("model_name").unionByName(dims.select(F.concat("model_name", F.lit("-next")).alias("model_name"))).distinct()
    return loading.dim_of(asked, dims, default=768)


@query
def chapter_from_filename(spark, d):
    names = table(spark, d, "chunked").select(F.col("metadata.source_file").alias("source_file")).where(F.col("source_file").isNotNull()).distinct()
    packed = names.select(F.regexp_replace("source_file", r"\.md$", ".chunked.jsonl").alias("source_file"))
    return names.unionByName(packed).select("source_file", loading.chapter_from_file(F.col("source_file")).alias("chapter"))


def _joined(c):
    return F.array_join(c, "\n")


@query
def extract_image_refs(spark, d):
    return wide_table(spark, d, "chunked").select("row_id", images.extract_refs(F.col("content")).alias("refs")).where(F.size("refs") > 0).select("row_id", _joined("refs").alias("refs"))


def _chapter(name):
    return loading.chapter_from_file(F.regexp_replace(name, r"-r\d+\.md$", ".md"))


def _resolved(spark, d):
    c = wide_table(spark, d, "chunked").select("row_id", _chapter(F.col("metadata.source_file")).alias("chapter"), F.explode(images.extract_refs(F.col("content"))).alias("ref"))
    return images.resolve(c, table(spark, d, "file_catalog"), keys=["row_id"])


@query
def chunk_image_paths(spark, d):
    return _resolved(spark, d).select("row_id", _joined("image_paths").alias("image_paths"))


@query
def merge_image_paths(spark, d):
    """References of the text with those another producer listed (here: every second one again, and a new one)."""
    refs = images.extract_refs(F.col("content"))
    given = F.when(F.pmod("row_id", F.lit(2)) == 0, F.concat(refs, F.array(F.lit("extra/z.png"))))
    return wide_table(spark, d, "chunked").select("row_id", _joined(loading.merge_image_paths(refs, given)).alias("image_paths"))


@query
def image_paths_json(spark, d):
    refs = images.extract_refs(F.col("content"))
    return wide_table(spark, d, "chunked").select("row_id", F.to_json(refs).alias("image_paths"), (F.size(refs) > 0).alias("has_image"))


@query
def embed_hashing(spark, d):
    docs = wide_table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", embed_text(F.col("text"), partial(HashingEmbedder, TEXT_DIM)).alias("v"))
    return docs.select("doc_id", F.posexplode("v").alias("pos", "value")).where(F.col("value") != 0).select("doc_id", "pos", F.round("value", 6).alias("value"))


@query
def embed_image_bytes(spark, d):
    """The pluggable image embedder's default over bytes of the titles; unreadable ones are zero."""
    t = table(spark, d, "toc").select("title_id", embed_image(F.col("title").cast("binary")).alias("v"))
    return t.select("title_id", F.size("v").alias("dim"), F.round(vectors.norm(F.col("v")), 4).alias("norm"))


@query
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(vectors.as_double(F.col("embedding")), lambda x: x * 3 * (F.col("vec_id") % 7)).alias("v"))
    n = vectors.l2_normalize(F.col("v"))
    return e.select("vec_id", F.posexplode(F.transform(n, lambda x: F.round(x, 6))).alias("pos", "value"))


@query
def vector_mean(spark, d):
    return loading.vector_mean(table(spark, d, "embeddings"), key="label", vector="embedding").select("label", "pos", F.round("value", 6).alias("value"))


def _prepared(spark, d):
    """Chunks ready to load: text, distinct references, file and chapter; ordinal by row id within the file."""
    c = wide_table(spark, d, "chunked")
    file = F.coalesce("metadata.source_file", F.lit(""))
    return c.select("row_id", file.alias("source_file"), F.col("id"), loading.pick_text(F.lit(None).cast("string"), F.col("content")).alias("text"), images.extract_refs(F.col("content")).alias("image_paths")).withColumn("chapter", loading.chapter_from_file(F.col("source_file")))


@query
def load_chunks(spark, d):
    """The stored collection, written partitioned by chapter and read back; of the vectors, their sizes and the text vector's components."""
    p = _prepared(spark, d).withColumn("chunk_id", loading.pick_chunk_id(F.lit(None).cast("string"), F.col("id"), F.col("chapter"), F.col("row_id"))).withColumnRenamed("row_id", "ordinal")
    rows = loading.collection_rows(loading.clustered(p, within="ordinal"), embed_text(F.col("text"), partial(HashingEmbedder, TEXT_DIM)), F.array_repeat(F.lit(0.0), IMAGE_DIM))
    path = write_shared(rows, "collection", partition_by=["chapter"])
    back = spark.read.schema(rows.schema).parquet(path)
    parts = F.transform("text_vector", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), F.round(x.cast("double") * 1000).cast("bigint").cast("string"))))
    return back.select(
        "chunk_id", "text", _joined("image_paths").alias("image_paths"), "source_file", F.coalesce("chapter", F.lit("")).alias("chapter"), "has_image",
        F.size("image_vector").alias("image_dim"), F.size(F.array_compact(parts)).alias("components"), F.size("text_vector").alias("text_dim"),
    )


@query
def load_summary(spark, d):
    return loading.load_summary(_prepared(spark, d))


@query
def skip_existing_anti(spark, d):
    """Chunks of which no row of the first half of the ids is stored under the same id."""
    c = table(spark, d, "chunked").select("row_id", F.col("id").alias("chunk_id"))
    return loading.skip_existing(c, c.where(F.pmod("row_id", F.lit(2)) == 0)).select("row_id", "chunk_id")


# --- search ------------------------------------------------------------------------------------------------


def _rows(spark, d):
    """Vectors as a collection: label as chapter, a second modality that a fifth of the rows lacks."""
    e = table(spark, d, "embeddings")
    has = F.pmod("vec_id", F.lit(5)) != 0
    image = F.when(has, F.reverse(vectors.as_double(F.col("embedding")))).otherwise(F.array_repeat(F.lit(0.0), TEXT_DIM))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_vector"), image.alias("image_vector"), F.col("label").alias("chapter"), has.alias("has_image"))


def _text_hits(spark, d, k=K, where=None):
    r = _rows(spark, d)
    return search.top_k(r, search.one_vector(r, id_col="id", id_value=TEXT_QUERY, vector="text_vector"), k, vector="text_vector", where=where)


def _image_hits(spark, d, k=K, where=None):
    r = _rows(spark, d)
    return search.top_k(r, search.one_vector(r, id_col="id", id_value=IMAGE_QUERY + 1, vector="image_vector"), k, vector="image_vector", where=where)


@query
def topk_cosine(spark, d):
    """Every id divisible by 20 asks all rows."""
    e = table(spark, d, "embeddings")
    asked = e.where(F.pmod("vec_id", F.lit(20)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.top_k_batch(e, asked, K, id_col="vec_id", vector="embedding")


@query
def topk_single(spark, d):
    return _text_hits(spark, d).select("id", "score")


@query
def topk_filter_eq(spark, d):
    return _text_hits(spark, d, where=search.chapter_is(3)).select("id", "score", "chapter")


@query
def topk_filter_and(spark, d):
    return _text_hits(spark, d, where=search.both(search.chapter_is(3), F.col("has_image"))).select("id", "score", "chapter")


@query
def topk_image_zero(spark, d):
    """No has_image filter: zero vectors are candidates with score 0."""
    return _image_hits(spark, d, k=K).select("id", "score", "has_image")


@query
def hit_format(spark, d):
    h = _text_hits(spark, d).select("id", "score", F.when(F.pmod("id", F.lit(2)) == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.when(F.col("has_image"), F.to_json(F.array(F.concat(F.lit("p"), F.col("id").cast("string"))))).alias("image_paths"))
    return search.hit_format(h, "text").select("id", "score", "text", F.size("image_paths").alias("n_images"), _joined("image_paths").alias("image_paths"), "search_type")


@query
def backfill_text_join(spark, d):
    """Hits come without text; the documents of the same ids have it."""
    h = _text_hits(spark, d).select("id", "score", F.lit("").alias("text"))
    return search.backfill_text(h, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "score", "text")


@query
def hybrid_fusion(spark, d):
    return search.hybrid(_text_hits(spark, d, 2 * K).select("id", "score"), _image_hits(spark, d, 2 * K).select("id", "score"), K)


@query
def hybrid_text_only(spark, d):
    return _text_hits(spark, d, 2 * K).select("id", "score").orderBy(F.desc("score"), F.asc("id")).limit(K)


@query
def collection_stats(spark, d):
    return loading.stats(_rows(spark, d), "chunks", ["text_vector", "image_vector"])


@query
def parse_meta(spark, d):
    m = table(spark, d, "model_dims")
    good = F.concat(F.lit("About. text_model="), "model_name", F.lit(", text_dim="), F.col("text_dim").cast("string"))
    all_ = m.select("model_name", F.explode(F.array(good, F.lit(""), F.concat(F.lit("text_model="), "model_name"))).alias("description"))
    got = loading.parse_meta(F.col("description"))
    return all_.select("description", got.text_model.alias("text_model"), got.text_dim.alias("text_dim"))


@query
def meta_mismatch(spark, d):
    """The model a session would use for each collection: the collection's own, else the default; and whether they differ."""
    m = table(spark, d, "model_dims")
    got = loading.parse_meta(F.when(F.col("text_dim") != 768, F.concat(F.lit("text_model="), "model_name", F.lit(",text_dim="), F.col("text_dim").cast("string"))).otherwise(""))
    own = m.select("model_name", F.coalesce(got.text_model, F.lit("default")).alias("used"), F.coalesce(got.text_dim, F.lit(384)).alias("dim"))
    return own.withColumn("mismatch", (F.col("used") != "default") & (F.col("dim") != 384))


@query
def hit_snippets(spark, d):
    h = _text_hits(spark, d).select("id", "score", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.array(F.lit("a/x.png"), F.concat(F.lit("b/"), F.col("id").cast("string"), F.lit(".png")), F.lit("c\\z.png"), F.lit("w.png")).alias("image_paths"))
    return search.snippets(h, chars=6)


def _ann(spark, d):
    """(all vectors, every id divisible by 20 as a query, the stored index, its rows)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.where(F.pmod("id", F.lit(20)) == 0).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    path = _folder(spark, "index")
    search.CoarseIndex.fit(e, id_col="id", vector="v", cells=16).store(e, path, id_col="id", vector="v")
    return e, asked, *search.CoarseIndex.stored(spark, path)


@query
def ann_ivf_hits(spark, d):
    """The ten best of the probed cells of a stored index."""
    _, asked, index, placed = _ann(spark, d)
    return index.search(placed, asked, K, probes=12)


@query
def ann_ivf_recall(spark, d):
    """Recall at 10 of the coarse index against the exact search, for every id divisible by 20."""
    e, asked, index, placed = _ann(spark, d)
    near = index.search(placed, asked, K, probes=12).select("query_id", "id", F.lit(1).alias("hit"))
    exact = search.top_k_batch(e, asked, K, id_col="id", vector="v").select("query_id", "id")
    return exact.join(near, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


@query
def rerank_two_stage(spark, d):
    """The twenty best by text, the five best of them by the second modality."""
    r = _rows(spark, d)
    asked = r.where(F.pmod("id", F.lit(20)) == 0).select(F.col("id").alias("query_id"), F.col("text_vector").alias("query_vector"))
    first = search.top_k_batch(r, asked, 20, id_col="id", vector="text_vector").drop("rank", "score")
    mine, theirs = r.select("id", F.col("image_vector").alias("own")), r.select(F.col("id").alias("query_id"), F.col("image_vector").alias("other"))
    pairs = first.join(mine, "id").join(theirs, "query_id")
    return search.rerank(pairs, vectors.cosine(F.col("own"), F.col("other")), 5, by="query_id", id_col="id").select("query_id", "id", "rerank_score", "rank")


# --- planned operators -------------------------------------------------------------------------------------


@query
def rag_prompt(spark, d):
    """For each exam item, the three shortest clauses of its chapter as context."""
    items = table(spark, d, "exam_items").select(F.col("item_id").alias("query_id"), "chapter", F.col("text").alias("question"))
    c = table(spark, d, "chunked").where(F.col("content").isNotNull() & F.col("metadata.Clause").isNotNull() & (F.col("metadata.Clause") != ""))
    c = c.select(F.col("metadata.Clause").alias("clause"), F.regexp_extract("metadata.Clause", r"^(\d+\.\d+)\.", 1).alias("chapter"), F.col("content").alias("text"), "row_id")
    best = c.withColumn("rank", F.row_number().over(Window.partitionBy("chapter").orderBy(F.length("text"), "row_id"))).where("rank <= 3")
    return rag.prompts(items.select("query_id", "chapter").join(best, "chapter"), items)


@query
def status_label(spark, d):
    c = wide_table(spark, d, "chunked").where(F.col("content").isNotNull())
    return c.select("row_id", F.coalesce(rag.status_label(F.col("content")), F.lit("none")).alias("status"))


@query
def dialog_context(spark, d):
    return rag.dialog_context(table(spark, d, "events"), 3, user="user_id", at="ts", turn="event_id", text="event_type")


@query
def embed_prefix(spark, d):
    m = table(spark, d, "model_dims").select(F.regexp_replace("model_name", "enc-mid", "e5-mid").alias("model_name"))
    return m.select("model_name", rag.prefixed(F.col("model_name"), F.lit("x"), query=True).alias("asked"), rag.prefixed(F.col("model_name"), F.lit("x"), query=False).alias("told"))


@query
def stream_ingest(spark, d):
    """Incremental ingest of the Markdown files by a file stream that runs to the end of what is there."""
    ship_package(spark)
    path = f"{shared_dir(spark)}/tomegrid/stream-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    source = write_shared(table(spark, d, "md_files"), "stream-source")
    return _lower(ingest_available(spark, source, f"{path}-{source[-8:]}/out", f"{path}-{source[-8:]}/checkpoint"))


def flagship(spark, d):
    """Markdown to chunks to vectors, then the best clauses for a question, with a filter on the status."""
    chunks = chunking.chunk_objects(chunking.chunk_documents_strict(_md(spark, d)), created=F.lit(None).cast("string"))
    rows = chunks.select(F.xxhash64("id").alias("id"), F.col("id").alias("chunk_id"), "content", F.col("metadata.source_file").alias("source_file"), rag.status_label(F.col("content")).alias("status"), embed_text(F.col("content"), partial(HashingEmbedder, TEXT_DIM)).alias("v"))
    asked = HashingEmbedder(TEXT_DIM).encode(["заземление и защитные меры"])[0].tolist()
    hits = search.top_k(rows, asked, 5, vector="v", where=F.col("status") == "mandatory")
    return hits.select("chunk_id", "source_file", "status", "score", F.substring("content", 1, 200).alias("snippet"))
