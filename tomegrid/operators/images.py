"""Image references: extraction, cleaning, resolution against a file catalog, names of extracted files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomegrid.functions.strings import base_name, strip

#: Reference patterns, case-insensitive (fixed values): Markdown, HTML, and any path with an image suffix.
MARKDOWN_REF = r"(?i)!\[[^\]]*\]\(([^)]+)\)"
HTML_REF = r"""(?i)<img[^>]+src=['"]([^'"]+)['"]"""
ANY_REF = r"(?i)([^\s\)\]]+\.(?:png|jpg|jpeg|gif|webp))"
ANY_SUFFIX = r"(?i)\.(?:png|jpg|jpeg|gif|webp)"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp")


def raw_refs(text: Column) -> Column:
    """Markdown then HTML references; any image-like path only where both find nothing.

    Each pattern is tried only on a text that holds its fixed part, so long runs without an image cost one scan.
    """
    none = F.array().cast("array<string>")
    all_of = lambda p, if_: F.when(if_, F.regexp_extract_all(text, F.lit(p), F.lit(1))).otherwise(none)
    named = F.concat(all_of(MARKDOWN_REF, F.contains(text, F.lit("!["))), all_of(HTML_REF, F.contains(F.lower(text), F.lit("<img"))))
    return F.when(F.size(named) > 0, named).otherwise(all_of(ANY_REF, F.regexp_like(text, F.lit(ANY_SUFFIX))))


def clean_ref(ref: Column) -> Column:
    """Without surrounding space, angle brackets, quotes, and whatever follows the first space (a title)."""
    bare = strip(F.regexp_replace(strip(ref), r"^[<>]+|[<>]+$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.regexp_extract(bare, r"(?U)^\s*(\S*)", 1)


def is_url(ref: Column) -> Column:
    return F.regexp_like(F.lower(ref), F.lit(r"^(https?://|data:)"))


def extract_refs(text: Column) -> Column:
    """Distinct clean local references, sorted."""
    cleaned = F.transform(raw_refs(F.coalesce(text, F.lit(""))), clean_ref)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda r: (r != "") & ~is_url(r))))


def markdown_image_refs(docs: DataFrame, *, key: str = "file_name", text: str = "text") -> DataFrame:
    """(doc, ref): distinct relative references of a Markdown file whose first path part starts with image_."""
    refs = docs.select(F.col(key).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(MARKDOWN_REF), F.lit(1))).alias("ref"))
    ref = strip(F.col("ref"))
    return refs.select("doc", ref.alias("ref")).where(~F.startswith("ref", F.lit("/")) & F.startswith("ref", F.lit("image_"))).distinct()


def copy_plan(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc, ref, exists): what a copy of the referenced files would do; missing ones are skipped."""
    files = catalog.where("is_file").select(F.col("path").alias("ref"), F.lit(True).alias("found")).distinct()
    return refs.join(files, "ref", "left").select("doc", "ref", F.coalesce("found", F.lit(False)).alias("exists"))


def candidate_paths(ref: Column, chapter: Column, *, base: str = "", root: str | None = None) -> Column:
    """Paths to try, best first; an absolute reference stands alone."""
    p = F.regexp_replace(ref, r"\\", "/")
    own = lambda b: [F.concat(F.lit(b), p), F.concat(F.lit(b + "image_"), chapter, F.lit("/"), p)]
    tries = own(base) + (own(root) if root is not None and root != base else [])
    return F.when(F.startswith(p, F.lit("/")), F.array(p)).otherwise(F.array(*tries))


def resolve(refs: DataFrame, catalog: DataFrame, *, keys: list[str], base: str = "", root: str | None = None) -> DataFrame:
    """(keys, image_paths): for every reference the first candidate that is a file, as a distinct sorted set.

    ``refs`` has the keys, ref and chapter. One equi-join on the path; the catalog side is not broadcast by force.
    """
    tried = refs.select(*keys, "ref", F.posexplode(candidate_paths(F.col("ref"), F.col("chapter"), base=base, root=root)).alias("priority", "path"))
    files = catalog.where("is_file").select("path").distinct()
    best = tried.join(files, "path").groupBy(*keys, "ref").agg(F.min_by("path", "priority").alias("path"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("image_paths"))


def image_relations(rels: DataFrame) -> DataFrame:
    """Relationships of images with an id and a target, without repeated rows."""
    kept = F.contains(F.lower("rel_type"), F.lit("image")) & (F.col("r_id") != "") & (F.col("target") != "")
    return rels.where(kept).select("doc", "r_id", "rel_type", "target", "member").distinct()


def member_candidates(target: Column) -> Column:
    """Archive members a relationship target may mean, best first."""
    t = target
    first = (
        F.when(F.startswith(t, F.lit("media/")), F.concat(F.lit("word/"), t))
        .when(F.startswith(t, F.lit("../media/")), F.concat(F.lit("word/"), F.substr(t, F.lit(4))))
        .when(F.contains(t, F.lit("/")), F.when(F.startswith(t, F.lit("word/")), t).otherwise(F.concat(F.lit("word/"), t)))
        .otherwise(F.concat(F.lit("word/media/"), t))
    )
    return F.array(first, F.concat(F.lit("word/media/"), base_name(t)), F.concat(F.lit("word/"), t), t)


def resolve_members(rels: DataFrame) -> DataFrame:
    """(doc, r_id, target, member): the archive member of each image relationship; unresolved ones are left out."""
    images = image_relations(rels).select("doc", "r_id", "target").distinct()
    members = rels.where(F.col("member").isNotNull()).select("doc", "member").distinct()
    tried = images.select("doc", "r_id", "target", F.posexplode(member_candidates(F.col("target"))).alias("priority", "member"))
    return tried.join(members, ["doc", "member"]).groupBy("doc", "r_id", "target").agg(F.min_by("member", "priority").alias("member"))


def image_names(resolved: DataFrame) -> DataFrame:
    """(doc, r_id, target, img_name): file names for extraction, none given twice in a document.

    No suffix gives imageNNN.png by the place in the document; a name that is taken gets the first of _1, _2, ... that is free. Order
    within a document is that of the relationship's number. One document's relationships are folded in one pass.
    """
    number = F.regexp_extract("r_id", r"(\d+)", 1).cast("int")
    listed = resolved.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "r_id", "target"))).alias("rels"))

    def free(taken: Column, name: Column) -> Column:
        split = lambda i: F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", i)
        other = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.concat(split(1), F.lit("_"), i.cast("string"), split(2)))
        return F.when(~F.array_contains(taken, name), name).otherwise(F.element_at(F.filter(other, lambda x: ~F.array_contains(taken, x)), 1))

    def give(names: Column, rel: Column) -> Column:
        base = base_name(rel.target)
        return F.concat(names, F.array(free(names, F.when(F.contains(base, F.lit(".")), base).otherwise(F.format_string("image%03d.png", F.size(names) + 1)))))

    named = listed.select("doc", "rels", F.aggregate("rels", F.array().cast("array<string>"), give).alias("names"))
    return named.select("doc", F.explode(F.arrays_zip("rels", "names")).alias("x")).select("doc", "x.rels.r_id", "x.rels.target", F.col("x.names").alias("img_name"))
