"""Markdown to chunks that carry their place in the hierarchy of the document.

Two chunkers share the line rules: ``chunk_documents`` is declarative (windows over classified lines);
``chunk_documents_strict`` folds each document's lines in one pass inside a map over rows, without a shuffle, and keeps
every quirk of value comparison (repeated headings, late section headings).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomegrid.functions.strings import blank_to_null, strip, unify_newlines

LEVELS = ("Document", "Section", "Chapter", "Paragraph", "Clause")
#: Line patterns (fixed values).
DOCUMENT, SECTION = r"^###\s+(.+)$", r"^##\s+Раздел\s+(\d+)\s*(.*)$"
CHAPTER, PARAGRAPH = r"^#\s+Глава\s+(\d+\.\d+)\s*[-–:]\s*(.*)$", r"^#\s+(.+)$"
CLAUSE_BRACKET, CLAUSE_DOT = r"^\((\d+\.\d+\.\d+)\)\s+(.*)$", r"^(\d+\.\d+\.\d+)\.\s+(.*)$"
IMAGE_REF = r"!\[[^\]]*\]\(([^)]+)\)"


def doc_lines(docs: DataFrame, *, key: str = "file_name", text: str = "text") -> DataFrame:
    """(doc, pos, line) of every document, universal newlines."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(unify_newlines(F.col(text)), "\n")).alias("pos", "line"))


def _has(line: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(line, F.lit(w))
    return out


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds kind and the level values a line sets; content and orphan are told apart by the carried context."""
    line = strip(F.col("line"))
    like = lambda p: F.regexp_like(F.col("clean"), F.lit("(?U)" + p))
    got = lambda p, i: F.regexp_extract("clean", "(?U)" + p, i)
    kind = (
        F.when(F.col("clean") == "", "blank")
        .when(like(DOCUMENT), "document")
        .when(like(SECTION), "section")
        .when(like(CHAPTER) & ~_has(F.col("clean"), "Таблица", "Примечание"), "chapter")
        .when(like(PARAGRAPH) & ~_has(F.col("clean"), "Глава", "Таблица", "Примечание"), "paragraph")
        .when(like(CLAUSE_BRACKET) | like(CLAUSE_DOT), "clause")
        .otherwise("text")
    )
    titled = lambda head, title, sep: F.concat(head, F.when(title != "", F.concat(F.lit(sep), title)).otherwise(""))
    k = F.col("kind")
    return (
        lines.withColumn("clean", line)
        .withColumn("kind", kind)
        .withColumn("set_Document", F.when(k == "document", got(DOCUMENT, 1)))
        .withColumn("set_Section", F.when(k == "section", titled(F.concat(F.lit("Раздел "), got(SECTION, 1)), got(SECTION, 2), " ")))
        .withColumn("set_Chapter", F.when(k == "chapter", titled(F.concat(F.lit("Глава "), got(CHAPTER, 1)), got(CHAPTER, 2), " - ")))
        .withColumn("set_Paragraph", F.when(k == "paragraph", got(PARAGRAPH, 1)))
        .withColumn("set_Clause", F.when(k == "clause", F.coalesce(blank_to_null(got(CLAUSE_BRACKET, 1)), blank_to_null(got(CLAUSE_DOT, 1)))))
    )


def carry_forward(classified: DataFrame) -> DataFrame:
    """Level values in force at each line ('' where none): a heading resets the levels below it.

    A value holds while the count of headings above its level stays what it was, so one window order serves all levels.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    up = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("int")).over(order)
    epochs = classified.withColumn("e_Chapter", up("section")).withColumn("e_Paragraph", up("section", "chapter")).withColumn("e_Clause", up("section", "chapter", "paragraph"))

    def held(level: str, epoch: Column) -> Column:
        value = F.col("set_" + level)
        last = F.last(F.when(value.isNotNull(), F.struct(epoch.alias("epoch"), value.alias("value"))), ignorenulls=True).over(order)
        return F.coalesce(F.when(last.epoch == epoch, last.value), F.lit(""))

    out = epochs.withColumns({c: held(c, F.lit(0) if c in ("Document", "Section") else F.col("e_" + c)) for c in LEVELS})
    told = F.when(F.col("kind") != "text", F.col("kind")).when((F.col("Paragraph") != "") | (F.col("Clause") != ""), "content").otherwise("orphan")
    return out.withColumn("kind", told).select("doc", "pos", "clean", "kind", *LEVELS)


def chunk_documents(docs: DataFrame, *, key: str = "file_name", text: str = "text") -> DataFrame:
    """(doc, ordinal, levels, text): declarative chunks; one shuffle by document."""
    lines = carry_forward(classify_lines(doc_lines(docs, key=key, text=text)))
    order = Window.partitionBy("doc").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    record = ~F.col("kind").isin("blank", "orphan")
    seen = lambda c: F.last(F.when(record & (F.col(c) != ""), F.col(c)), ignorenulls=True).over(before)
    para = record & (F.col("Paragraph") != "") & ~F.col("Paragraph").eqNullSafe(seen("Paragraph"))
    chap = record & (F.col("Chapter") != "") & ~F.col("Chapter").eqNullSafe(seen("Chapter"))
    top = lines.withColumn("top", (para | chap).cast("int")).withColumn("run", F.sum("top").over(order))
    clause = F.last(F.when(F.col("Clause") != "", F.struct("run", "Clause")), ignorenulls=True).over(before)
    clause_before = F.when(clause.run == F.col("run"), clause.Clause)
    new_clause = record & (F.col("Clause") != "") & clause_before.isNotNull() & (F.col("Clause") != clause_before)
    numbered = top.withColumn("brk", ((F.col("top") == 1) | new_clause).cast("int")).withColumn("chunk", F.sum("brk").over(order))
    says = F.col("kind").isin("clause", "content")
    at = lambda c, when: F.max_by(c, F.when(when, F.col("pos")))
    parts = numbered.groupBy("doc", "chunk").agg(
        F.array_sort(F.collect_list(F.when(says | F.col("kind").isin("blank", "orphan"), F.struct("pos", F.when(says, F.col("clean")).otherwise("").alias("t"))))).alias("parts"),
        F.max(says).alias("says"),
        *(at(c, record & (F.col(c) != "")).alias(c) for c in ("Document", "Section")),
        *(at(c, says).alias(c) for c in ("Chapter", "Paragraph", "Clause")),
    )
    body = strip(F.array_join(F.transform("parts", lambda p: p.t), "\n"))
    kept = parts.where("says").select("doc", "chunk", *(F.coalesce(c, F.lit("")).alias(c) for c in LEVELS), body.alias("text"))
    return kept.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("chunk")).alias("ordinal"), *LEVELS, "text")


_RE = {n: re.compile(p) for n, p in (("document", DOCUMENT), ("section", SECTION), ("chapter", CHAPTER), ("paragraph", PARAGRAPH), ("bracket", CLAUSE_BRACKET), ("dot", CLAUSE_DOT))}


def _records(text: str) -> Iterator[tuple[dict[str, str], str, bool] | None]:
    """(levels in force, line, is heading) of each line, None for blank and orphan lines."""
    now = dict.fromkeys(LEVELS, "")

    def enter(level: str, value: str) -> None:
        now[level] = value
        if level != "Document":
            for lower in LEVELS[LEVELS.index(level) + 1 :]:
                now[lower] = ""

    for raw in text.split("\n"):
        line = raw.strip()
        barred = "Таблица" in line or "Примечание" in line
        if not line:
            yield None
        elif m := _RE["document"].match(line):
            enter("Document", m[1])
            yield dict(now), line, True
        elif m := _RE["section"].match(line):
            enter("Section", f"Раздел {m[1]}" + (f" {m[2]}" if m[2] else ""))
            yield dict(now), line, True
        elif not barred and (m := _RE["chapter"].match(line)):
            enter("Chapter", f"Глава {m[1]}" + (f" - {m[2]}" if m[2] else ""))
            yield dict(now), line, True
        elif not barred and "Глава" not in line and (m := _RE["paragraph"].match(line)):
            enter("Paragraph", m[1])
            yield dict(now), line, True
        elif m := _RE["bracket"].match(line) or _RE["dot"].match(line):
            enter("Clause", m[1])
            yield dict(now), line, False
        elif now["Paragraph"] or now["Clause"]:
            yield dict(now), line, False
        else:
            yield None


def fold_chunks(text: str, *, clause_only: bool = False) -> Iterator[tuple[dict[str, str], str]]:
    """(levels, text) of each chunk, in order."""
    held: dict[str, str] | None = None
    lines: list[str] = []
    said = False
    for r in _records(text):
        if r is None:
            if said:
                lines.append("")
            continue
        levels, line, heading = r
        new = {c: bool(levels[c]) and (held is None or held[c] != levels[c]) for c in ("Chapter", "Paragraph", "Clause")}
        if said and (new["Chapter"] or new["Paragraph"] or (new["Clause"] and held and held["Clause"])):
            yield dict(held), "\n".join(lines).strip()
            lines, said = [], False
        if held is None or any(new.values()):
            held = dict(levels)
        held |= {c: v for c, v in levels.items() if v}
        if not heading and (held["Clause"] or (held["Paragraph"] and not clause_only)):
            lines.append(line)
            said = True
    if said:
        yield dict(held), "\n".join(lines).strip()


def chunk_documents_strict(docs: DataFrame, *, key: str = "file_name", text: str = "text", clause_only: bool = False) -> DataFrame:
    """(doc, ordinal, levels, text) by the exact fold; a map over rows, so no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (d, n, *(m[c] for c in LEVELS), t)
                for d, s in zip(b["doc"], b["text"])
                for n, (m, t) in enumerate(fold_chunks(s.replace("\r\n", "\n").replace("\r", "\n"), clause_only=clause_only), 1)
            ]
            yield pd.DataFrame(rows, columns=["doc", "ordinal", *LEVELS, "text"])

    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return source.mapInPandas(fold, f"doc {kind}, ordinal INT, {', '.join(c + ' STRING' for c in LEVELS)}, text STRING")


def context_header(*levels: Column) -> Column:
    """``Document. Section. Chapter. Paragraph. Пункт N.`` of the non-empty levels; '' where there is none."""
    *upper, clause = levels
    joined = F.concat_ws(". ", *(blank_to_null(c) for c in upper), F.when(clause != "", F.concat(F.lit("Пункт "), clause)))
    return F.when(joined != "", F.concat(joined, F.lit("."))).otherwise("")


def with_flags(chunks: DataFrame) -> DataFrame:
    t = F.col("text")
    return chunks.withColumn("contains_tables", _has(t, "# Таблица", "|")).withColumn("contains_images", _has(t, "!["))


def chunk_id(source: Column, ordinal: Column, text: Column, clause: Column, paragraph: Column) -> Column:
    """Deterministic id of the published shape."""
    mark = F.substring(F.md5(F.concat_ws("\x01", source, ordinal.cast("string"), text)), 1, 8)
    return (
        F.when(clause != "", F.concat_ws("_", F.lit("pue"), clause, mark))
        .when(paragraph != "", F.concat_ws("_", F.lit("pue_para"), paragraph, mark))
        .otherwise(F.concat_ws("_", F.lit("pue_unknown"), mark))
    )


def chunk_objects(chunks: DataFrame, *, created: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks in their file form: id, metadata, content, created_at, and the carried columns."""
    levels = [F.col(c) for c in LEVELS]
    head = context_header(*levels)
    content = F.when(head != "", F.concat(head, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    meta = F.struct(*levels, "contains_tables", "contains_images", F.col("doc").alias("source_file"))
    stamp = created if created is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return with_flags(chunks).select(chunk_id(F.col("doc"), F.col("ordinal"), F.col("text"), F.col("Clause"), F.col("Paragraph")).alias("id"), meta.alias("metadata"), content.alias("content"), stamp.alias("created_at"), *carry)
