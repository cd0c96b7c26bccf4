"""Text transforms of the extract stage: tags, images and headings of HTML and Markdown."""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tomegrid.functions.strings import strip

#: An index mark: an ASCII letter after #, with its number groups, and the space around it (fixed pattern).
_TAG = r"(?U)\s*#[A-Za-z](?:[0-9]+(?:\s+[0-9]+)*)?\s*"


def clean_hidden_tags(text: Column) -> Column:
    """Drop index marks like ``#G0 12 3`` with the space around them, then fold long gaps to one blank line."""
    gone = F.regexp_replace(text, _TAG, "")
    return F.regexp_replace(gone, r"(?U)\s{3,}", "\n\n")


def clean_hidden_tags_paragraph(text: Column) -> Column:
    """The same inside one paragraph: remaining gaps become one space, ends are stripped."""
    gone = F.regexp_replace(text, _TAG, "")
    return strip(F.regexp_replace(gone, r"(?U)\s{2,}", " "))


def image_tags_to_markdown(text: Column) -> Column:
    """``<img>`` left in Markdown to ``![alt](src)``; empty, data: and web sources stay; alt defaults to the base name."""

    @pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        def one(m: re.Match) -> str:
            attrs = {k.lower(): v for k, _, v in re.findall(r"""([\w-]+)\s*=\s*(["'])(.*?)\2""", m.group(), re.S)}
            src = attrs.get("src", "").strip()
            if not src or src.lower().startswith(("data:", "http://", "https://")):
                return m.group()
            alt = attrs.get("alt", "").strip() or src.replace("\\", "/").rsplit("/", 1)[-1] or "image"
            return f"![{alt}]({src})"

        return s.map(lambda t: re.sub(r"<img\b[^>]*>", one, t, flags=re.I | re.S), na_action="ignore")

    return F.when(F.contains(F.lower(text), F.lit("<img")), convert(text)).otherwise(text)


def markdown_data_uris(text: Column, folder: Column) -> Column:
    """``![](data:image/...;base64,..)`` to ``![image](folder/img_<md5[:8]>.ext)``; equal bytes share a file; unreadable ones stay."""

    @pandas_udf("string")
    def convert(s: pd.Series, at: pd.Series) -> pd.Series:
        def text_of(t: str | None, d: str):
            def one(m: re.Match) -> str:
                try:
                    data = base64.b64decode(re.sub(r"\s+", "", m.group(2)), validate=True)
                except ValueError:
                    return m.group()
                ext = {"jpeg": "jpg", "svg+xml": "svg"}.get(m.group(1).lower(), m.group(1).lower())
                return f"![image]({d}/img_{hashlib.md5(data, usedforsecurity=False).hexdigest()[:8]}.{ext})"

            return None if t is None else re.sub(r"!\[\]\(data:image/([\w+.-]+);base64,([^)]*)\)", one, t)

        return pd.Series([text_of(t, d) for t, d in zip(s, at)], index=s.index)

    return F.when(F.contains(text, F.lit("](data:image/")), convert(text, folder)).otherwise(text)


def html_data_uris(pages: DataFrame, *, key: str, text: str) -> DataFrame:
    """Every base64 image of an HTML column: key, pos, img_name (collisions get _1, _2, ... per page), bytes (octets), md5."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r'(?i)<img\b[^>]*?src="data:image/([^"]+)"'), F.lit(1))).alias("pos", "uri"))
    data = F.unbase64(F.regexp_replace(F.regexp_extract("uri", r"(?s)^[^,]*,(.*)$", 1), r"\s+", ""))
    ext = F.lower(F.regexp_extract("uri", r"^([\w+.-]+)", 1))
    named = found.select(key, "pos", F.md5(data).alias("md5"), F.length(data).alias("bytes"), F.when(ext == "jpeg", "jpg").otherwise(ext).alias("ext"))
    stem = F.concat(F.lit("img_"), F.substring("md5", 1, 8))
    n = F.row_number().over(Window.partitionBy(key, F.substring("md5", 1, 8), "ext").orderBy("pos")) - 1
    return named.select(key, "pos", F.concat(stem, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit("."), "ext").alias("img_name"), "bytes", "md5")


def merge_split_headers(lines: DataFrame, *, key: str = "doc") -> DataFrame:
    """Lines (key, pos, line) with headings that run over several lines joined; the heading's position is kept.

    A heading takes the following lines until a blank line, a block start, or a line after one that ends in . ! ? ; or :.
    """
    line = strip(F.col("line"))
    is_head = F.regexp_like("line", F.lit(r"(?U)^#{1,6}\s+.+$"))
    block = F.regexp_like(line, F.lit(r"(?U)^(#{1,6}\s|[-*+]\s|\d+\.\s|```|[-*]{3,}$)")) | F.contains(line, F.lit("|"))
    marked = lines.select(key, "pos", "line", is_head.alias("head"), ((line == "") | block).alias("stops"), F.regexp_like(line, F.lit(r"[.!?;:]$")).alias("ended"), line.alias("clean"))
    order = Window.partitionBy(key).orderBy("pos")
    group = F.sum((F.col("head") | F.col("stops")).cast("int")).over(order)
    grouped = marked.withColumn("g", group)
    inside = Window.partitionBy(key, "g").orderBy("pos")
    shut = F.coalesce(F.max(F.col("ended").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    headed = F.first("head").over(inside)
    taken = grouped.withColumn("unit", F.when(headed & (shut == 0), F.min("pos").over(Window.partitionBy(key, "g"))).otherwise(F.col("pos"))).withColumn("joined", headed & (shut == 0))
    parts = taken.groupBy(key, "unit").agg(F.array_sort(F.collect_list(F.struct("pos", "clean"))).alias("parts"), F.first("line").alias("line"), F.max("joined").alias("joined"))
    return parts.select(key, F.col("unit").alias("pos"), F.when(F.col("joined"), F.regexp_replace(F.array_join(F.transform("parts", lambda p: p.clean), " "), r"(?U)^(#{1,6})\s+", "$1 ")).otherwise(F.col("line")).alias("line"))


class _ToMarkdown(HTMLParser):
    """HTML to Markdown with ATX headings; styles and scripts are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.href: list[str | None] = []
        self.skip = 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def _add(self, s: str) -> None:
        if not self.skip:
            (self.out if self.cell is None else self.cell).append(s)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("style", "script", "head", "title"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._add("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "nav", "footer", "section"):
            self._add("\n\n")
        elif tag == "br":
            self._add("<br>" if self.cell is not None else "\n")
        elif tag in ("b", "strong"):
            self._add("**")
        elif tag in ("i", "em"):
            self._add("*")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._add("\n")
        elif tag == "li":
            top = self.lists[-1] if self.lists else ["ul", 0]
            top[1] += 1
            self._add("\n" + "  " * (len(self.lists) - 1) + ("* " if top[0] == "ul" else f"{top[1]}. "))
        elif tag == "a":
            self.href.append(a.get("href"))
            self._add("[")
        elif tag == "img":
            self._add(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("style", "script", "head", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "article", "nav", "footer", "section"):
            self._add("\n\n")
        elif tag in ("b", "strong"):
            self._add("**")
        elif tag in ("i", "em"):
            self._add("*")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._add("\n")
        elif tag == "a" and self.href:
            self._add(f"]({self.href.pop() or ''})")
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows = self.rows, None
            self._add("\n\n" + pipe_table(rows) + "\n\n")

    def handle_data(self, data):
        self._add(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        joined = re.sub(r"[ \t]*\n[ \t]*(?=\S|\n|$)", "\n", "".join(self.out)) if not self.lists else "".join(self.out)
        return re.sub(r"\n{3,}", "\n\n", joined).strip()


def pipe_table(rows: list[list[str]]) -> str:
    """Markdown pipe table with a separator after the first row; line breaks in cells become <br>."""
    out = []
    for i, r in enumerate(rows):
        out.append("| " + " | ".join(c.replace("\n", "<br>") for c in r) + " |")
        if i == 0:
            out.append("|" + "---|" * len(r))
    return "\n".join(out)


def to_markdown(page: str) -> str:
    parser = _ToMarkdown()
    parser.feed(page)
    parser.close()
    return parser.text()


def html_to_markdown(page: Column) -> Column:
    @pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(to_markdown, na_action="ignore")

    return convert(page)


def html_pipeline(page: Column, folder: Column) -> Column:
    """HTML to clean Markdown: convert, lift embedded images, rewrite left-over image tags, drop hidden tags."""
    return clean_hidden_tags(image_tags_to_markdown(markdown_data_uris(html_to_markdown(page), folder)))


def escape(text: str) -> str:
    return html.escape(text, quote=True)
