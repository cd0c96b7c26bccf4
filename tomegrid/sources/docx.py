"""DOCX in, with the standard library only: relationships, members, HTML of paragraphs, runs, lists, tables and images."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomegrid.operators.markdown import to_markdown

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def relationships(data: bytes) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(id, type, target) of the main part's relationships, and the archive's members."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        part = "word/_rels/document.xml.rels"
        if part not in names:
            return [], names
        root = ElementTree.fromstring(z.read(part))
    return [(r.get("Id") or "", r.get("Type") or "", r.get("Target") or "") for r in root.iter(_REL + "Relationship")], names


def to_html(data: bytes) -> str:
    """HTML of the main part; images keep their relationship id as source."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    return "" if body is None else "".join(_blocks(body))


def _blocks(parent: ElementTree.Element) -> Iterator[str]:
    listed = False
    for node in parent:
        if node.tag == _W + "p":
            props = node.find(_W + "pPr")
            style = props.find(_W + "pStyle") if props is not None else None
            item = props is not None and props.find(_W + "numPr") is not None
            if item != listed:
                yield "<ul>" if item else "</ul>"
                listed = item
            name = (style.get(_W + "val") or "").lower() if style is not None else ""
            level = "".join(c for c in name if c.isdigit()) if "heading" in name else ""
            inner = "".join(_runs(node))
            tag = "li" if item else f"h{min(6, int(level))}" if level else "p"
            if inner:
                yield f"<{tag}>{inner}</{tag}>"
        elif node.tag == _W + "tbl":
            rows = []
            for r in node.iter(_W + "tr"):
                rows.append("<tr>" + "".join(f"<td>{'<br>'.join(''.join(_runs(p)) for p in c.iter(_W + 'p'))}</td>" for c in r.findall(_W + "tc")) + "</tr>")
            yield "<table>" + "".join(rows) + "</table>"
    if listed:
        yield "</ul>"


def _runs(p: ElementTree.Element) -> Iterator[str]:
    for r in p.iter(_W + "r"):
        props = r.find(_W + "rPr")
        bold = props is not None and props.find(_W + "b") is not None
        text = ""
        for x in r.iter():
            if x.tag == _W + "t":
                text += html.escape(x.text or "")
            elif x.tag == _W + "tab":
                text += " "
            elif x.tag == _W + "br":
                text += "<br>"
            elif x.tag == _A + "blip":
                text += f'<img alt="" src="{html.escape(x.get(_R + "embed") or "")}">'
        if text:
            yield f"<strong>{text}</strong>" if bold else text


def docx_relations(files: DataFrame) -> DataFrame:
    """(doc, r_id, rel_type, target, member) of binary files (path, content): relationships and, with null id, the members."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                rels, members = relationships(bytes(data))
                rows += [(path, *r, None) for r in rels] + [(path, None, None, None, m) for m in members]
            yield pd.DataFrame(rows, columns=["doc", "r_id", "rel_type", "target", "member"])

    return files.select("path", "content").mapInPandas(read, "doc STRING, r_id STRING, rel_type STRING, target STRING, member STRING")


def docx_images(files: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, img_name, data): bytes of the resolved images of binary files (path, content); names has doc, member, img_name."""
    wanted = names.groupBy(F.col("doc").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("img_name", "member"))).alias("wanted"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data, want in zip(b["path"], b["content"], b["wanted"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    rows += [(path, name, z.read(member)) for name, member in dict(want).items() if member in z.namelist()]
            yield pd.DataFrame(rows, columns=["doc", "img_name", "data"])

    return files.select("path", "content").join(wanted, "path").mapInPandas(take, "doc STRING, img_name STRING, data BINARY")


def docx_to_markdown(files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc, text): Markdown of binary files (path, content); images (doc, r_id, img_name) rewrite relationship sources."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    source = files.select("path", "content", stem.alias("stem"))
    if images is None:
        source = source.withColumn("names", F.create_map().cast("map<string,string>"))
    else:
        maps = images.groupBy(F.col("doc").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("r_id", "img_name"))).alias("names"))
        source = source.join(maps, "path", "left")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data, stem_, names in zip(b["path"], b["content"], b["stem"], b["names"]):
                page = to_html(bytes(data))
                for r_id, name in sorted(dict(names or {}).items(), key=lambda x: -len(x[0])):
                    page = page.replace(f'<img alt="" src="{r_id}">', f'<img alt="{name.rsplit(".", 1)[0]}" src="image_{stem_}/{name}">')
                out.append((path, to_markdown(page)))
            yield pd.DataFrame(out, columns=["doc", "text"])

    return source.mapInPandas(convert, "doc STRING, text STRING")


def build_docx(paragraphs: list[str]) -> bytes:
    """A minimal document: lines that start with # become headings. For round trips and tests."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    parts = []
    for p in paragraphs:
        n = len(p) - len(p.lstrip("#"))
        style = f'<w:pPr><w:pStyle w:val="Heading{n}"/></w:pPr>' if 0 < n <= 6 else ""
        parts.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{html.escape(p.lstrip("#").strip() if style else p)}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {ns}><w:body>{"".join(parts)}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>')
    return out.getvalue()
