"""Behaviour of the document pipeline on synthetic documents, one per rule."""

from __future__ import annotations

import base64
import hashlib
import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomegrid.functions import vectors
from tomegrid.functions.embedding import HashingEmbedder, embed_image, embed_text
from tomegrid.operators import chunking, images, loading, markdown, rag, search
from tomegrid.sources import docx, files
from tomegrid.streaming.ingest import ingest_available


def md(spark, **docs):
    return spark.createDataFrame([(k, v) for k, v in docs.items()], "file_name STRING, text STRING")


def strict(text):
    return [(m["Section"], m["Chapter"], m["Paragraph"], m["Clause"], t) for m, t in chunking.fold_chunks(text)]


def test_preamble_joins_the_first_clause():
    assert strict("# Общие\nвступление\n1.1.1. первый\n1.1.2. второй") == [("", "", "Общие", "1.1.1", "вступление\n1.1.1. первый"), ("", "", "Общие", "1.1.2", "1.1.2. второй")]


def test_late_section_relabels_the_pending_chunk():
    assert strict("## Раздел 1 A\n# П\n1.1.1. текст\n## Раздел 2 B\n# Ю\nещё")[0][0] == "Раздел 2 B"


def test_chapter_needs_a_separator():
    assert strict("# П\n# Глава 9.9\nтекст") == [("", "", "П", "", "# Глава 9.9\nтекст")]
    assert strict("# Глава 9.9 - Т\n# П\nтекст")[0][1] == "Глава 9.9 - Т"


def test_lone_mark_tables_and_notes_are_content():
    assert strict("#\n# П\n#\n# Таблица 1\n# Примечание")[0][4] == "#\n# Таблица 1\n# Примечание"


def test_repeats_do_not_split():
    assert len(strict("# П\nа\n# П\nб\n1.1.1. в\n1.1.1. г")) == 1


def test_clause_forms_and_orphans():
    assert [c[3] for c in strict("(1.2.3) а\n1.2.4. б\n1.2.5 в")] == ["1.2.3", "1.2.4"]
    assert strict("сирота\n\n") == [] and strict("# Только\n# Заголовки") == []
    assert strict("# П\nа\n## Раздел 2\nсирота\n# П\nб")[0][4] == "а\n\nб"


def test_clause_only_mode():
    assert [t for _, t in chunking.fold_chunks("# П\nвступление\n1.1.1. а", clause_only=True)] == ["1.1.1. а"]


def test_crlf_nbsp_empty_and_null(spark):
    docs = md(spark, a="# П\r\n текст \r\n", b="", c=None)
    for f in (chunking.chunk_documents, chunking.chunk_documents_strict):
        assert [(r.doc, r.text) for r in f(docs).collect()] == [("a", "текст")]
    assert chunking.chunk_documents(docs.limit(0)).collect() == []


LINES = st.lists(st.sampled_from(["", "текст", "ещё слова", "(1.1.{n}) пункт", "1.2.{n}. пункт", "# Параграф {n}", "#", "# Таблица {n}", "хвост |"]), min_size=1, max_size=25)


@settings(max_examples=25, deadline=None)
@given(LINES)
def test_declarative_equals_strict(spark, lines):
    """On documents whose headings and clause numbers don't repeat."""
    text = "\n".join(x.replace("{n}", str(i)) for i, x in enumerate(lines))
    docs = md(spark, d=text)
    key = lambda r: (r.ordinal, r.Document, r.Section, r.Chapter, r.Paragraph, r.Clause, r.text)
    assert sorted(map(key, chunking.chunk_documents(docs).collect())) == sorted(map(key, chunking.chunk_documents_strict(docs).collect()))


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} STRING" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("foo #G0 bar", "foobar"), ("#M12 34 56\nтекст", "текст"), ("#1 остаётся", "#1 остаётся"), ("а   \n\n б", "а\n\nб")])
def test_hidden_tags(spark, raw, clean):
    assert one(spark, markdown.clean_hidden_tags(F.col("t")), t=raw) == clean


def test_image_tags(spark):
    cases = {'<img src="a/b.png">': "![b.png](a/b.png)", "<IMG alt='x' src='b.gif'/>": "![x](b.gif)", '<img src="http://a/b.png">': '<img src="http://a/b.png">', '<img src="data:x">': '<img src="data:x">', "<img>": "<img>"}
    for raw, want in cases.items():
        assert one(spark, markdown.image_tags_to_markdown(F.col("t")), t=raw) == want


def test_data_uris(spark):
    data = b"picture"
    uri, name = base64.b64encode(data).decode(), hashlib.md5(data).hexdigest()[:8]
    got = one(spark, markdown.markdown_data_uris(F.col("t"), F.lit("d")), t=f"![](data:image/jpeg;base64,{uri}) ![](data:image/png;base64,%%) ![alt](data:image/png;base64,{uri})")
    assert got.startswith(f"![image](d/img_{name}.jpg) ![](data:image/png;base64,%%)") and got.endswith(f"![alt](data:image/png;base64,{uri})")
    page = spark.createDataFrame([("p", f'<img src="data:image/png;base64,{uri}">' * 3)], "k STRING, html STRING")
    assert [r.img_name for r in markdown.html_data_uris(page, key="k", text="html").orderBy("pos").collect()] == [f"img_{name}.png", f"img_{name}_1.png", f"img_{name}_2.png"]


def test_html():
    page = "<html><head><title>t</title><style>x</style></head><body><h2>Го<b>лова</b></h2><p>а &amp; б<br>в</p><ul><li>раз</li><li>два</li></ul><table><tr><td>1</td><td>2<br>3</td></tr><tr><td>4</td><td>5</td></tr></table><a href='u'>с</a></body></html>"
    got = markdown.to_markdown(page)
    for part in ("## Го**лова**", "а & б", "* раз", "| 1 | 2<br>3 |\n|---|---|\n| 4 | 5 |", "[с](u)"):
        assert part in got
    assert "x" not in got.split("##")[0]


def test_merge_headers(spark):
    text = "# Длинный\nзаголовок\nв три строки\n\nтекст\n# Конец.\nне сюда\n# А\n- список\n# Б;"
    lines = chunking.doc_lines(md(spark, d=text))
    got = [r.line for r in markdown.merge_split_headers(lines).orderBy("pos").collect()]
    assert got == ["# Длинный заголовок в три строки", "", "текст", "# Конец.", "не сюда", "# А", "- список", "# Б;"]


def test_image_references(spark):
    text = '![a](image_1/x.png "title") <img src=\'y.gif\'> ![u](http://h/z.png) ![d](data:image/png;base64,aa) ![n](<image_1/w.png>) ![n](<image_1/w.png>)'
    assert one(spark, images.extract_refs(F.col("t")), t=text) == ["image_1/w.png", "image_1/x.png", "y.gif"]
    assert one(spark, images.extract_refs(F.col("t")), t="см. файл pic.PNG здесь") == ["pic.PNG"]
    assert one(spark, images.extract_refs(F.col("t")), t=None) == []
    catalog = spark.createDataFrame([("image_3.1/x.png", True), ("b/x.png", True), ("y.png", False)], "path STRING, is_file BOOLEAN")
    refs = spark.createDataFrame([(1, "x.png", "3.1"), (1, "y.png", "3.1"), (2, "b\\x.png", "3.1")], "row_id BIGINT, ref STRING, chapter STRING")
    assert sorted((r.row_id, r.image_paths) for r in images.resolve(refs, catalog, keys=["row_id"]).collect()) == [(1, ["image_3.1/x.png"]), (2, ["b/x.png"])]


def test_relationships(spark):
    rels = [("d", "rId1", "t/image", "media/a.png", "word/media/a.png"), ("d", "rId2", "t/Image", "../media/a.png", "word/media/b"), ("d", "rId3", "t/image", "b", None), ("d", "rId4", "t/style", "media/c.png", None), ("d", "rId5", "t/image", "", None), ("d", "rId6", "t/image", "x/none.png", None)]
    got = images.image_names(images.resolve_members(spark.createDataFrame(rels, "doc STRING, r_id STRING, rel_type STRING, target STRING, member STRING")))
    assert sorted((r.r_id, r.img_name) for r in got.collect()) == [("rId1", "a.png"), ("rId2", "a_1.png"), ("rId3", "image003.png")]


def test_docx(spark):
    data = docx.build_docx(["# Заголовок", "текст & знак"])
    f = spark.createDataFrame([("f.docx", bytearray(data))], "path STRING, content BINARY")
    assert docx.docx_to_markdown(f).first().text == "# Заголовок\n\nтекст & знак"
    assert {r.member for r in docx.docx_relations(f).collect()} == {"word/document.xml", "word/_rels/document.xml.rels"}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("# П\r\nтекст".encode())
    (tmp_path / "sub" / "B.MD").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    assert [r.text for r in files.read_markdown(spark, str(tmp_path)).collect()] == ["# П\nтекст"]
    assert files.scan(spark, str(tmp_path), ".md", recursive=True).count() == 2
    out = tmp_path / "j"
    out.mkdir()
    (out / "x.jsonl").write_text('{"id": "1", "content": "щит"}\n\n{"chunk_id": "2", "text": "t", "metadata": {"image_paths": ["a"]}}\n')
    assert {(r.id, r.chunk_id, r.text, r.content) for r in files.read_chunks(spark, str(out)).collect()} == {("1", None, None, "щит"), (None, "2", "t", None)}
    (out / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        files.read_chunks(spark, str(out)).collect()


def test_stream_ingests_each_file_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    md(spark, a="# П\nраз").write.parquet(source)
    assert ingest_available(spark, source, target, check).count() == 1
    md(spark, b="# П\nдва").write.mode("append").parquet(source)
    assert sorted(r.text for r in ingest_available(spark, source, target, check).collect()) == ["два", "раз"]


def test_ids_headers_dims_meta(spark):
    s = spark.createDataFrame([("", "", "", "Общие", "1.1.1")], "d STRING, s STRING, c STRING, p STRING, l STRING")
    assert s.select(chunking.context_header(*(F.col(x) for x in "dscpl"))).first()[0] == "Общие. Пункт 1.1.1."
    asked = spark.createDataFrame([("a",), ("b",), (None,)], "model_name STRING")
    dims = spark.createDataFrame([("a", 768)], "model_name STRING, text_dim INT")
    assert {r.model_name: r.text_dim for r in loading.dim_of(asked, dims).collect()} == {"a": 768, "b": 384, None: 384}
    got = loading.parse_meta(F.col("t"))
    assert one(spark, got, t=loading.describe("m", 7)) == ("m", 7) and one(spark, got, t="") is None and one(spark, got, t=None) is None
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert loading.warn_on_mismatch(("a", 1), ("b", 1)) and len(w) == 1 and not loading.warn_on_mismatch(("a", 1), None)


def rows(spark, *vs):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)], "id BIGINT, v ARRAY<DOUBLE>")


def test_search_edges(spark):
    r = rows(spark, (1, 0), (0, 0), (2, 0), (0, 1))
    got = [(x.id, x.score) for x in search.top_k(r, [1.0, 0.0], 10, vector="v").collect()]
    assert got == [(0, 1.0), (2, 1.0), (1, 0.0), (3, 0.0)]
    assert search.top_k(r, [0.0, 0.0], 2, vector="v").select("score").distinct().first()[0] == 0.0
    assert search.top_k(r, [1.0, 0.0], 3, vector="v", where=F.col("id") > 99).collect() == []
    assert search.chapter_is("") is None and search.both(None, None) is None
    asked = r.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    a = sorted(map(tuple, search.top_k_batch(r, asked, 2, id_col="id", vector="v").collect()))
    assert a == sorted(map(tuple, search.top_k_batch(r, asked, 2, id_col="id", vector="v", block=2).collect()))
    assert search.top_k_batch(r, asked.limit(0), 2, id_col="id", vector="v").collect() == []


@pytest.mark.parametrize(("w", "first"), [(1.0, 0), (0.0, 3)])
def test_fusion_weights(spark, w, first):
    t, i = spark.createDataFrame([(0, 0.9), (1, 0.5)], "id BIGINT, score DOUBLE"), spark.createDataFrame([(3, 0.8), (1, 0.4)], "id BIGINT, score DOUBLE")
    out = search.hybrid(t, i, 3, text_weight=w, image_weight=1 - w).collect()
    assert out[0].id == first and {x.id: x.score for x in out}[1] == 0.5


def test_coarse_index_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    r = rows(spark, *x)
    asked = r.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    index = search.CoarseIndex.fit(r, id_col="id", vector="v", cells=8)
    near = {(a.query_id, a.id) for a in index.search(index.place(r, id_col="id", vector="v"), asked, 5, probes=5).collect()}
    exact = {(a.query_id, a.id) for a in search.top_k_batch(r, asked, 5, id_col="id", vector="v").collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_stored_index_reads_probed_cells_only(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(200, 8))
    r = rows(spark, *x)
    search.CoarseIndex.fit(r, id_col="id", vector="v", cells=6).store(r, str(tmp_path), id_col="id", vector="v")
    index, placed = search.CoarseIndex.stored(spark, str(tmp_path))
    assert placed.count() == 200
    everything = search.top_k(r, x[0].tolist(), 5, vector="v").collect()
    assert [a.id for a in index.search_one(placed, x[0].tolist(), 5, probes=6).collect()] == [a.id for a in everything]
    one = index.search_one(placed, x[0].tolist(), 5, probes=1)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().executedPlan().toString() and one.first().id == 0


def test_embedders(spark):
    df = spark.createDataFrame([("щит на опоре",), ("",), (None,)], "t STRING")
    v = [r[0] for r in df.select(embed_text(F.col("t"), HashingEmbedder)).collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-9 and not any(v[1]) and not any(v[2])
    b = spark.createDataFrame([(bytearray(b"x"),), (None,)], "b BINARY")
    n = [r[0] for r in b.select(vectors.norm(embed_image(F.col("b"), dim=16))).collect()]
    assert abs(n[0] - 1) < 1e-5 and n[1] == 0
    prefixed = spark.createDataFrame([("E5-base",), ("bge-m",), ("x",)], "m STRING").select(rag.prefixed(F.col("m"), F.lit("t"), query=True)).collect()
    assert [r[0][:5] for r in prefixed] == ["query", "Repre", "t"]


def test_stored_text_limit(spark):
    c = spark.createDataFrame([("c", "я" * 40_000, [], "f", "1", 1)], "chunk_id STRING, text STRING, image_paths ARRAY<STRING>, source_file STRING, chapter STRING, ordinal BIGINT")
    with pytest.raises(Exception, match="stored limit"):
        loading.collection_rows(c, F.array(F.lit(0.0)), F.array(F.lit(0.0))).collect()


def test_recursive_names_stay_apart(spark, tmp_path):
    """Equal base names in several folders, with blanks and signs, are documents of their own under decoded relative names."""
    for below in ("a", "b +c%20"):
        (tmp_path / "in" / below).mkdir(parents=True)
        (tmp_path / "in" / below / "x y.md").write_text(f"# П {below}\n(1.1.1) Щит {below}.\n")
    got = files.read_markdown(spark, f"file://{tmp_path}/in", recursive=True)
    assert {r.file_name for r in got.collect()} == {"a/x y.md", "b +c%20/x y.md"}
    cut = chunking.chunk_documents_strict(got)
    assert cut.count() == 2
    assert files.write_chunks(chunking.chunk_objects(cut), str(tmp_path / "out")) == 2
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a/x y.chunked.jsonl", "b +c%20/x y.chunked.jsonl"]
    assert {r.file_name for r in files.read_chunks(spark, str(tmp_path / "out")).collect()} == {"a/x y.chunked.jsonl", "b +c%20/x y.chunked.jsonl"}


def test_long_chunk_files_go_on_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_FILE", 4)
    c = spark.range(10).select(F.col("id").cast("string").alias("id"), F.struct(*(F.lit(None).cast("string").alias(n) for n in ("Document", "Section", "Chapter", "Paragraph", "Clause")), F.lit(True).alias("contains_tables"), F.lit(False).alias("contains_images"), F.lit("s/a.md").alias("source_file")).alias("metadata"), F.lit("т").alias("content"), F.lit(None).cast("string").alias("created_at"), F.col("id").alias("n"))
    assert files.write_chunks(c, str(tmp_path / "x"), ordinal=F.col("n")) == 3
    assert [len((tmp_path / "x" / "s" / f).read_text().splitlines()) for f in ("a.chunked.jsonl", "a.part1.chunked.jsonl", "a.part2.chunked.jsonl")] == [4, 4, 2]
    assert '"id":"0"' in (tmp_path / "x" / "s" / "a.chunked.jsonl").read_text().splitlines()[0]
    assert {(r.file_name, r.id) for r in files.read_chunks(spark, str(tmp_path / "x")).collect()} == {("s/a.chunked.jsonl", str(i)) for i in range(10)}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        files.read_chunks(spark, str(tmp_path / "none"))


def test_image_names_are_given_once(spark):
    rels = [("d", f"rId{i}", t, "m") for i, t in enumerate(("a.png", "x/a.png", "a_1.png", "a", "b", "image005.png", "a.png"), 1)] + [("e", "rId1", "a.png", "m")]
    got = images.image_names(spark.createDataFrame(rels, "doc STRING, r_id STRING, target STRING, member STRING")).collect()
    assert sorted((r.doc, r.r_id, r.img_name) for r in got) == [("d", "rId1", "a.png"), ("d", "rId2", "a_1.png"), ("d", "rId3", "a_1_1.png"), ("d", "rId4", "image004.png"), ("d", "rId5", "image005.png"), ("d", "rId6", "image005_1.png"), ("d", "rId7", "a_2.png"), ("e", "rId1", "a.png")]
