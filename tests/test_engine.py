"""Ingest and search end to end, and the catalog, on files made here."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tomegrid.engine import Engine
from tomegrid.operators import catalog, rag
from tomegrid.sources import docx, files


@pytest.fixture
def engine(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS eng LOCATION '{tmp_path}/db'")
    e = Engine(spark, "eng.chunks")
    yield e
    spark.sql("DROP DATABASE eng CASCADE")


def test_markdown_to_answers(spark, engine, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "3.1.md").write_text("# Заземление\n(3.1.1) Щиты заземляют медной шиной.\n(3.1.2) Кабели лежат в лотках. ![рис](image_3.1/a.png)\n")
    engine.chunk_folder(str(tmp_path / "md"), str(tmp_path / "chunks"))
    assert engine.collection.create() and not engine.collection.create(drop_existing=False)
    images = spark.createDataFrame([("image_3.1/a.png", True)], "path STRING, is_file BOOLEAN")
    vectors = spark.createDataFrame([("image_3.1/a.png", [1.0] + [0.0] * 511)], "path STRING, image_vector ARRAY<DOUBLE>")
    summary = engine.load_folder(str(tmp_path / "chunks"), catalog=images, image_vectors=vectors).collect()
    assert [(r.chunks, r.images, r.batches) for r in summary] == [(2, 1, 1)]
    engine.load_folder(str(tmp_path / "chunks"), catalog=images, skip_existing=True)
    assert engine.collection.stats()["num_entities"] == 2
    hit = engine.search_text("заземляют щиты шиной", 1).first()
    assert "медной" in hit.text and hit.chapter == "3.1" and hit.search_type == "text"
    assert engine.search_text("щиты", 5, with_images_only=True).count() == 1 and engine.search_text("щиты", 5, chapter="9.9").count() == 0
    image = [1.0] + [0.0] * 511
    assert engine.search_image(image, 1).first().has_image
    fused = engine.search_hybrid("щиты", image, 2, text_weight=0.0, image_weight=1.0).collect()
    assert fused[0].has_image and fused[0].fused_score == 1.0 and len(fused) == 2
    assert engine.search_hybrid("щиты", limit=1).count() == 1
    assert catalog.metadata(spark, "eng.chunks") == ("hashing", 64) and catalog.metadata(spark, "eng.none") is None
    with pytest.warns(UserWarning):
        catalog.Collection(spark, "eng.chunks", "other", 64).load().unpersist()
    engine.collection.close()


def test_config(tmp_path):
    path = tmp_path / "c.json"
    assert catalog.load_config(str(path)) is None and catalog.default_model(None) == (catalog.FALLBACK_MODEL, 384)
    path.write_text(json.dumps({"default_text_model": "a", "default_dim": 768, "text_model_dim": {"a": 1024}}))
    config = catalog.load_config(str(path))
    assert catalog.default_model(config) == ("a", 1024) and catalog.model_dim(config, "b") == 768
    path.write_text("{")
    assert catalog.load_config(str(path)) is None


def test_files_out(spark, tmp_path):
    docs = spark.createDataFrame([("sub/a.md", "раз\nдва")], "file_name STRING, text STRING")
    assert files.write_markdown(docs, str(tmp_path / "md")) == 1
    assert (tmp_path / "md" / "sub" / "a.md").read_text() == "раз\nдва\n"
    (tmp_path / "in" / "image_1").mkdir(parents=True)
    (tmp_path / "in" / "image_1" / "a.png").write_bytes(b"xyz")
    plan = spark.createDataFrame([("d", "image_1/a.png", True), ("d", "image_1/b.png", True), ("d", "c", False)], "doc STRING, ref STRING, exists BOOLEAN")
    assert [tuple(r) for r in files.copy_files(plan, str(tmp_path / "in"), str(tmp_path / "out")).collect()] == [("image_1/a.png", 3)]
    assert (tmp_path / "out" / "image_1" / "a.png").read_bytes() == b"xyz"


def test_docx_images(spark):
    data = docx.build_docx(["x"])
    f = spark.createDataFrame([("f", bytearray(data))], "path STRING, content BINARY")
    names = spark.createDataFrame([("f", "word/document.xml", "a.png"), ("f", "word/none", "b.png")], "doc STRING, member STRING, img_name STRING")
    assert [(r.doc, r.img_name) for r in docx.docx_images(f, names).collect()] == [("f", "a.png")]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "вопрос")], "query_id BIGINT, prompt STRING")
    assert rag.answers(asked, lambda: lambda ps: [p.upper() for p in ps]).first().answer == "ВОПРОС"
    assert spark.range(1).select(rag.status_label(F.lit("Не допускается")).alias("s")).first().s == "mandatory"
