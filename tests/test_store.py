import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import models
from docloom.engine import Engine
from docloom.functions import ids
from docloom.operators.store import Collection, upserted
from docloom.requests import MultimodalRequest, SearchRequest
from docloom.sources import files
from docloom.streaming.ingest import ingest

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("document_id", "chunk_id", "text")])


@pytest.fixture
def kept(spark, tmp_path):
    return Collection(spark, str(tmp_path / "points"), SCHEMA, buckets=4)


def rows(spark, *items):
    return spark.createDataFrame([(d, c, t) for d, c, t in items], SCHEMA)


def test_upsert_replaces_by_key(spark, kept):
    assert kept.upsert(rows(spark, ("d1", "a", "old"), ("d2", "b", "two"))) == 2
    kept.upsert(rows(spark, ("d1", "a", "new"), ("d3", "c", "three")))
    assert {tuple(r) for r in kept.read().collect()} == {("d1", "a", "new"), ("d2", "b", "two"), ("d3", "c", "three")}
    assert kept.upsert(rows(spark).limit(0)) == 0


def test_delete_count_exists_pending(spark, kept):
    assert not kept.exists() and kept.count() == 0 and not kept.has("d1")
    kept.upsert(rows(spark, ("d1", "a", "x"), ("d1", "b", "y"), ("d2", "c", "z")))
    assert kept.count("d1") == 2 and kept.has("d1")
    assert [r.document_id for r in kept.pending(rows(spark, ("d1", "", ""), ("d9", "", ""))).collect()] == ["d9"]
    kept.delete(["d1"])
    assert kept.count() == 1 and not kept.has("d1")
    kept.drop()
    assert not kept.exists()


def test_same_key_twice_leaves_one_row(spark):
    got = upserted(rows(spark), rows(spark, ("d", "k", "a"), ("d", "k", "b")), ["document_id", "chunk_id"]).collect()
    assert [tuple(r) for r in got] == [("d", "k", "b")]


def test_read_of_a_document_prunes_buckets(spark, kept):
    kept.upsert(rows(spark, *[(f"d{i}", "a", "x") for i in range(20)]))
    assert "PartitionFilters: [isnotnull(bucket" in kept.read("d3")._jdf.queryExecution().executedPlan().toString()


def test_point_id_is_name_based_uuid(spark):
    names = ["chunk_00001_abc", "é", ""]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.point_id(F.col("n")).alias("p")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def write_documents(folder, n=3):
    folder.mkdir()
    for i in range(n):
        text = "We study transformers. " * (200 if i == 1 else 2)
        (folder / f"{i}.json").write_text(json.dumps({"document_id": f"{i:016x}", "filename": f"f{i}.pdf", "title": f"Paper {i}", "sections": [
            {"page": 1, "heading": "Abstract", "text": text}, {"page": 2, "heading": "Methods", "text": f"number {i} unicorn"}]}))
    (folder / "bad.json").write_text("{bad")


def test_engine_end_to_end(spark, tmp_path):
    write_documents(tmp_path / "json")
    docs = files.read_documents(spark, str(tmp_path / "json"))
    assert docs.filter("corrupt is not null").count() == 1
    good = docs.filter("corrupt is null").drop("corrupt")
    engine = Engine(spark, str(tmp_path / "store"), models.HashEmbedder(64))
    first = engine.index_text(good)
    assert first["indexed"] == 3 and first["chunks"] == engine.texts.count()
    again = engine.index_text(good)
    assert again["already_indexed"] == 3 and again["chunks"] == 0
    assert engine.index_text(good, force=True)["chunks"] == first["chunks"] == engine.texts.count()
    assert engine.search(SearchRequest("unicorn number 2", top_k=1)).first().document_id == f"{2:016x}"
    assert engine.search(SearchRequest("unicorn", document_id=f"{1:016x}", page=2)).count() >= 1

    images = spark.createDataFrame([("d", 1, 1, "p1", "chart", "T\nloss\nEpoch", 100, 50, "f"), ("d", 2, 1, "p2", "figure", None, 100, 50, "f")],
                                   "document_id string,page int,image_number int,image_path string,chunk_type string,ocr_text string,width int,height int,source_file string")
    for _ in range(2):
        assert engine.index_multimodal(images)["vectors"] == 2
    assert engine.visuals.count() == 2
    assert engine.search_multimodal(MultimodalRequest("chart loss epoch", chunk_types=("chart",))).first().chunk_type == "chart"
    assert engine.health()["text_points"] == first["chunks"]


def test_uploads(spark, tmp_path):
    for name, body in (("a.pdf", b"x"), ("b.txt", b"x"), ("c.PNG", b""), ("d.docx", b"x")):
        (tmp_path / name).write_bytes(body)
    got = {r.filename: (r.file_type, r.rejected) for r in files.scan_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.txt": (None, "unsupported file type"), "d.docx": ("docx", None)}  # the reader passes over empty files
    sizes = spark.createDataFrame([("/u/c.PNG", 0), ("/u/e.png", 100 * 1024 * 1024 + 1)], "path string, length long").withColumn("content", F.lit(b""))
    assert [r.rejected for r in files.uploads(sizes).collect()] == ["file is empty", "file too large"]
    assert files.placeholders(files.accepted(files.scan_uploads(spark, str(tmp_path)))).first().parse_errors[0].startswith("DOCX")


def test_stream_runs_again_without_duplicates(spark, tmp_path, kept):
    source = str(tmp_path / "in")
    start = lambda: ingest(spark, source, SCHEMA, kept, str(tmp_path / "ck"), lambda b: b).awaitTermination()
    rows(spark, ("d1", "a", "x"), ("d2", "b", "y")).write.parquet(source)
    start()
    rows(spark, ("d2", "b", "late"), ("d3", "c", "z")).write.mode("append").parquet(source)
    start()
    assert {tuple(r) for r in kept.read().collect()} == {("d1", "a", "x"), ("d2", "b", "y"), ("d3", "c", "z")}


def failing():
    """A model that fails, made in a function so that it travels by value."""

    class Failing:
        dimension = 4

        def embed(self, images):
            raise RuntimeError

        def describe(self, image, prompt):
            raise RuntimeError

        def read(self, image):
            return [("low", 0.2, [[0.0, 1.0]]), (" top ", 0.9, [[0.0, 0.0]])]

        def items(self, content):
            if content == b"bad":
                raise ValueError("encrypted")
            yield "title", "T", 1, None

    return Failing()


def test_models_fall_back(spark):
    from docloom.operators import assembly

    one = spark.createDataFrame([(bytearray(b"x"), "figure")], "image binary, kind string")
    row = one.select(models.embed_images(failing())(F.col("image")).alias("v"), models.caption_images(failing())(F.col("image"), F.col("kind")).alias("c"),
                     assembly.ocr_text(models.recognise_text(failing())(F.col("image"))).alias("t")).first()
    assert row.v == [0.0] * 4 and row.c is None and row.t == "top"
    read = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "document_id string, content binary")
    got = {r.document_id: (r.text, r.error) for r in models.parse_files(read, failing()).collect()}
    assert got == {"a": ("T", None), "b": (None, "ValueError: encrypted")}


def test_ingest_parses_assembles_and_exports(spark, tmp_path):
    class Lines:
        """Every line is an item; those with a hash are headers."""

        def items(self, content):
            if content.startswith(b"bad"):
                raise ValueError("encrypted")
            for line in content.decode().split("\n"):
                header = line.startswith("#")
                yield ("title" if header else "text"), line.lstrip("# "), 1, None
            yield "table", "raw", 2, [["Model", "BLEU"], ["a", "1"]]

    up = tmp_path / "up"
    up.mkdir()
    for name, body in (("a.pdf", "# Paper\nFirst.\nSecond.\n# Methods\nThird."), ("b.pdf", "bad"), ("c.docx", "x"), ("d.txt", "x")):
        (up / name).write_text(body)
    engine = Engine(spark, str(tmp_path / "store"), models.HashEmbedder(16))
    made, rejected = engine.ingest(str(up), Lines(), str(tmp_path / "json"))
    got = {r.filename: r for r in made.collect()}
    assert [(s.heading, s.text) for s in got["a.pdf"].sections] == [("Paper", "First.\nSecond."), ("Methods", "Third.")]
    assert got["a.pdf"].title == "Paper" and got["a.pdf"].tables[0].headers == ["Model", "BLEU"]
    assert got["b.pdf"].parse_errors == ["ValueError: encrypted"] and got["b.pdf"].sections == []
    assert got["c.docx"].parse_errors[0].startswith("DOCX") and [r.rejected for r in rejected.collect()] == ["unsupported file type"]
    again = {r.filename: r for r in files.read_documents(spark, str(tmp_path / "json")).collect()}
    assert again["a.pdf"].sections == got["a.pdf"].sections
    assert engine.index_text(made.filter("filename = 'a.pdf'"))["chunks"] == 6


def test_documents_fall_back_to_pages(spark):
    from docloom.operators import assembly

    listed = spark.createDataFrame([("d", "f")], "document_id string, filename string")
    items = spark.createDataFrame([], "document_id string, seq int, label string, text string, page int, grid array<array<string>>, error string")
    pages = spark.createDataFrame([("d", 1, " "), ("d", 2, " Two "), ("d", 3, "Three")], "document_id string, page int, text string")
    row = assembly.documents(listed, items, pages).first()
    assert row.title == "Two" and [(s.page, s.text) for s in row.sections] == [(2, "Two"), (3, "Three")]


def test_ingest_recognises_images_and_scanned_pages(spark, tmp_path):
    class Paper:
        def items(self, content):
            yield "title", "Named", 1, None
            yield "text", "A long native text. " * 20, 1, None

        def pages(self, content):
            yield 1, "A long native text. " * 20, None
            yield 2, "", b"scan"
            yield 3, " ", b"blank"

    class Reader:
        def read(self, image):
            if image == b"blank":
                return []
            if image == b"broken":
                raise ValueError("no image")
            return [("low", 0.9, [[0.0, 9.0]]), (f"seen {image.decode()}", 0.9, [[0.0, 1.0]]), ("unsure", 0.1, [[0.0, 2.0]])]

    up = tmp_path / "up"
    up.mkdir()
    for name, body in (("a.pdf", "x"), ("b.png", "cat"), ("c.jpg", "broken")):
        (up / name).write_text(body)
    engine = Engine(spark, str(tmp_path / "store"), models.HashEmbedder(16))
    made, rejected = engine.ingest(str(up), Paper(), recogniser=Reader())
    got = {r.filename: r for r in made.collect()}
    assert rejected.count() == 0 and sorted(got) == ["a.pdf", "b.png", "c.jpg"]
    assert [(s.page, s.text) for s in got["a.pdf"].sections][1:] == [(2, "seen scan\nlow")] and got["a.pdf"].sections[0].heading == "Named"
    assert got["a.pdf"].ocr_applied and got["a.pdf"].parse_errors == ["OCR produced no text for page 3."]
    assert [(s.page, s.text) for s in got["b.png"].sections] == [(1, "seen cat\nlow")] and got["b.png"].ocr_applied
    assert got["c.jpg"].sections == [] and got["c.jpg"].parse_errors and not got["c.jpg"].ocr_applied
    plain = {r.filename: r for r in engine.ingest(str(up), Paper())[0].collect()}
    assert sorted(plain) == ["a.pdf", "b.png", "c.jpg"] and plain["b.png"].parse_errors and not plain["a.pdf"].ocr_applied


def test_the_last_of_equal_keys_stays(spark):
    source = rows(spark, ("d", "k", "z"), ("d", "k", "a"))
    assert [tuple(r) for r in upserted(rows(spark), source, ["document_id", "chunk_id"]).collect()] == [("d", "k", "a")]
