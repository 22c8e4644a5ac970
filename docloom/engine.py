"""The engine: ingestion, indexing and search over collections below one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import models
from docloom.functions import describe as dx
from docloom.functions import ids
from docloom.functions import text as tx
from docloom.operators import assembly, chunking, multimodal, search
from docloom.operators.store import Collection, export_documents, payload_json
from docloom.requests import MultimodalRequest, SearchRequest
from docloom.schemas import CHUNK, DOCUMENT, MM_CHUNK, parsed, with_defaults
from docloom.sources import files

TEXT_POINT = f"{CHUNK}, point_id string, text_vector array<float>, payload string"
MM_POINT = f"{MM_CHUNK}, point_id string, embedding_text string, text array<float>, visual array<float>"


class Engine:
    """Text and multimodal collections with the models that fill them."""

    def __init__(self, spark: SparkSession, root: str, text_model: models.TextEmbedder | None = None, visual_model=None) -> None:
        self.spark = spark
        self.text_model = text_model or models.HashEmbedder()
        self.visual_model = visual_model or models.NoVisualModel()
        self.texts = Collection(spark, f"{root}/text_points", parsed(TEXT_POINT))
        self.visuals = Collection(spark, f"{root}/multimodal_points", parsed(MM_POINT))

    def ingest(self, path: str, parser, out: str | None = None, recogniser=None) -> tuple[DataFrame, DataFrame]:
        """(documents, rejected files) of the uploads below ``path``.

        ``parser.items(bytes)`` yields (label, text, page, grid) for a PDF. A parser that also has ``pages(bytes)``, which
        yields (page, its text, an image of it or None), gives sections by page to documents without any. A
        ``recogniser`` reads the text of scanned pages and of image uploads. Types without a parser give empty
        documents with a note. With ``out``, documents are also exported there as JSON.
        """
        found = files.scan_uploads(self.spark, path)
        good = files.accepted(found)
        pdfs = files.route(good, "pdf")
        items = models.parse_files(pdfs, parser)
        pages = models.read_pages(pdfs, parser) if hasattr(parser, "pages") else None
        read = unread = None
        if recogniser is not None and pages is not None:
            scanned = assembly.scanned_pages(pages, assembly.sections(items.filter(F.col("error").isNull())))
            text = assembly.ocr_text(models.recognise_text(recogniser)(F.col("content")))
            read = assembly.page_sections(pages.join(scanned, ["document_id", "page"], "left_semi").select("document_id", "page", text.alias("text")))
            unread = assembly.ocr_errors(scanned, read)
        made = assembly.documents(pdfs, items, pages, read, unread)
        if read is not None:
            made = made.join(read.select("document_id").distinct().withColumn("ocr_applied", F.lit(True)), "document_id", "left").withColumn(
                "ocr_applied", F.coalesce("ocr_applied", F.lit(False)))
        made = made.unionByName(files.placeholders(good).drop("sections"), allowMissingColumns=True).unionByName(
            self.image_uploads(good, recogniser), allowMissingColumns=True)
        fields = {f.name: F.lit(None).cast(f.dataType) for f in parsed(DOCUMENT).fields}
        made = with_defaults(made.withColumns({k: v for k, v in fields.items() if k not in made.columns}).select(*fields))
        if out is not None:
            export_documents(made, out)
        return made, found.filter(F.col("rejected").isNotNull()).select("path", "rejected")

    def image_uploads(self, uploads: DataFrame, recogniser=None) -> DataFrame:
        """Documents of image files: one section of the recognised text, or none and a note."""
        text = F.lit("") if recogniser is None else assembly.ocr_text(models.recognise_text(recogniser)(F.col("content")))
        images = uploads.filter(F.col("file_type").isin("image")).withColumn("text", text)
        nested = files.image_documents(images, "text").groupBy("document_id").agg(
            F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "heading", "text", F.col("level").cast("int").alias("level"))).alias("sections"))
        made = images.select("document_id", "filename").join(nested, "document_id", "left")
        note = F.when(F.col("sections").isNull(), F.array(F.lit("No text was recognised in the image.")))
        return made.select("document_id", "filename", F.lit("").alias("title"), "sections", note.alias("parse_errors"),
                           F.col("sections").isNotNull().alias("ocr_applied"))

    def text_points(self, documents: DataFrame) -> DataFrame:
        """Points of parsed documents' chunks."""
        chunks = chunking.chunk_documents(documents)
        embed = models.embed_texts(self.text_model)
        return chunks.withColumns({"point_id": ids.point_id(F.col("chunk_id")), "text_vector": embed(F.col("text")),
                                   "payload": payload_json("chunk_id", "document_id", "page", "heading", "chunk_type", "text", "source_file",
                                                           "token_count", "chunk_index", "multimodal_ref")})

    def index_text(self, documents: DataFrame, force: bool = False) -> dict:
        """Index documents that are not in the collection yet, or all of them anew."""
        self.texts.ensure()
        todo = documents if force else self.texts.pending(documents)
        if force:
            self.texts.delete(documents.select("document_id").distinct())
        given, new = documents.count(), todo.count()
        return {"documents": given, "indexed": new, "already_indexed": given - new, "chunks": self.texts.upsert(self.text_points(todo)),
                "collection": self.texts.path}

    def visual_points(self, images: DataFrame, tables: DataFrame | None = None) -> DataFrame:
        """Points of classified images and parsed tables; elements without a visual vector get zeros."""
        made = multimodal.image_chunks(multimodal.described(images))
        if tables is not None:
            made = made.unionByName(multimodal.table_chunks(tables), allowMissingColumns=True)
        fill = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in parsed(MM_CHUNK).fields}
        made = made.withColumns({k: v for k, v in fill.items() if k not in made.columns})
        made = made.withColumn("embedding_model", F.lit(self.visual_model.model_name))
        visual = models.embed_images(self.visual_model)(F.col("content")) if "content" in made.columns else F.array_repeat(
            F.lit(0.0).cast("float"), self.visual_model.dimension)
        texted = made.withColumn("embedding_text", multimodal.element_text())
        return texted.withColumns({"point_id": ids.point_id(F.concat_ws("/", "document_id", "chunk_id")), "visual": visual,
                                   "text": models.embed_texts(self.text_model)(F.col("embedding_text"))}).select(*parsed(MM_POINT).fieldNames())

    def index_multimodal(self, images: DataFrame, tables: DataFrame | None = None, force: bool = False) -> dict:
        """Index images and tables; identifiers are the same at every run, so repeating adds nothing."""
        self.visuals.ensure()
        if force:
            self.visuals.delete(images.select("document_id").distinct())
        points = self.visual_points(images, tables)
        held = tables if tables is not None else images.limit(0)
        counts = multimodal.element_counts(images, held).agg(*[F.sum(c).alias(c) for c in ("charts", "equations", "figures", "tables")]).first()
        return {**{k: v or 0 for k, v in counts.asDict().items()}, "vectors": self.visuals.upsert(points), "collection": self.visuals.path}

    def query_vector(self, query: str) -> list[float]:
        return self.text_model.embed([tx.QUERY_PREFIX + query])[0].tolist()

    def search(self, request: SearchRequest) -> DataFrame:
        """The best chunks for a query."""
        where = search.text_filter(request.document_id, request.heading, request.page, request.chunk_type)
        rows = self.texts.read(request.document_id)
        return search.top_k(rows, self.query_vector(request.query), request.top_k, where, vector="text_vector")

    def search_multimodal(self, request: MultimodalRequest) -> DataFrame:
        """The best visual elements for a query, by weighted scores of both vectors."""
        where = search.visual_filter(request.document_id, request.chunk_types or None)
        visual: Sequence[float] = self.visual_model.embed_query(request.query).tolist()
        rows = self.visuals.read(request.document_id).select("chunk_id", "document_id", "chunk_type", "page", "caption", "description",
                                                             "image_path", "source_file", "text", "visual")
        return search.hybrid(rows, self.query_vector(request.query), visual, request.top_k, request.text_weight, request.visual_weight,
                             where, request.mode)

    def health(self) -> dict:
        """Points of both collections and the models in use."""
        return {"status": "ok", "text_points": self.texts.count(), "multimodal_points": self.visuals.count(),
                "text_model": self.text_model.model_name, "visual_model": self.visual_model.model_name}


def image_classes(features: DataFrame) -> DataFrame:
    """``features`` of images with ``class`` and ``confidence``."""
    made = dx.image_class(*[F.col(c) for c in ("edges", "white", "aspect", "hue", "contours", "lines", "rects")])
    return features.withColumn("made", made).select(*features.columns, "made.class", "made.confidence")
