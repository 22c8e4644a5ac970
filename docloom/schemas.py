"""Schemas of parsed documents, chunks, multimodal chunks and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations.
CHUNK_TYPES = ("title", "abstract", "heading", "paragraph", "subsection", "table", "figure_caption", "conclusion",
               "introduction", "references", "unknown")
VISUAL_TYPES = ("figure", "diagram", "flowchart", "architecture", "screenshot", "chart", "table", "equation", "unknown")
CHART_TYPES = ("bar", "line", "pie", "scatter", "unknown")
EQUATION_TYPES = ("inline", "display", "numbered")
EXTRACTION_METHODS = ("camelot_lattice", "camelot_stream", "docling", "ocr", "unknown")
FILE_TYPES = ("pdf", "image", "docx", "pptx")
# Models and vector sizes.
TEXT_MODEL, VISUAL_MODEL = "BAAI/bge-m3", "colpali"
TEXT_DIM, VISUAL_DIM = 1024, 128

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SECTION = "struct<page:int,heading:string,text:string,level:int>"
IMAGE = f"struct<page:int,image_number:int,image_path:string,width:int,height:int,bounding_box:{BOX}>"
TABLE = "struct<page:int,table_number:int,headers:array<string>,rows:array<array<string>>,raw_text:string>"
METADATA = "struct<authors:array<string>,year:string,pages:int,doi:string,keywords:array<string>,extra:map<string,string>>"
# Schemas are kept as DDL, which needs no session; ``parsed`` makes types of them.
DOCUMENT = (
    f"document_id string, filename string, title string, metadata {METADATA}, sections array<{SECTION}>, "
    f"images array<{IMAGE}>, tables array<{TABLE}>, ocr_applied boolean, parse_errors array<string>")
CHUNK = (
    "chunk_id string, document_id string, page int, heading string, chunk_type string, text string, "
    "source_file string, token_count int, chunk_index int, multimodal_ref string")
CHART_DATA = ("struct<chart_type:string,title:string,x_axis:string,y_axis:string,legend:array<string>,"
              "values:array<map<string,string>>,description:string>")
TABLE_DATA = "struct<columns:array<string>,rows:array<array<string>>,description:string,extraction_method:string>"
EQUATION_DATA = "struct<raw_ocr_text:string,latex:string,equation_type:string,description:string>"
MM_CHUNK = (
    "chunk_id string, document_id string, page int, chunk_type string, image_number int, image_path string, "
    f"caption string, description string, bounding_box {BOX}, source_file string, chart_data {CHART_DATA}, "
    f"table_data {TABLE_DATA}, equation_data {EQUATION_DATA}, embedding_model string, rerank_score double, "
    "citation_context string")


def parsed(ddl: str) -> T.StructType:
    """The type that a schema's DDL stands for; needs a running session."""
    return T.StructType.fromDDL(ddl)


def _section_defaults(s: Column) -> Column:
    return F.struct(F.coalesce(s["page"], F.lit(1)).alias("page"), F.coalesce(s["heading"], F.lit("")).alias("heading"),
                    F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["level"], F.lit(1)).alias("level"))


def _table_defaults(t: Column) -> Column:
    none, rows = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<array<string>>)")
    return F.struct(F.coalesce(t["page"], F.lit(1)).alias("page"), F.coalesce(t["table_number"], F.lit(0)).alias("table_number"),
                    F.coalesce(t["headers"], none).alias("headers"), F.coalesce(t["rows"], rows).alias("rows"),
                    F.coalesce(t["raw_text"], F.lit("")).alias("raw_text"))


def _image_defaults(i: Column) -> Column:
    return F.struct(F.coalesce(i["page"], F.lit(1)).alias("page"), F.coalesce(i["image_number"], F.lit(0)).alias("image_number"),
                    F.coalesce(i["image_path"], F.lit("")).alias("image_path"), F.coalesce(i["width"], F.lit(0)).alias("width"),
                    F.coalesce(i["height"], F.lit(0)).alias("height"), i["bounding_box"].alias("bounding_box"))


def with_defaults(documents: DataFrame) -> DataFrame:
    """Parsed documents with the declared default in place of every missing part."""
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return documents.withColumns({
        "filename": F.coalesce("filename", F.lit("")),
        "title": F.coalesce("title", F.lit("")),
        "sections": F.transform(F.coalesce("sections", empty(SECTION)), _section_defaults),
        "tables": F.transform(F.coalesce("tables", empty(TABLE)), _table_defaults),
        "images": F.transform(F.coalesce("images", empty(IMAGE)), _image_defaults),
        "ocr_applied": F.coalesce("ocr_applied", F.lit(False)),
        "parse_errors": F.coalesce("parse_errors", empty("string")),
    })
