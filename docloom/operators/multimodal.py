"""Multimodal chunks: images and tables with captions, descriptions and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import describe as dx
from docloom.functions import text as tx
from docloom.schemas import CHART_DATA, EQUATION_DATA, TABLE_DATA


def described(images: DataFrame, caption: Column | None = None) -> DataFrame:
    """``images`` (chunk_type …) with ``description``: the caption if there is one, else the class's template."""
    made = dx.fallback_description(F.col("chunk_type"))
    if caption is not None:
        made = F.when(~tx.blank(caption), tx.strip(caption)).otherwise(made)
    return images.withColumn("description", made)


def image_chunks(images: DataFrame, charts: bool = True, equations: bool = True) -> DataFrame:
    """Chunks of classified images (document_id, page, image_number, image_path, chunk_type, description,
    ocr_text, width, height, source_file), with chart or equation data read from their text."""
    text = F.coalesce("ocr_text", F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    is_kind = lambda k, on: (F.col("chunk_type") == k) & F.lit(on)
    eq_type = dx.equation_type(text, F.col("width"), F.col("height"))
    chart = tx.let(dx.chart_axes(text), lambda axes: F.struct(
        F.lit("unknown").alias("chart_type"), axes["title"].alias("title"), axes["x_axis"].alias("x_axis"), axes["y_axis"].alias("y_axis"),
        none.alias("legend"), F.expr("cast(array() as array<map<string,string>>)").alias("values"),
        dx.chart_description(F.lit("unknown"), axes["title"], axes["x_axis"], axes["y_axis"], none, F.lit(0)).alias("description")))
    equation = tx.let(dx.latex(text), lambda latex: F.struct(
        text.alias("raw_ocr_text"), latex.alias("latex"), eq_type.alias("equation_type"),
        dx.equation_description(text, latex, eq_type).alias("description")))
    table = tx.let(dx.ocr_table(text), lambda read: F.struct(
        read["columns"].alias("columns"), read["rows"].alias("rows"),
        dx.table_description(read["columns"], F.size(read["rows"])).alias("description"), F.lit("ocr").alias("extraction_method")))
    return images.withColumns({
        "caption": tx.visual_caption(F.col("chunk_type"), F.col("page")),
        "chart_data": F.when(is_kind("chart", charts), chart).cast(CHART_DATA),
        "equation_data": F.when(is_kind("equation", equations), equation).cast(EQUATION_DATA),
        "table_data": F.when(is_kind("table", True), table).cast(TABLE_DATA),
        "chunk_id": F.concat_ws("_", F.lit("img"), "document_id", F.col("page").cast("string"), F.col("image_number").cast("string")),
    })


def table_chunks(tables: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Chunks of parsed tables (document_id, page, table_number, headers, rows, source_file).

    Where tables were extracted again from a page (document_id, page, seq, data), the first of the page
    takes the place of every table's data on it.
    """
    data = dx.parsed_table(F.struct("headers", "rows")).cast(TABLE_DATA)
    if extracted is not None:
        first = extracted.groupBy("document_id", "page").agg(F.min_by("data", "seq").alias("again"))
        tables = tables.join(first, ["document_id", "page"], "left")
        data = F.coalesce("again", data)
    made = tables.withColumn("table_data", data).withColumns({
        "chunk_type": F.lit("table"),
        "caption": F.concat(F.lit("Table on page "), F.col("page").cast("string")),
        "chunk_id": F.concat_ws("_", F.lit("tab"), "document_id", F.col("page").cast("string"), F.col("table_number").cast("string")),
    })
    return made.withColumn("description", F.col("table_data.description"))


def element_text() -> Column:
    """Text by which a multimodal chunk is embedded."""
    return tx.embedding_text(F.col("caption"), F.col("description"), F.col("chunk_type"), F.col("page"), F.col("table_data.description"),
                             F.col("chart_data.description"), F.col("equation_data.description"))


def element_counts(images: DataFrame, tables: DataFrame, by: str = "document_id") -> DataFrame:
    """(charts, equations, figures, tables) of each document; figures are all other images."""
    kind = F.col("chunk_type")
    seen = images.groupBy(by).agg(F.count_if(kind == "chart").alias("charts"), F.count_if(kind == "equation").alias("equations"),
                                  F.count_if(~kind.isin("chart", "equation")).alias("figures"))
    held = tables.groupBy(by).agg(F.count("*").alias("tables"))
    both = seen.join(held, by, "full_outer")
    return both.select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("charts", "equations", "figures", "tables")])


def linked_captions(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Caption chunks of a text collection beside the visual elements that they refer to by image path."""
    return chunks.filter(F.col("multimodal_ref").isNotNull()).select("chunk_id", "multimodal_ref").join(
        elements.select(F.col("image_path").alias("multimodal_ref"), F.col("chunk_id").alias("element_id")), "multimodal_ref")
