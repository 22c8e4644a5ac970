"""Assembly of parsed documents from layout items, page texts and recognised blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

# Labels of body items; characters below which a page counts as scanned; least confidence of a
# block; least sides of an extracted and of a processed image; characters of a title taken from a page.
BODY = ("text", "paragraph", "list_item", "body")
SCANNED, CONFIDENCE, EQUATION_CONFIDENCE = 50, 0.5, 0.3
EXTRACT_SIDE, PROCESS_SIDE, TITLE_CHARS = 50, 32, 80


def is_header(label: Column) -> Column:
    return label.contains("section_header") | label.contains("heading") | label.contains("title")


def sections(items: DataFrame) -> DataFrame:
    """(document_id, section, page, heading, level, text) of layout items (document_id, seq, label, text, page).

    A header closes the section before it; body texts are joined by line ends; other labels and blank
    items are left out; what comes before the first header is a section without heading on page 1.
    """
    label, body = F.lower("label"), tx.strip(F.coalesce("text", F.lit("")))
    some = items.select("document_id", "seq", "page", label.alias("label"), body.alias("text")).filter(
        (F.col("text") != "") & (is_header(F.col("label")) | F.col("label").isin(*BODY)))
    order = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = some.withColumn("section", F.sum(is_header(F.col("label")).cast("int")).over(order))
    head = is_header(F.col("label"))
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct("seq", "text"))))
    return marked.groupBy("document_id", "section").agg(
        F.coalesce(F.max(F.when(head, F.coalesce("page", F.lit(1)))), F.lit(1)).alias("page"),
        F.coalesce(F.max(F.when(head, F.col("text"))), F.lit("")).alias("heading"),
        F.coalesce(F.max(F.when(head, tx.heading_level(F.col("label")))), F.lit(1)).alias("level"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def title(items: DataFrame) -> DataFrame:
    """(document_id, title): the first non-empty text of an item labelled as a title, else empty."""
    named = (F.lower("label").contains("title")) & (F.coalesce("text", F.lit("")) != "")
    return items.groupBy("document_id").agg(F.coalesce(F.min_by(F.when(named, F.col("text")), F.when(named, F.col("seq"))), F.lit("")).alias("title"))


def tables(items: DataFrame) -> DataFrame:
    """Tables of layout items with a ``grid``: numbered per document, the grid's first row as headers."""
    order = Window.partitionBy("document_id").orderBy("seq")
    none = F.expr("cast(array() as array<string>)")
    return items.filter(F.lower("label").contains("table")).select(
        "document_id", F.coalesce("page", F.lit(1)).alias("page"), F.row_number().over(order).alias("table_number"),
        F.coalesce(F.try_element_at("grid", F.lit(1)), none).alias("headers"),
        F.slice("grid", 2, F.greatest(F.size("grid"), F.lit(1))).alias("rows"), F.coalesce("text", F.lit("")).alias("raw_text"))


def page_sections(pages: DataFrame) -> DataFrame:
    """One section for each non-blank page of ``pages`` (document_id, page, text)."""
    return pages.filter(~tx.blank(F.col("text"))).select(
        "document_id", "page", F.lit("").alias("heading"), tx.strip(F.col("text")).alias("text"), F.lit(1).alias("level"))


def page_title(pages: DataFrame) -> DataFrame:
    """(document_id, title): the beginning of the first non-blank page."""
    return page_sections(pages).groupBy("document_id").agg(F.substring(F.min_by("text", "page"), 1, TITLE_CHARS).alias("title"))


def page_counts(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, pages) of every document; 0 where none could be read."""
    counted = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    return documents.select("document_id").join(counted, "document_id", "left").select("document_id", F.coalesce("pages", F.lit(0)).alias("pages"))


def page_chars(found: DataFrame) -> DataFrame:
    """(document_id, page, chars): characters of all sections on each page."""
    return found.groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("chars"))


def scanned_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages (document_id, page) with little text, both native and from the layout."""
    joined = pages.select("document_id", "page", F.length(tx.strip(F.coalesce("text", F.lit("")))).alias("native")).join(
        page_chars(found), ["document_id", "page"], "left")
    return joined.filter((F.col("native") < SCANNED) & (F.coalesce("chars", F.lit(0)) < SCANNED)).select("document_id", "page")


def with_ocr(found: DataFrame, recognised: DataFrame) -> DataFrame:
    """Sections with those of recognised pages (document_id, page, heading, text, level) in their place."""
    pages = recognised.select("document_id", "page").distinct()
    return found.join(pages, ["document_id", "page"], "left_anti").unionByName(recognised)


def ocr_errors(scanned: DataFrame, recognised: DataFrame) -> DataFrame:
    """(document_id, page, error) of scanned pages on which nothing was recognised."""
    return scanned.join(recognised.select("document_id", "page"), ["document_id", "page"], "left_anti").withColumn(
        "error", F.format_string("OCR produced no text for page %d.", F.col("page")))


def ocr_blocks(blocks: Column, least: float = CONFIDENCE) -> Column:
    """Recognised blocks (text, confidence, bbox) of confidence ``least`` or more that have text, stripped,
    from top to bottom; blocks of one height keep their order."""
    sure = F.filter(F.transform(blocks, lambda b, i: F.struct(
        b["bbox"][0][1].alias("y"), i.alias("seq"), tx.strip(b["text"]).alias("text"), b["confidence"].alias("confidence"), b["bbox"].alias("bbox"))),
        lambda b: (b["confidence"] >= least) & (b["text"] != ""))
    return F.transform(F.array_sort(sure), lambda b: F.struct(b["text"], b["confidence"], b["bbox"]))


def ocr_text(blocks: Column, least: float = CONFIDENCE) -> Column:
    return F.array_join(F.transform(ocr_blocks(blocks, least), lambda b: b["text"]), "\n")


def numbered_images(images: DataFrame) -> DataFrame:
    """Images (document_id, page, index, width, height, extension) large enough to keep, with file names.

    The number is the index on the page, which counts all images; the name's counter goes on from the
    number of kept images on earlier pages.
    """
    large = (F.col("width") >= EXTRACT_SIDE) & (F.col("height") >= EXTRACT_SIDE)
    kept = images.withColumn("kept", large.cast("int"))
    per_page = kept.groupBy("document_id", "page").agg(F.sum("kept").alias("n"))
    earlier = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    before = per_page.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    extension = F.when(F.lower("extension") == "jpeg", "jpg").otherwise(F.lower("extension"))
    return kept.filter("kept = 1").join(before, ["document_id", "page"]).select(
        "document_id", "page", F.col("index").alias("image_number"), "width", "height",
        F.format_string("img_%03d_p%d.%s", (F.col("before") + F.col("index")).cast("int"), F.col("page").cast("int"), extension).alias("image_path"))


def image_boxes(images: DataFrame, info: DataFrame) -> DataFrame:
    """Images (document_id, page, xref) with the first box of page info (…, seq, box) for the same xref."""
    first = info.filter(F.col("box").isNotNull()).groupBy("document_id", "page", "xref").agg(F.min_by("box", "seq").alias("bounding_box"))
    return images.join(first, ["document_id", "page", "xref"], "left")


def documents(files: DataFrame, items: DataFrame, pages: DataFrame | None = None, recognised: DataFrame | None = None,
              unread: DataFrame | None = None) -> DataFrame:
    """Parsed documents of ``files`` (document_id, filename) from their layout items, nested as one row each.

    ``items`` are (document_id, seq, label, text, page, grid, error). A document without sections takes those
    of its ``pages`` (document_id, page, text), if given, and its title from the first of them. Sections of
    ``recognised`` pages (document_id, page, heading, text, level) stand in the place of those pages' own. Errors of
    items and of ``unread`` pages (document_id, error) go into parse_errors.
    """
    read = items.filter(F.col("error").isNull())
    found = sections(read)
    if pages is not None:
        plain = pages.join(found.select("document_id").distinct(), "document_id", "left_anti")
        found = found.unionByName(page_sections(plain).withColumn("section", F.col("page").cast("long")))

    if recognised is not None:
        seq = F.col("page").cast("long") * (1 << 32)
        found = with_ocr(found.withColumn("section", seq + F.col("section")), recognised.withColumn("section", seq))

    def nested(rows: DataFrame, order: str, fields: list[str], name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("v"))))
        return rows.groupBy("document_id").agg(F.transform(parts, lambda p: p["v"]).alias(name))

    first = F.min_by("text", "section")
    wrong = items.filter(F.col("error").isNotNull()).select("document_id", "error")
    wrong = wrong if unread is None else wrong.unionByName(unread.select("document_id", "error"))
    errors = wrong.groupBy("document_id").agg(F.sort_array(F.collect_list("error")).alias("parse_errors"))
    body = found.withColumns({"page": F.col("page").cast("int"), "level": F.col("level").cast("int")})
    named = title(read).withColumnRenamed("title", "named")
    out = files.select("document_id", "filename")
    for part in (nested(body, "section", ["page", "heading", "text", "level"], "sections"),
                 nested(tables(read), "table_number", ["page", "table_number", "headers", "rows", "raw_text"], "tables"),
                 named, found.filter("heading = ''").groupBy("document_id").agg(F.substring(first, 1, TITLE_CHARS).alias("opening")), errors):
        out = out.join(part, "document_id", "left")
    chosen = F.when(F.coalesce("named", F.lit("")) != "", F.col("named"))
    chosen = F.coalesce(chosen, F.when(F.col("named").isNull(), F.col("opening")), F.lit(""))
    return out.select("document_id", "filename", chosen.alias("title"), "sections", "tables", "parse_errors")
