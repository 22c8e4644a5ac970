"""Text expressions: headings, tokens, sentences, captions, file types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading patterns in order of precedence, matched without regard to case.
HEADINGS = (
    (r"\babstract\b", "abstract"),
    (r"\bintroduction\b", "introduction"),
    (r"\bconclusion", "conclusion"),
    (r"\breference", "references"),
    (r"\bfigure\b|\bfig\.\b|\bcaption\b", "figure_caption"),
    (r"\btable\b", "table"),
    (r"\bmethod", "subsection"),
    (r"\bexperiment", "subsection"),
    (r"\brelated\s+work", "subsection"),
    (r"\bdiscussion", "subsection"),
    (r"\bappendix", "subsection"),
)
# Sentence boundary, characters of a token, query prefix, file extensions.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
CHARS_PER_TOKEN = 4
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
EXTENSIONS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "docx": "docx", "pptx": "pptx"}
# Fixed value: rows of a table that go into its text.
TABLE_ROWS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once and named, where an expression uses it often."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """``text`` without white space at its ends (of any kind, not only blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def classify_heading(heading: Column) -> Column:
    """Chunk type of a section heading: the first pattern that occurs, else heading; blank is paragraph."""
    kind = F.when(blank(heading), "paragraph")
    for pattern, name in HEADINGS:
        kind = kind.when(heading.rlike(f"(?i){pattern}"), name)
    return kind.otherwise("heading")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences; a boundary is white space after .!? and before A-Z."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def table_text(headers: Column, rows: Column, raw_text: Column) -> Column:
    """A table as text: a header line and the first rows, cells joined by bars; else the raw text.
    Null if there is nothing."""
    lines = F.transform(F.slice(rows, 1, TABLE_ROWS), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("None"))), " | "))
    head = F.when(F.size(headers) > 0, F.array(F.concat(F.lit("Headers: "), F.array_join(headers, " | ")))).otherwise(
        F.expr("cast(array() as array<string>)"))
    made = strip(F.array_join(F.concat(head, lines), "\n"))
    raw = strip(raw_text)
    return F.when(made != "", made).when(raw != "", raw)


def caption_text(image_number: Column, page: Column, image_path: Column) -> Column:
    """Synthetic caption of an extracted image; null without a path."""
    made = F.format_string("Figure %d on page %d. Source: %s", image_number, page, image_path)
    return F.when(F.coalesce(image_path, F.lit("")) != "", made)


def chunk_id(index: Column, document_id: Column) -> Column:
    """Identifier of the chunk with this 0-based index."""
    return F.format_string("chunk_%05d_%s", index + 1, F.substring(document_id, 1, 8))


def embedding_text(caption: Column, description: Column, chunk_type: Column, page: Column, table: Column, chart: Column,
                   equation: Column) -> Column:
    """Text by which a visual element is embedded; ``table``, ``chart`` and ``equation`` are their
    descriptions, null where the element has no such data."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    data = lambda kind, label, c: F.when((chunk_type == kind) & c.isNotNull(), F.concat(F.lit(label), c))
    made = F.concat_ws(" ", some("Caption: ", caption), some("Description: ", description), data("table", "Table: ", table),
                       data("chart", "Chart: ", chart), data("equation", "Equation: ", equation))
    return F.when(made != "", made).otherwise(F.concat_ws(" on page ", chunk_type, page.cast("string")))


def visual_caption(chunk_type: Column, page: Column) -> Column:
    return F.concat(F.initcap(chunk_type), F.lit(" on page "), page.cast("string"))


def query_text(query: Column) -> Column:
    """A search query as it is embedded."""
    return F.concat(F.lit(QUERY_PREFIX), query)


def heading_level(label: Column) -> Column:
    """Level of a layout label: 1 for h1 and titles, 2 for h2, 3 for h3, else 2."""
    low = F.lower(label)
    return F.when(low.contains("h1") | low.contains("title"), 1).when(low.contains("h2"), 2).when(low.contains("h3"), 3).otherwise(2)


def item_page(pages: Column) -> Column:
    """Page of a layout item: the first of its provenance, else 1."""
    return F.coalesce(F.try_element_at(pages, F.lit(1)), F.lit(1))


def file_type(path: Column) -> Column:
    """pdf, image, docx or pptx by the name's extension; null if unsupported."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.when(F.lit(False), F.lit(""))
    for name in sorted(set(EXTENSIONS.values())):
        kind = kind.when(extension.isin([e for e, k in EXTENSIONS.items() if k == name]), name)
    return kind
