"""Structure-aware chunking of parsed documents, as expressions over nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.schemas import with_defaults

# Characters of a chunk, and of the overlap between two.
MAX_CHARS, OVERLAP = 2800, 320

_RANGES = "array<struct<start:int,end:int>>"


def window_ranges(sentences: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Ranges [start, end) of sentences that form windows of up to ``max_chars`` characters.

    After a window the longest run of its last sentences with up to ``overlap`` characters is repeated,
    unless the next sentence would not fit beside it. A sentence longer than a window stands alone.
    """
    lengths = F.transform(sentences, F.length)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.expr(f"cast(array() as {_RANGES})").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        i = acc["i"]
        span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
        fits = acc["size"] + n <= max_chars
        behind = F.reverse(F.slice(lengths, acc["start"] + 1, i - acc["start"]))
        kept = F.aggregate(
            behind, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
            lambda k, x: F.when(k["open"] & (k["size"] + x <= overlap),
                                F.struct((k["n"] + 1).alias("n"), (k["size"] + x).alias("size"), F.lit(True).alias("open"))
                                ).otherwise(F.struct(k["n"].alias("n"), k["size"].alias("size"), F.lit(False).alias("open"))))
        flushed = F.when(acc["start"] < i, F.concat(acc["out"], span(acc["start"], i))).otherwise(acc["out"])
        state = lambda a, size, out: F.struct((i + 1).alias("i"), a.cast("int").alias("start"), size.cast("int").alias("size"), out.alias("out"))
        alone = state(i + 1, F.lit(0), F.concat(flushed, span(i, i + 1)))
        bare = state(i, n, flushed)
        again = tx.let(kept, lambda k: F.when(k["size"] + n <= max_chars, state(i - k["n"], k["size"] + n, flushed)).otherwise(bare))
        return F.when(fits, state(acc["start"], acc["size"] + n, acc["out"])).when(n > max_chars, alone).otherwise(again)

    return F.aggregate(lengths, start, step, lambda acc: F.when(acc["start"] < acc["i"], F.concat(
        acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["i"].alias("end"))))).otherwise(acc["out"]))


def window_texts(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Texts of a body: itself if it fits, else windows of its sentences joined by blanks."""
    cut = tx.let(tx.sentences(text), lambda parts: F.transform(
        window_ranges(parts, max_chars, overlap), lambda r: F.array_join(F.slice(parts, r["start"] + 1, r["end"] - r["start"]), " ")))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(cut)


def windows(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, window, text) of the stripped, non-empty texts of ``df``; a narrow plan without a shuffle."""
    body = df.select(F.col(key), tx.strip(F.col(text)).alias("__body")).filter(F.col("__body") != "")
    # the sentences are a column of their own, so each text is split once
    split = body.select(key, "__body", tx.sentences(F.col("__body")).alias("__parts"))
    ranged = split.withColumn("__ranges", F.when(F.length("__body") > max_chars, window_ranges(F.col("__parts"), max_chars, overlap)))
    texts = F.when(F.col("__ranges").isNull(), F.array("__body")).otherwise(F.transform(
        "__ranges", lambda r: F.array_join(F.slice("__parts", r["start"] + 1, r["end"] - r["start"]), " ")))
    return ranged.select(key, F.posexplode(texts).alias("window", "text"))


_DRAFT = "array<struct<text:string,page:int,heading:string,chunk_type:string,multimodal_ref:string>>"


def _draft(text: Column, page: Column, heading: Column, kind: Column, ref: Column | None = None) -> Column:
    return F.struct(text.alias("text"), page.cast("int").alias("page"), heading.alias("heading"), kind.alias("chunk_type"),
                    (ref if ref is not None else F.lit(None).cast("string")).alias("multimodal_ref"))


def section_chunks(section: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Draft chunks of one section: its heading, if any, then its body in one or more windows."""
    body = tx.strip(section["text"])
    kind = tx.classify_heading(section["heading"])
    head = F.when(kind == "paragraph", F.expr(f"cast(array() as {_DRAFT})")).otherwise(
        F.array(_draft(section["heading"], section["page"], section["heading"], F.lit("heading"))))
    parts = F.transform(window_texts(body, max_chars, overlap), lambda t: _draft(t, section["page"], section["heading"], kind))
    return F.when(body == "", F.expr(f"cast(array() as {_DRAFT})")).otherwise(F.concat(head, parts)).cast(_DRAFT)


def chunk_documents(documents: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of parsed documents: title, sections, tables, images, numbered from 0 in this order.

    Rows without document_id raise. One document's chunks come from its own row, so nothing is shuffled.
    """
    checked = with_defaults(documents).withColumn("document_id", F.when(
        F.col("document_id").isNull(), F.raise_error(F.lit("missing required fields: document_id"))).otherwise(F.col("document_id")))
    empty = F.expr(f"cast(array() as {_DRAFT})")
    title = F.when(tx.blank(F.col("title")), empty).otherwise(F.array(_draft(F.col("title"), F.lit(1), F.lit("Title"), F.lit("title"))))
    sections = F.flatten(F.transform("sections", lambda s: section_chunks(s, max_chars, overlap)))
    tables = F.transform("tables", lambda t: _draft(
        tx.table_text(t["headers"], t["rows"], t["raw_text"]), t["page"], F.concat(F.lit("Table "), t["table_number"].cast("string")), F.lit("table")))
    images = F.transform("images", lambda i: _draft(
        tx.caption_text(i["image_number"], i["page"], i["image_path"]), i["page"],
        F.concat(F.lit("Figure "), i["image_number"].cast("string")), F.lit("figure_caption"), i["image_path"]))
    drafts = F.filter(F.concat(title.cast(_DRAFT), sections.cast(_DRAFT), tables.cast(_DRAFT), images.cast(_DRAFT)),
                      lambda d: ~tx.blank(d["text"]))
    rows = checked.select("document_id", F.col("filename").alias("source_file"), F.posexplode(drafts).alias("chunk_index", "d"))
    return rows.select(
        tx.chunk_id(F.col("chunk_index"), F.col("document_id")).alias("chunk_id"), "document_id", "d.page", "d.heading", "d.chunk_type",
        tx.strip(F.col("d.text")).alias("text"), "source_file", tx.estimate_tokens(F.col("d.text")).alias("token_count"),
        "chunk_index", "d.multimodal_ref")
