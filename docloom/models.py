"""Where models plug in, with deterministic defaults that need no weights.

A model is an object with one method over a list of inputs; it travels to the executors, works on Arrow
batches of ``batch`` rows and is made once for each Python worker task.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.schemas import TEXT_DIM, VISUAL_DIM

#: What a captioning model is asked, by class of image.
PROMPTS = {
    "figure": "What does this figure from a paper show? Name its kind, what the axes or parts stand for, the trend, and any lettering.",
    "diagram": "Which parts does this diagram have, and how are they connected or nested? Repeat its labels; leave interpretation out.",
    "flowchart": "Go through this flowchart step by step: the steps, the decisions with their outcomes, and their labels.",
    "architecture": "Which layers or modules does this architecture have, what flows between them, and which sizes are written there?",
    "chart": "Which kind of chart is this? Give its title, axes with units, legend, the values that can be read, and the trend.",
    "table": "Which columns does this table have, how many rows, and which values or differences stand out?",
    "equation": "Write this formula down, as LaTeX if possible, and name its symbols and operators.",
    "screenshot": "Which program or page does this screenshot show? Give the visible text, the controls and the data.",
    "unknown": "Say what can be seen in this image: things, text, colours and how they are arranged.",
}
TEXT_BATCH, IMAGE_BATCH = 32, 4


class TextEmbedder(Protocol):
    dimension: int
    model_name: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors of hashed words; the same text gives the same vector everywhere."""

    model_name = "hashed-words"

    def __init__(self, dimension: int = TEXT_DIM) -> None:
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class NoVisualModel:
    """Stands in where no visual model is installed: vectors of zeros."""

    dimension = VISUAL_DIM
    model_name = "none"

    def embed(self, images: Sequence[bytes | None]) -> np.ndarray:
        return np.zeros((len(images), self.dimension), np.float32)

    def embed_query(self, query: str) -> np.ndarray:
        return np.zeros(self.dimension, np.float32)


def embed_texts(model: TextEmbedder, batch: int = TEXT_BATCH) -> Callable[[Column], Column]:
    """Column function: vectors of texts. A failing model fails the job."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.embed([t or "" for t in texts[i : i + batch]]) for i in range(0, len(texts), batch)]
            yield pd.Series([v.tolist() for p in parts for v in p], dtype=object)

    return run


def embed_images(model, batch: int = IMAGE_BATCH) -> Callable[[Column], Column]:
    """Column function: vectors of encoded images; zeros for a batch on which the model fails."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for images in batches:
            out = []
            for i in range(0, len(images), batch):
                part = list(images[i : i + batch])
                try:
                    out += model.embed(part).tolist()
                except Exception:
                    out += np.zeros((len(part), model.dimension)).tolist()
            yield pd.Series(out, dtype=object)

    return run


def caption_images(model, batch: int = 1) -> Callable[[Column, Column], Column]:
    """Column function: captions of (encoded image, class); null where the model fails, for a template to stand in."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for images, kinds in batches:
            out = []
            for image, kind in zip(images, kinds, strict=True):
                try:
                    out.append(model.describe(image, PROMPTS.get(kind, PROMPTS["unknown"])))
                except Exception:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run


def prompt(kind: Column) -> Column:
    """What a captioning model is asked about an image of this class."""
    table = F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(PROMPTS["unknown"]))


def recognise_text(model) -> Callable[[Column], Column]:
    """Column function: blocks (text, confidence, bbox) of encoded images; none where the model fails."""

    @F.pandas_udf("array<struct<text:string,confidence:double,bbox:array<array<double>>>>")
    def run(images: pd.Series) -> pd.Series:
        def one(image: bytes | None) -> list:
            try:
                return [{"text": t, "confidence": c, "bbox": b} for t, c, b in model.read(image)]
            except Exception:
                return []

        return pd.Series([one(x) for x in images], dtype=object)

    return run


def parse_files(files: DataFrame, parser, schema: str = "document_id string, seq int, label string, text string, page int, "
                "grid array<array<string>>, error string") -> DataFrame:
    """Layout items of ``files`` (document_id, content): ``parser.items(bytes)`` yields (label, text, page, grid).

    A file that cannot be read gives one row with its error, and the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["document_id"], pdf["content"], strict=True):
                try:
                    rows += [(doc, i, label, text, page, grid, None) for i, (label, text, page, grid) in enumerate(parser.items(content))]
                except Exception as problem:
                    rows.append((doc, 0, None, None, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["document_id", "seq", "label", "text", "page", "grid", "error"])

    return files.select("document_id", "content").mapInPandas(run, schema)


def read_pages(files: DataFrame, parser) -> DataFrame:
    """(document_id, page, text, content) of ``files`` (document_id, content): ``parser.pages(bytes)`` yields
    (page, its own text, an image of it or None). A file that cannot be read has no page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["document_id"], pdf["content"], strict=True):
                try:
                    rows += [(doc, page, text, image) for page, text, image in parser.pages(content)]
                except Exception:
                    logging.getLogger(__name__).warning("pages of %s could not be read", doc, exc_info=True)
            yield pd.DataFrame(rows, columns=["document_id", "page", "text", "content"])

    return files.select("document_id", "content").mapInPandas(run, "document_id string, page int, text string, content binary")
