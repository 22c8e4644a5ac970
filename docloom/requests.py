"""Requests as they are checked on the driver before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("text", "visual", "hybrid")


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")


@dataclass(frozen=True)
class SearchRequest:
    """A text search; empty filters ask for nothing."""

    query: str
    top_k: int = 5
    document_id: str | None = None
    heading: str | None = None
    page: int | None = None
    chunk_type: str | None = None

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("query must not be blank")
        _between("top_k", self.top_k, 1, 50)
        if self.page is not None and self.page < 1:
            raise ValueError("page counts from 1")


@dataclass(frozen=True)
class MultimodalRequest:
    """A search over text and visual vectors with weights of their scores."""

    query: str
    top_k: int = 5
    mode: str = "hybrid"
    document_id: str | None = None
    chunk_types: tuple[str, ...] = field(default=())
    text_weight: float = 0.5
    visual_weight: float = 0.5

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("query must not be blank")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        _between("top_k", self.top_k, 1, 50)
        _between("text_weight", self.text_weight, 0, 1)
        _between("visual_weight", self.visual_weight, 0, 1)
