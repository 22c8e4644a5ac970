"""The query catalogue; modules register themselves when loaded."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("search", "texts", "describe", "store")


def load_catalog() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"docloom.plans.{name}")
