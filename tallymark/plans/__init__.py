"""Runnable queries over the driver tables, grouped by theme."""

from __future__ import annotations

import importlib

from tallymark.plans.registry import CATALOGUE, Query

THEMES = (
    "dockets",
    "compliance",
    "language",
    "extraction",
    "layout",
    "linkage",
    "statutory",
    "meaning",
    "streams",
)


def load_catalogue() -> dict[str, Query]:
    for theme in THEMES:
        importlib.import_module(f"tallymark.plans.{theme}")
    return dict(CATALOGUE)
