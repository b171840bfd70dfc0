"""Options of the engine, passed explicitly; executors read no environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    language: str = "spa"
    dpi: int = 400
    scale: float = 2.5
    detect_orientation: bool = True
    #: a page counts towards a document's confidence above this
    page_confidence: float = 60.0
    #: a document with so many characters and no image is read as text
    text_threshold: int = 800
    pages_to_route: int = 3
    max_bytes: int = 100 * 1024 * 1024
