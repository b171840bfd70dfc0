"""Where a rasteriser and a recogniser plug in. None is bundled: Recorded, which answers with words recorded before, serves tests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Options
from ..plans.recognition import CRASHED, FAILED, FALLBACK_CONFIDENCE, UNAVAILABLE, UNCONVERTED, UNRECOGNISED
from . import image

#: The passes over a page, in order; the first of equally good ones wins.
PASSES = (("6", "3"), ("4", "3"), ("6", "1"))

#: as_is: the text is a note, not to be corrected; seconds: what the page took, from its pixels on.
PAGES = "doc_id long, page int, text string, as_is boolean, confidence double, error string, seconds double"
Page = tuple[int, int, str, bool, float, str | None, float]


class Rasteriser(Protocol):
    def page_count(self, content: bytes) -> int: ...

    def page(self, content: bytes, number: int, dpi: int) -> np.ndarray | None:
        """BGR pixels, or None if there is no such page."""


class Recogniser(Protocol):
    version: str

    def rotation(self, img: np.ndarray) -> int: ...

    def words(self, img: np.ndarray, language: str, segmentation: str, model: str) -> tuple[str | Callable[[], str], list[float]]:
        """Text, and a confidence for each word. A text that takes a run of its own is given as a function, called only if the pass is the best so far."""

    def text(self, img: np.ndarray, language: str) -> str:
        """The text of the default pass, asked for only if no other pass gave one."""


@dataclass
class Recorded:
    """A recogniser that knows its answers by the sum of an image's pixels."""

    answers: dict[int, tuple[str, list[float]]] = field(default_factory=dict)
    version: str = "recorded"

    def rotation(self, img: np.ndarray) -> int:
        return 0

    def words(self, img: np.ndarray, language: str, segmentation: str, model: str) -> tuple[str, list[float]]:
        return self.answers.get(int(img.astype(np.int64).sum()), ("", []))

    def text(self, img: np.ndarray, language: str) -> str:
        return self.answers.get(int(img.astype(np.int64).sum()), ("", []))[0]


def recognise_page(img: np.ndarray, recogniser: Recogniser, language: str, options: Options, enhance: bool = True) -> tuple[str, bool, float]:
    """Text, whether it is a note, and confidence of a page: the first pass of the greatest mean confidence (of whole confidences above 0); without one, or without its text, the default pass.

    A page that can't be enhanced is recognised as it is; a pass that fails is left out; a default pass that fails is the page's text."""
    if options.detect_orientation:
        try:
            img = image.upright(img, recogniser.rotation(img))
        except Exception:  # an orientation that isn't found leaves the page as it is
            pass
    try:
        page = image.enhance(img, options.scale) if enhance else img
    except (ValueError, IndexError, ZeroDivisionError):
        page = img
    best, confidence = "", 0.0
    for segmentation, model in PASSES:
        try:
            text, found = recogniser.words(page, language, segmentation, model)
            whole = [w for w in map(int, found) if w > 0]
            mean = sum(whole) / len(whole) if whole else 0.0
            if mean > confidence:
                confidence = mean
                best = text() if callable(text) else text
        except MemoryError:  # the page took more than its worker had
            raise
        except Exception:  # a pass that fails is left out, the others decide
            continue
    if best:
        return best, False, confidence
    try:
        return recogniser.text(page, language), False, FALLBACK_CONFIDENCE
    except MemoryError:
        raise
    except Exception as e:
        return UNRECOGNISED.format(why=e), True, 0.0


def page_result(doc: int, content: bytes, n: int, rasteriser: Rasteriser, recogniser: Recogniser, language: str, options: Options, enhance: bool = True) -> Page:
    """A row of PAGES. Whatever goes wrong with a page is said in its own row: error is null for a recognised page, empty where there was no such page."""
    began = time.monotonic()
    out = ("", True, 0.0, None)
    try:
        img, failure = rasteriser.page(content, n, options.dpi), None
    except Exception as e:
        img, failure = None, str(e) or type(e).__name__
    if failure is not None:
        out = (UNCONVERTED.format(page=n, why=failure), True, 0.0, failure)
    elif img is None:
        out = (UNAVAILABLE, True, 0.0, None)
    else:
        try:
            out = (*recognise_page(img, recogniser, language, options, enhance), None)
        except MemoryError as e:
            out = (CRASHED.format(page=n), True, 0.0, str(e) or type(e).__name__)
        except Exception as e:
            out = ("", True, 0.0, FAILED.format(page=n, why=e))
    return doc, n, *out, time.monotonic() - began


def as_batch(rows: list[Page]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.string(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[c.split()[0] for c in PAGES.split(", ")])


def recognise_files(files: DataFrame, rasteriser: Rasteriser, recogniser: Recogniser, language: str = "spa", options: Options = Options(), enhance: bool = True) -> DataFrame:
    """Rasterise, enhance and recognise every page of files (doc_id, content), a row of PAGES each: passes are compared where they are made, pages are never written between the
    steps, and one page's pixels at a time are held. A worker that dies takes its task with it; attempts.recognise_surely outlives that.

    Repartition files by document first where a few documents hold most of the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for n in range(1, rasteriser.page_count(content) + 1):
                    yield as_batch([page_result(doc, content, n, rasteriser, recogniser, language, options, enhance)])

    return files.select("doc_id", "content").mapInArrow(run, PAGES)
