"""Adapters to public libraries, for those who have them: Tesseract (pytesseract) as recogniser, poppler (pdf2image) as rasteriser.

Neither library is needed to import this module; available() tells which can be used, and the adapters say what is missing. The
libraries are imported where the work is done, on the executors, so the adapters themselves are small and can be sent there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec

import numpy as np

from ..config import Options
from .engines import Rasteriser, Recogniser


def _bgr(picture: object) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(picture.convert("RGB"))[:, :, ::-1])  # type: ignore[attr-defined]


def _picture(img: np.ndarray) -> object:
    from PIL import Image

    return Image.fromarray(img if img.ndim == 2 else np.ascontiguousarray(img[:, :, ::-1]))


@dataclass
class Poppler:
    """Pages of PDF files, and images as files of one page."""

    threads: int = 1

    def page_count(self, content: bytes) -> int:
        if not content.lstrip()[:5] == b"%PDF-":
            return 1
        from pdf2image import pdfinfo_from_bytes

        return int(pdfinfo_from_bytes(content)["Pages"])

    def page(self, content: bytes, number: int, dpi: int) -> np.ndarray | None:
        if not content.lstrip()[:5] == b"%PDF-":
            import io

            from PIL import Image

            return _bgr(Image.open(io.BytesIO(content)))
        from pdf2image import convert_from_bytes

        found = convert_from_bytes(content, dpi=dpi, first_page=number, last_page=number, thread_count=self.threads)
        return _bgr(found[0]) if found else None


@dataclass
class Tesseract:
    """Words with confidences, in the segmentation and engine mode of each pass."""

    dpi: int = Options().dpi

    @property
    def version(self) -> str:
        import pytesseract

        return str(pytesseract.get_tesseract_version())

    def rotation(self, img: np.ndarray) -> int:
        import pytesseract

        return int(pytesseract.image_to_osd(_picture(img), output_type=pytesseract.Output.DICT)["rotate"])

    def words(self, img: np.ndarray, language: str, segmentation: str, model: str) -> tuple[Callable[[], str], list[float]]:
        """The text is another run of the engine, made only if it is asked for."""
        import pytesseract

        # The engine's options.
        config, page = f"--psm {segmentation} --oem {model} --dpi {self.dpi} -c preserve_interword_spaces=1", _picture(img)
        found = pytesseract.image_to_data(page, lang=language, config=config, output_type=pytesseract.Output.DICT)
        return lambda: pytesseract.image_to_string(page, lang=language, config=config), [float(c) for c in found["conf"]]

    def text(self, img: np.ndarray, language: str) -> str:
        import pytesseract

        return pytesseract.image_to_string(_picture(img), lang=language)


def available() -> tuple[Rasteriser | None, Recogniser | None]:
    """The adapters whose libraries can be imported here; give them to engine.process."""
    has = lambda *names: all(find_spec(n) is not None for n in names)
    return (Poppler() if has("pdf2image", "PIL") else None), (Tesseract() if has("pytesseract", "PIL") else None)
