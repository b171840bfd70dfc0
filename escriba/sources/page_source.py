"""The pages of a folder's PDF files as a data source: spark.read.format("document_pages").load(folder).

Files are dealt to partitions by their sizes: small ones share a partition, a large one is many, each with a range of its pages, so one big file is many tasks. Conditions on page (=, in,
<, <=, >, >=) and path (=, in, ends with) reach the source: only the files and pages that they leave are parsed. Columns that aren't in the schema given to
the reader aren't made: spark.read.schema("path string, page int") parses no text.

Defined results: files that are no PDF, or whose pages can't be listed, have no row; a page that can't be read has a row with its error. page_count is that of the whole file, whatever pages are asked for.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith
from pyspark.sql.types import StructType

from .pdf import Document

NAME = "document_pages"
SCHEMA = "path string, length long, page_count int, page int, text string, image_count int, error string"
_TYPES = {"path": pa.string(), "length": pa.int64(), "page_count": pa.int32(), "page": pa.int32(), "text": pa.string(), "image_count": pa.int32(), "error": pa.string()}
#: Bytes of files to a partition.
PART_BYTES = 32 << 20
_BROKEN = (ValueError, KeyError, IndexError, TypeError, zlib.error, AttributeError)


@dataclass
class Share(InputPartition):
    """Files of one task: name, length, and which share of how many of the pages is wanted."""

    files: list[tuple[str, int, int, int]]


@dataclass
class Wanted:
    """The pages that conditions leave."""

    first: int = 1
    last: int | None = None
    only: frozenset[int] | None = None

    def narrow(self, f: Filter) -> bool:
        """Take a condition on page; False if it isn't of a kind known here."""
        if isinstance(f, In):
            only = frozenset(f.value)
            self.only = only if self.only is None else self.only & only
        elif isinstance(f, (EqualTo, LessThanOrEqual, LessThan, GreaterThanOrEqual, GreaterThan)):
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                last = f.value - isinstance(f, LessThan)
                self.last = last if self.last is None else min(self.last, last)
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        else:
            return False
        return True

    def most(self) -> float:
        """So many pages of a file at most."""
        span = math.inf if self.last is None else max(0, self.last - self.first + 1)
        return min(span, math.inf if self.only is None else len(self.only))

    def of(self, pages: int, share: int, shares: int) -> Iterator[int]:
        for n in range(max(self.first, pages * share // shares + 1), min(pages if self.last is None else self.last, pages * (share + 1) // shares) + 1):
            if self.only is None or n in self.only:
                yield n


def matches(f: Filter, path: str) -> bool | None:
    """Whether a path passes a condition on it; None if the condition isn't of a kind known here."""
    if isinstance(f, EqualTo):
        return path == f.value
    if isinstance(f, In):
        return path in f.value
    if isinstance(f, StringEndsWith):
        return path.endswith(f.value)
    return None


class PageReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], part_bytes: int, recursive: bool):
        self.folder, self.columns, self.part_bytes, self.recursive = folder, columns, part_bytes, recursive
        self.pages = Wanted()
        self.paths: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            attribute = getattr(f, "attribute", None)
            if attribute == ("page",) and (isinstance(f, IsNotNull) or self.pages.narrow(f)):
                continue
            if attribute == ("path",) and matches(f, "") is not None:
                self.paths.append(f)
                continue
            yield f

    def _open(self) -> tuple[pa.fs.FileSystem, str, str]:
        """The file system, the folder in it, and what stands before its names in a path."""
        uri = self.folder if "://" in self.folder or not self.folder.startswith("file:") else "file://" + self.folder[5:]
        fs, root = pa.fs.FileSystem.from_uri(uri)
        return fs, root, "file:" if isinstance(fs, pa.fs.LocalFileSystem) else uri[: len(uri) - len(root)] if uri.endswith(root) else uri.split("://")[0] + "://"

    def partitions(self) -> list[Share]:
        fs, root, before = self._open()
        out: list[Share] = []
        size = self.part_bytes + 1  # of the last partition; the next file opens one
        for info in sorted(fs.get_file_info(pa.fs.FileSelector(root, recursive=self.recursive)), key=lambda i: i.path):
            if info.type != pa.fs.FileType.File or not all(matches(f, before + info.path) for f in self.paths):
                continue
            # a few pages of a large file are one task's work
            shares = max(1, min(math.ceil(info.size / self.part_bytes), self.pages.most()))
            if shares > 1:
                out += [Share([(info.path, info.size, i, shares)]) for i in range(shares)]
                size = self.part_bytes + 1
                continue
            if size + info.size > self.part_bytes:
                out.append(Share([]))
                size = 0
            out[-1].files.append((info.path, info.size, 0, 1))
            size += info.size
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _, before = self._open()
        for path, length, share, shares in partition.files:
            with fs.open_input_file(path) as f:
                data = f.read()
            try:
                document = Document(data)
                pages = document.pages()
            except _BROKEN:
                continue
            rows = [{"path": before + path, "length": length, "page_count": len(pages), "page": n, **self._page(document, pages[n - 1])} for n in self.pages.of(len(pages), share, shares)]
            if rows:
                yield pa.record_batch([pa.array([r[c] for r in rows], _TYPES[c]) for c in self.columns], names=self.columns)

    def _page(self, document: Document, page: object) -> dict:
        """Of text, image_count and error what is asked for."""
        out: dict = {"text": None, "image_count": None, "error": None}
        try:
            if "text" in self.columns or "error" in self.columns:
                out["text"] = document.text(page)
            if "image_count" in self.columns:
                out["image_count"] = document.image_count(page)
        except _BROKEN as e:
            out["error"] = None if out["text"] is not None else str(e) or type(e).__name__
            out["image_count"] = out["image_count"] or 0
        return out


class PageSource(DataSource):
    """Options: path, part_bytes (bytes of files to a partition) and recursive (true: folders in the folder, too)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], schema.fieldNames(), int(self.options.get("part_bytes", PART_BYTES)), str(self.options.get("recursive", "false")).lower() == "true")


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


def folder_pages(spark: SparkSession, folder: str, columns: tuple[str, ...] = tuple(_TYPES), part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id (as in files.uploads) and the columns of a folder's pages."""
    register(spark)
    fields = [c for c in SCHEMA.split(", ") if c.split()[0] in ("path", "page", *columns)]
    pages = spark.read.format(NAME).schema(", ".join(fields)).option("part_bytes", part_bytes).load(folder)
    return pages.select(F.xxhash64("path").alias("doc_id"), *columns)
