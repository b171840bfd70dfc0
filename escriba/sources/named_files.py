"""A file of its own for every row, under the name that the row gives: df.write.format("named_files").mode("append").save(folder), for rows of name and content.

Tasks write their files under temporary names in a folder of the job; only when all tasks have succeeded does the commit give the files their own names, by renames, and what failed or repeated
tasks left behind goes with the job's folder. No content passes the driver. A job that fails leaves the folder as it was.

Defined results: content is a string (written as UTF-8, as it is) or binary; null content is an empty file. Rows without a name fail the job, as do names with a separator of folders in them. An
existing file of a name is replaced; of several rows of one name in a job one is kept, so names should be made distinct first (sinks.named does).
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, ARCHIVES = "named_files", "zip_archives"
#: Renames at a time.
RENAMES = 16


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _checked(name: str | None) -> str:
    if not name or "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError(f"no name of a file: {name!r}")
    return name


def _bytes(content: str | bytes | None) -> bytes:
    return content.encode() if isinstance(content, str) else content or b""


class FileWriter(DataSourceArrowWriter):
    columns = ["content", "name"]

    def __init__(self, folder: str, columns: list[str], overwrite: bool):
        if sorted(columns) != self.columns:
            raise ValueError(f"rows need the columns {', '.join(self.columns)}, and no others")
        self.folder, self.overwrite = folder, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.folder)
        mine, n = f"{root}/{self.job}/{uuid.uuid4().hex}", 0
        fs.create_dir(mine, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with fs.open_output_stream(f"{mine}/{_checked(name)}") as out:
                    out.write(_bytes(content))
                n += 1
        return Written(mine, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.folder)
        if self.overwrite:
            for info in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
                if info.type == pa.fs.FileType.File:
                    fs.delete_file(info.path)

        def rename(path: str) -> None:
            fs.move(path, f"{root}/{path.rsplit('/', 1)[1]}")

        with ThreadPoolExecutor(RENAMES) as pool:
            for m in messages:  # only of tasks that succeeded
                if m is not None:
                    list(pool.map(rename, (i.path for i in fs.get_file_info(pa.fs.FileSelector(m.folder)))))
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, fs: pa.fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.job}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class ArchiveWriter(FileWriter):
    """Rows of one archive lie next to each other in one task (sinks.write_bundles sees to that): a row at a time goes into the open archive."""

    columns = ["archive", "content", "name"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.folder)
        mine = f"{root}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(mine, recursive=True)
        done: set[str] = set()
        with ExitStack() as opened:
            now, archive = None, None
            for batch in iterator:
                for which, name, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "name", "content")), strict=True):
                    if which != now:
                        opened.close()
                        if which in done:
                            raise ValueError(f"rows of {which!r} don't lie together")
                        out = opened.enter_context(fs.open_output_stream(f"{mine}/{_checked(which)}"))
                        archive = opened.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED))
                        now = which
                        done.add(which)
                    archive.writestr(_checked(name), _bytes(content))
        return Written(mine, len(done))


class Archives(DataSource):
    """ZIP files from rows of archive (its name), name and content."""

    @classmethod
    def name(cls) -> str:
        return ARCHIVES

    def schema(self) -> str:
        return "archive string, name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], schema.fieldNames(), overwrite)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema.fieldNames(), overwrite)
