"""Recognition that outlives its workers: a ledger of attempts in the shared folder.

A task notes which pages it is about to work on before it starts them, and stores their rows when they are done, a few pages at a time. If a page kills its worker,
the job fails, and the ledger tells which pages are done, which were never begun, and which were begun and never ended. The next pass leaves out the first, goes on
with the second, and runs each of the last, the suspects, alone in a process of its own; the page whose process dies is named in its row, and all others keep their results.
A page that takes the whole executor with it every time is begun alone ALONE times and then given up.
"""

from __future__ import annotations

import multiprocessing
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..plans.recognition import CRASHED
from ..storage import new_folder
from .engines import PAGES, Page, Rasteriser, Recogniser, as_batch, page_result

#: Pages noted and stored together.
AT_ONCE = 32
#: Times that a suspect is begun alone before it is given up.
ALONE = 2

BEGUN = "doc_id long, page int, pages int, alone boolean"


def _store(folder: str, kind: str, table: pa.Table) -> None:
    """A file of its own, under its name only when it is whole."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/{kind}", recursive=True)
    name = uuid.uuid4().hex
    pq.write_table(table, f"{root}/{kind}/.{name}", filesystem=fs)
    fs.move(f"{root}/{kind}/.{name}", f"{root}/{kind}/{name}.parquet")


def _files(folder: str, kind: str) -> int:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    return len(fs.get_file_info(pa.fs.FileSelector(f"{root}/{kind}", allow_not_found=True)))


def in_own_process(f, *args) -> tuple[object, int | None]:
    """What f returns, computed in a child process, or None and the child's exit code if it died."""
    here, there = multiprocessing.get_context("fork").Pipe(False)

    def work() -> None:
        there.send(f(*args))

    child = multiprocessing.get_context("fork").Process(target=work)
    child.start()
    there.close()
    try:
        out = here.recv()
    except EOFError:
        out = None
    child.join()
    return out, None if out is not None else child.exitcode


def _begun(folder: str, pages: list[tuple[int, int, int]], alone: bool) -> None:
    columns = list(zip(*pages, strict=True))
    _store(folder, "begun", pa.table({"doc_id": pa.array(columns[0], pa.int64()), "page": pa.array(columns[1], pa.int32()), "pages": pa.array(columns[2], pa.int32()), "alone": pa.array([alone] * len(pages))}))


def _pass(files: DataFrame, folder: str, result, rasteriser: Rasteriser, at_once: int) -> DataFrame:
    """One pass over files (doc_id, content, skip, suspects: arrays of pages). Rows: how many pages each batch stored."""

    def count(content: bytes) -> int:
        try:
            return rasteriser.page_count(content)
        except Exception:  # no page can be told from another: the document's own count holds
            return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, bytes, int, int]] = []

        def work() -> None:
            if waiting:
                _begun(folder, [(doc, n, pages) for doc, _, n, pages in waiting], False)
                _store(folder, "done", pa.Table.from_batches([as_batch([result(doc, content, n) for doc, content, n, _ in waiting])]))
                waiting.clear()

        for batch in batches:
            stored = 0
            for i in range(batch.num_rows):
                doc, content, skip, suspects = (batch.column(j)[i].as_py() for j in range(4))
                pages = count(content or b"")
                for n in range(1, pages + 1):
                    if n in (skip or ()):
                        continue
                    stored += 1
                    if n in (suspects or ()):
                        _begun(folder, [(doc, n, pages)], True)
                        row, code = in_own_process(result, doc, content, n)
                        _store(folder, "done", pa.Table.from_batches([as_batch([row or crashed(doc, n, f"exit code {code}")])]))
                    else:
                        waiting.append((doc, content, n, pages))
                        if len(waiting) >= at_once:
                            work()
            work()  # contents go with their batch
            yield pa.record_batch({"stored": pa.array([stored], pa.int64())})

    return files.mapInArrow(run, "stored long")


def crashed(doc: int, page: int, why: str) -> Page:
    return doc, page, CRASHED.format(page=page), True, 0.0, why, 0.0


def ledger(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """The begun pages and the rows of done ones; pages done twice (a task was repeated) count once."""
    read = lambda kind, schema: spark.read.schema(schema).parquet(f"{folder}/{kind}") if _files(folder, kind) else spark.createDataFrame([], schema)
    return read("begun", BEGUN), read("done", PAGES).dropDuplicates(["doc_id", "page"])


def remaining(files: DataFrame, begun: DataFrame, done: DataFrame, given_up: DataFrame) -> DataFrame:
    """files (doc_id, content) that aren't finished, with skip and suspects."""
    over = done.select("doc_id", "page").unionByName(given_up.select("doc_id", "page"))
    state = begun.groupBy("doc_id", "page").agg(F.max("pages").alias("pages")).join(over.withColumn("over", F.lit(True)), ["doc_id", "page"], "left")
    by_doc = state.groupBy("doc_id").agg(F.max("pages").alias("pages"), F.collect_set(F.when(F.col("over"), F.col("page"))).alias("skip"), F.collect_set(F.when(F.col("over").isNull(), F.col("page"))).alias("suspects"))
    return files.join(by_doc, "doc_id", "left").where("pages is null or size(skip) < pages").select("doc_id", "content", "skip", "suspects")


def recognise_surely(files: DataFrame, rasteriser: Rasteriser, recogniser: Recogniser, language: str = "spa", options: Options = Options(), enhance: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """As engines.recognise_files; every page has a row, also one that kills its worker (its error says how the process ended)."""
    spark = files.sparkSession
    folder = new_folder(spark, "attempts")
    files = files.select("doc_id", "content")

    def result(doc: int, content: bytes, n: int) -> Page:
        return page_result(doc, content, n, rasteriser, recogniser, language, options, enhance)

    nothing = F.lit(None).cast("array<int>")
    todo = files.select("*", nothing.alias("skip"), nothing.alias("suspects"))
    given_up = spark.createDataFrame([], "doc_id long, page int")
    while True:
        before = _files(folder, "begun")
        try:
            _pass(todo, folder, result, rasteriser, at_once).write.format("noop").mode("overwrite").save()
            break
        except Exception:
            if _files(folder, "begun") == before:  # it isn't a page
                raise
        begun, done = ledger(spark, folder)
        given_up = begun.where("alone").groupBy("doc_id", "page").agg(F.count("*").alias("n")).where(F.col("n") >= ALONE).join(done, ["doc_id", "page"], "left_anti").select("doc_id", "page")
        todo = remaining(files, begun, done, given_up)
    _, done = ledger(spark, folder)
    note = F.replace(F.lit(CRASHED), F.lit("{page}"), F.col("page").cast("string"))
    lost = given_up.select("doc_id", "page", note.alias("text"), F.lit(True).alias("as_is"), F.lit(0.0).alias("confidence"), F.lit("the executor was lost").alias("error"), F.lit(0.0).alias("seconds"))
    return done.unionByName(lost.join(done, ["doc_id", "page"], "left_anti"))
