"""Recognised pages as they arrive, in any order and from any worker, put together to documents as soon as they are whole.

Keyed state holds a document's pages, each under its number, until all of 1 to total_pages are there; then the document leaves. A timer in event time lets a document go that waits for
too long: pages that never came are filled as in a batch. What leaves is an array of pages, and the text, counts and fields are made of it by the same expressions as in
plans.drivers, so a stream and a batch of the same pages answer the same.

Defined results: rows without a doc_id, a page from 1 on or a total are left out; so are pages beyond the first total that was named. Of a page that comes twice, that of the greater
confidence (then of the greater text) counts. Pages that come after their document left are dropped for as long as the document would have waited; a document of no pages never
comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import Options
from ..plans.drivers import scanned_documents
from ..plans.recognition import MISSING

#: What arrives; at: when the page was recognised.
PAGES = "doc_id long, total_pages long, page int, text string, confidence double, error string, seconds double, at timestamp"
GATHERED = "doc_id long, total_pages long, pages array<struct<page: int, text: string, confidence: double, error: string, recognised: boolean>>, seconds double"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _none(value: object) -> object:
    return None if value is None or value != value else value


class Holder(StatefulProcessor):
    """One document's pages. wait: milliseconds that a document may wait for its pages."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string, confidence double, error string, seconds double")
        #: how many pages there are, how many came, and whether the document has left
        self.about = handle.getValueState("about", "total_pages long, came long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.about.exists():
            total, came, gone = self.about.get()
        else:
            total, came, gone = None, 0, False
        first = None
        for part in rows:
            for r in part.itertuples(index=False):
                if total is None:
                    total = int(r.total_pages)
                first = r.at if first is None else min(first, r.at)
                if gone or r.page > total:
                    continue
                new = (_none(r.text), float(_none(r.confidence) or 0.0), _none(r.error), float(_none(r.seconds) or 0.0))
                at = (int(r.page),)
                if self.pages.containsKey(at):
                    old = self.pages.getValue(at)
                    if (new[1], new[0] or "") <= (old[1], old[0] or ""):
                        continue
                else:
                    came += 1
                self.pages.updateValue(at, new)
        if not self.about.exists():
            since = max(int(pd.Timestamp(first).timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(since + self.wait)
        leaves = not gone and came == total
        if leaves:
            yield self._document(key, total)
        self.about.update((total, came, gone or leaves))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.about.exists():
            total, _, gone = self.about.get()
            if not gone:
                yield self._document(key, total)
                self.about.update((total, 0, True))
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.wait)
            else:
                self.about.clear()

    def _document(self, key, total: int) -> pd.DataFrame:
        """The pages in order, missing ones filled; the state keeps none of them."""
        held = {k[0]: v for k, v in self.pages.iterator()}
        self.pages.clear()
        blank = (MISSING, 0.0, None, 0.0)
        shown = [{"page": n, "text": (held[n][0] or "") if n in held else MISSING, "confidence": held.get(n, blank)[1], "error": held.get(n, blank)[2], "recognised": n in held} for n in range(1, total + 1)]
        return pd.DataFrame({"doc_id": [key[0]], "total_pages": [total], "pages": [shown], "seconds": [sum(v[3] for v in held.values())]})

    def close(self) -> None:
        pass


def gather(pages: DataFrame, wait_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Documents (GATHERED) from a stream of pages (PAGES). A document that isn't whole leaves when the watermark, late behind the newest page, has passed its first page by wait_seconds."""
    known = pages.where("doc_id is not null and page >= 1 and total_pages >= 1 and at is not null").withWatermark("at", late)
    return known.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Holder(wait_seconds * 1000), outputStructType=GATHERED, outputMode="Append", timeMode="EventTime")


def documents(pages: DataFrame, wait_seconds: int = 3600, late: str = "10 minutes", options: Options = Options()) -> DataFrame:
    """Whole documents, as plans.drivers.process_scanned gives them, from a stream of pages."""
    return scanned_documents(gather(pages, wait_seconds, late), options)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, wait_seconds: int = 3600, late: str = "10 minutes", options: Options = Options(), **trigger) -> StreamingQuery:
    """Pages from the Parquet files of a folder to documents in another; the checkpoint holds what is waiting. trigger: as for writeStream.trigger (availableNow unless given).

    The state of this query needs the RocksDB provider, which is set for the session while it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(PAGES).parquet(source)
        return documents(stream, wait_seconds, late, options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
