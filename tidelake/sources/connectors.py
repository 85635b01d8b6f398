"""A market feed and an alert sink as connectors of Structured Streaming.

``FeedPages`` reads pages (a symbol and a stretch of time each) in batches and
in streams: offsets are times, every batch is the pages between two offsets,
and what a stream has worked off is noted in the feed's folder when Spark
commits it. ``AlertSink`` writes messages in two steps: tasks stage files, and
the driver gives them their final names when all tasks are done, by batch, so a
batch that is repeated replaces its own file and adds nothing.

Both use ``pyarrow.fs``, so folders may be on any file system that it opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from tidelake.functions.package import send

from .feeds import limiter, with_retries


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; plain paths are local ones, or of a shared mount."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_pages(bars: DataFrame, folder: str, step: int, columns: tuple[str, ...] = ("t", "o", "h", "l", "c", "v", "tb")) -> None:
    """Bars (sym, t, ...) as pages that ``FeedPages`` reads: JSON lines under symbol and the page's first second."""
    page = F.floor(F.col("t") / step) * step
    rows = bars.select(F.col("sym").alias("symbol"), page.alias("page"), F.to_json(F.struct(*columns)).alias("value"))
    rows.repartition("symbol", "page").sortWithinPartitions("symbol", "page", "value").write.partitionBy("symbol", "page").text(folder)


@dataclass
class _Page(InputPartition):
    symbol: str
    start: int


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, options):
        self.folder, self.step = options["folder"], int(options["step"])
        self.symbols = options["symbols"].split(",")
        self.start, self.end = int(options["start"]), int(options["end"])
        self.rate = float(options.get("rate", 10))

    def between(self, start: int, end: int) -> list[_Page]:
        first = start // self.step * self.step
        return [_Page(s, t) for s in self.symbols for t in range(first, end, self.step)]

    def read(self, page: _Page) -> Iterator[tuple]:
        limiter(self.rate).wait()
        for row in with_retries(lambda: self._fetch(page)):
            yield page.symbol, page.start, row

    def _fetch(self, page: _Page) -> list[str]:
        fs, root = opened(self.folder)
        where = f"{root}/symbol={page.symbol}/page={page.start}"
        if fs.get_file_info(where).type == pafs.FileType.NotFound:
            return []  # a page without bars
        rows: list[str] = []
        for f in sorted(fs.get_file_info(pafs.FileSelector(where)), key=lambda f: f.path):
            if f.base_name.startswith("part-"):
                with fs.open_input_stream(f.path, compression="detect") as stream:
                    rows += stream.read().decode().splitlines()
        return rows


class _BatchReader(_Pages, DataSourceReader):
    def partitions(self):
        return self.between(self.start, self.end)


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"t": self.start // self.step * self.step}

    def latestOffset(self) -> dict:
        """Whole pages only: what a later run reads begins where this one ends."""
        return {"t": self.end // self.step * self.step}

    def partitions(self, start: dict, end: dict):
        return self.between(start["t"], end["t"])

    def commit(self, end: dict) -> None:
        fs, root = opened(self.folder)
        with fs.open_output_stream(f"{root}/_committed") as out:
            out.write(json.dumps(end).encode())


class FeedPages(DataSource):
    """Rows (symbol, page, payload). Options: folder, symbols, start, end, step (seconds), rate."""

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return "symbol string, page long, payload string"

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


@dataclass
class _Staged(WriterCommitMessage):
    path: str
    rows: int


class _Alerts:
    """Stages rows as JSON lines and names them when all are there."""

    def __init__(self, options):
        self.folder = options["path"]

    def write(self, iterator) -> _Staged:
        fs, root = opened(self.folder)
        fs.create_dir(f"{root}/_staged")
        path, n = f"{root}/_staged/{uuid.uuid4().hex}", 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(), default=str) + "\n").encode())
                n += 1
        return _Staged(path, n)

    def publish(self, messages, name: str) -> None:
        """One file of a batch; what the batch published before is replaced."""
        fs, root = opened(self.folder)
        staged = [m for m in messages if m is not None]
        fs.create_dir(f"{root}/{name}.new")
        for k, m in enumerate(m for m in staged if m.rows):
            fs.move(m.path, f"{root}/{name}.new/{k:05d}.json")
        if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{name}")
        fs.move(f"{root}/{name}.new", f"{root}/{name}")
        self.forget(messages)

    def forget(self, messages) -> None:
        fs, _ = opened(self.folder)
        for m in messages:
            if m is not None and fs.get_file_info(m.path).type != pafs.FileType.NotFound:
                fs.delete_file(m.path)


class _BatchAlerts(_Alerts, DataSourceWriter):
    def commit(self, messages) -> None:
        self.publish(messages, f"alerts-{uuid.uuid4().hex}")

    def abort(self, messages) -> None:
        self.forget(messages)


class _StreamAlerts(_Alerts, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:
        self.publish(messages, f"alerts-{batchId:09d}")

    def abort(self, messages, batchId) -> None:
        self.forget(messages)


class AlertSink(DataSource):
    """Alerts as JSON lines in folders, one a batch. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "alert_sink"

    def writer(self, schema, overwrite):
        return _BatchAlerts(self.options)

    def streamWriter(self, schema, overwrite):
        return _StreamAlerts(self.options)


def register(spark: SparkSession) -> None:
    """Make both known to a session by name."""
    send(spark)
    spark.dataSource.register(FeedPages)
    spark.dataSource.register(AlertSink)


def parsed(pages: DataFrame) -> DataFrame:
    """Pages as bars: sym, t and the prices of the payload."""
    row = F.from_json("payload", "t long, o double, h double, l double, c double, v double, tb double")
    return pages.select(F.col("symbol").alias("sym"), row.alias("r")).select("sym", "r.*")


def alerts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an alert sink has published; staged files are not seen."""
    return spark.read.schema(schema).json(f"{path}/alerts-*")
