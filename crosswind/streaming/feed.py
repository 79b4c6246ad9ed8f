"""A streaming source of compact frames that replays from files, and runs that end when nothing comes any more.

A file of frames counts once it is there under its name; names sort in the order of their arrival.  The offset is the number of files read, so
that a stopped stream goes on from its checkpoint where it was.  Symbols are subscribed in chunks: each chunk is a partition that
reads the new files for its symbols.

Defined results: lines that are no frames, types without known fields and symbols that weren't asked for are left out; without symbols all are read
by one partition; values that don't fill a last event are left out; null values stay null.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

SCHEMA = "symbol string, type string, event map<string, string>, file string, line long, place int"


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


class Chunk(InputPartition):
    """New files, and the symbols that one partition reads of them; none for all."""

    def __init__(self, files: list[str], symbols: list[str]):
        self.files, self.symbols = files, symbols


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.fields = options["path"], json.loads(options["fields"])
        symbols, size = [s for s in options.get("symbols", "").split(",") if s], int(options.get("chunk", 100))
        self.chunks = [symbols[k : k + size] for k in range(0, len(symbols), size)] or [[]]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Chunk(_files(self.path)[start["files"] : end["files"]], own) for own in self.chunks]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        wanted = set(partition.symbols)
        for path in partition.files:
            with store.open_input_stream(path) as stream:
                for number, line in enumerate(stream.read().decode().splitlines()):
                    for place, (symbol, kind, event) in enumerate(events(line, self.fields)):
                        if not wanted or symbol in wanted:
                            yield symbol, kind, event, path.rsplit("/", 1)[-1], number, place

    def commit(self, end: dict) -> None:
        """Nothing to let go: files stay, as they are what a restart replays."""


def events(line: str, fields: dict[str, list[str]]) -> Iterator[tuple[str | None, str, dict]]:
    """(symbol, type, values) of a frame ``[type, [v1, ..., vN, ...]]``; the field ``symbol`` names the instrument."""
    try:
        kind, values = json.loads(line)
    except ValueError:
        return
    own = fields.get(kind) if isinstance(kind, str) else None
    if own and isinstance(values, list):
        for at in range(0, len(values) - len(own) + 1, len(own)):
            event = {f: None if v is None else str(v) for f, v in zip(own, values[at : at + len(own)])}
            yield event.get("symbol"), kind, event


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameReader(self.options)


def frames(spark: SparkSession, path: str, fields: dict[str, list[str]], symbols: Sequence[str] = (), chunk: int = 100) -> DataFrame:
    """A stream of events from a folder of frame files; ``path`` is a URI that driver and executors share."""
    spark.dataSource.register(Frames)
    return spark.readStream.format("frames").option("path", path).option("fields", json.dumps(fields)).option("symbols", ",".join(symbols)).option("chunk", chunk).load()


def until_quiet(writer: DataStreamWriter, idle: float, hard: float, look: float = 0.2) -> tuple[str, int]:
    """Runs a stream until no row has come for ``idle`` seconds, or ``hard`` seconds have passed; why it ended, and how many rows came."""
    query = writer.start()
    began = quiet = time.monotonic()
    seen, rows = -1, 0
    try:
        while query.isActive:
            for p in query.recentProgress:
                if p["batchId"] > seen and p["numInputRows"]:
                    seen, rows, quiet = p["batchId"], rows + p["numInputRows"], time.monotonic()
            now = time.monotonic()
            if now - began >= hard:
                return "hard", rows
            if now - quiet >= idle and not query.status["isTriggerActive"]:
                return "idle", rows
            time.sleep(look)
        if query.exception():
            raise query.exception()
        return "ended", rows
    finally:
        query.stop()
