"""A live source of lines: a Python data source that follows a growing file and keeps the lines that hold one of some words."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class KeywordLines(DataSource):
    """spark.dataSource.register(KeywordLines); spark.readStream.format("keyword_lines").option("path", file).option("words", "a,b").

    Options: path; words (comma-separated, all lines without it); seconds (lines that come later than so long after the
    start are not read); batch (bytes of one micro-batch at most, besides the end of a line). Columns value and seq, the
    place of the line's first byte. A reader on the driver follows one file; streams of many files use stream_lines.
    """

    @classmethod
    def name(cls) -> str:
        return "keyword_lines"

    def schema(self) -> str:
        return "value string, seq long"

    def simpleStreamReader(self, schema: StructType) -> KeywordReader:
        return KeywordReader(self.options)


class KeywordReader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.words = [w.strip().lower() for w in options.get("words", "").split(",") if w.strip()]
        self.until = time.time() + float(options["seconds"]) if "seconds" in options else None
        self.batch = int(options.get("batch", 1 << 20))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _lines(self, start: int, end: int | None) -> tuple[list[tuple[str, int]], int]:
        out, at = [], start
        if os.path.exists(self.path):
            with open(self.path, "rb") as f:
                f.seek(start)
                while (end is None and at - start < self.batch) or (end is not None and at < end):
                    line = f.readline()
                    if not line.endswith(b"\n"):  # a line still being written waits
                        break
                    text = line[:-1].decode("utf-8", "replace")
                    if not self.words or any(w in text.lower() for w in self.words):
                        out.append((text, at))
                    at += len(line)
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.until is not None and time.time() > self.until:
            return iter([]), start
        rows, at = self._lines(start["at"], None)
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start["at"], end["at"])[0])
