"""Subtitle files as a Spark data source: spark.read.format("srt").load(path)."""

from __future__ import annotations

import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TIME = re.compile(r"(\d+):(\d+):(\d+),(\d+)")


def seconds(stamp: str) -> float:
    m = _TIME.fullmatch(stamp.strip())
    if not m:
        raise ValueError(f"malformed time stamp: {stamp}")
    h, mi, s, ms = map(int, m.groups())
    return (((h * 60 + mi) * 60 + s) * 1000 + ms) / 1000


def blocks(text: str):
    """(ord, start, end, text) of a subtitle file."""
    for k, block in enumerate(re.split(r"\n\s*\n", re.sub(r"\r\n?", "\n", text).strip())):
        lines = block.strip().split("\n")
        if len(lines) >= 2 and " --> " in lines[1]:
            a, b = lines[1].split(" --> ")[:2]
            yield k, seconds(a), seconds(b), "\n".join(lines[2:]).strip()


class File(InputPartition):
    def __init__(self, address: str):
        self.address = address


class SrtReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        head = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else "file://"
        info = fs.get_file_info(base)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        return [File((head or "file://") + f.path) for f in found if f.is_file and f.path.endswith(".srt")]

    def read(self, partition):
        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(partition.address)
        with fs.open_input_stream(path) as f:
            for k, a, b, text in blocks(f.read().decode("utf-8-sig")):
                yield partition.address, k, a, b, text


class SrtDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "path string, ord long, start double, end double, text string"

    def reader(self, schema) -> SrtReader:
        return SrtReader(self.options["path"])
