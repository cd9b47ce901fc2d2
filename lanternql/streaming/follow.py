"""Follow mode: new rows of a folder, or of one growing file, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery


class GrowingFile(DataSource):
    """Lines of one file as they are appended; options: path, and tail=<n> to begin with its
    last n lines (true: at its end).

    The file is read on the driver, so it must be one the driver sees.
    """

    @classmethod
    def name(cls):
        return "growing_file"

    def schema(self):
        return "value string"

    def simpleStreamReader(self, schema):
        tail = self.options.get("tail", "false").lower()
        return GrowingFileReader(self.options["path"], {"true": 0, "false": None}[tail] if tail in ("true", "false") else int(tail))


class GrowingFileReader(SimpleDataSourceStreamReader):
    MOST = 16 << 20

    def __init__(self, path: str, tail: int | None):
        self.path, self.tail = path, tail

    def initialOffset(self):
        return {"byte": 0 if self.tail is None else self.start_of_last(self.tail)}

    def start_of_last(self, n: int) -> int:
        """Where the last n whole lines begin, found from the end in blocks."""
        with open(self.path, "rb") as f:
            at = f.seek(0, 2)
            ends = 0
            while at > 0:
                size = min(1 << 16, at)
                at -= size
                f.seek(at)
                block = f.read(size)
                while (i := block.rfind(b"\n")) >= 0:
                    ends += 1
                    if ends > n:
                        return at + i + 1
                    block = block[:i]
        return 0

    def lines(self, start: int, end: int | None):
        with open(self.path, "rb") as f:
            f.seek(start)
            data = f.read(self.MOST if end is None else end - start)
        whole = data.rfind(b"\n") + 1  # a line without its end waits for it
        return [(x.decode("utf-8", "replace"),) for x in data[:whole].splitlines()], start + whole

    def read(self, start):
        rows, at = self.lines(start["byte"], None)
        return iter(rows), {"byte": at}

    def readBetweenOffsets(self, start, end):
        return iter(self.lines(start["byte"], end["byte"])[0])


def follow_folder(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "csv", **options) -> DataFrame:
    """Files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(folder)


def follow_file(spark: SparkSession, path: str, tail: bool | int = False) -> DataFrame:
    """tail: begin at the end, or with the last so many lines."""
    spark.dataSource.register(GrowingFile)
    return spark.readStream.format("growing_file").option("path", path).option("tail", str(tail).lower()).load()


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Append each batch to ``sink``; the checkpoint folder must be shared on a cluster."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
