"""The change feed as a streaming source: its offsets are entries of a store's manifest.

A batch is seen once its entry is there, so a job that broke off gives nothing; folders that a
compaction or an excision wrote anew hold no news and give nothing twice. A feed that starts after
a compaction begins with the compacted batch. Files are read where the executors are, by the file
systems that pyarrow knows (local and mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from factloom.model import FACT_SCHEMA

# executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
NAME = "fact_feed"
_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACT_SCHEMA.fields)


@dataclass
class Piece(InputPartition):
    """A file of facts of one attribute."""

    file: str
    attribute: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class FeedReader(DataSourceStreamReader):
    """Entries of the manifest as offsets; facts of what each brought as rows."""

    def __init__(self, path: str, attributes: list[int] | None, most: int | None) -> None:
        self.path, self.attributes, self.most = path, attributes, most
        self.told: int | None = None

    def _entries(self) -> list[dict]:
        fs, where = _opened(f"{self.path}/manifest")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if f.path.endswith(".json")]
        out = []
        for file in sorted(files):
            with fs.open_input_stream(file) as f:
                out.append(json.loads(f.read()))
        return out

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        last = max((e["n"] for e in self._entries()), default=0)
        if self.most is not None:
            last = min(last, (self.told or 0) + self.most)
        self.told = last
        return {"entry": last}

    def folders(self, start: int, end: int) -> list[str]:
        """The folders of facts that are new after the entry `start` and up to `end`."""
        found, first = [e for e in self._entries() if e["n"] <= end], start
        out: list[str] = []
        if start == 0:
            compacted = [e for e in found if e["kind"] == "compact"]
            if compacted:
                first = compacted[-1]["n"]
                out = [f for f in self._live(found, first) if f.startswith("fact/")]
        out += [f for e in found if e["n"] > first for f in e["news"]]
        # an excision put what is left of a folder in its place, with the same batch number
        gone = {f for e in found for f in e["removed"] if e["kind"] in ("excise", "facts")}
        put = {f.split("/batch=")[1]: f for e in found if e["kind"] in ("excise", "facts") for f in e["added"] if f.startswith("fact/")}
        return list(dict.fromkeys(put[f.split("/batch=")[1]] if f in gone else f for f in out))

    @staticmethod
    def _live(found: list[dict], n: int) -> list[str]:
        live: dict[str, None] = {}
        for e in found:
            if e["n"] <= n:
                for f in e["removed"]:
                    live.pop(f, None)
                live.update(dict.fromkeys(e["added"]))
        return list(live)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.told = max(self.told or 0, end["entry"])
        fs, root = _opened(self.path)
        out = []
        for folder in self.folders(start["entry"], end["entry"]):
            for f in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}", recursive=True)):
                if f.path.endswith(".parquet"):
                    a = int(f.path.rsplit("/a=", 1)[1].split("/")[0])
                    if self.attributes is None or a in self.attributes:
                        out.append(Piece(f.path, a))
        # the engine wants a partition even where there is nothing new
        return out or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _opened(self.path)
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches():
                columns = {}
                for name in FACT_SCHEMA.fieldNames():
                    if name == "a":
                        columns[name] = pa.array([partition.attribute] * batch.num_rows, pa.int64())
                    else:
                        column = batch.column(name)
                        columns[name] = column.cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(column.type) else column
                yield pa.record_batch(columns)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """`spark.readStream.format("fact_feed").load(path)`; options `attributes` (ids, by commas) and `entriesPerTrigger`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> FeedReader:
        wanted, most = self.options.get("attributes"), self.options.get("entriesPerTrigger")
        return FeedReader(self.options["path"], None if wanted is None else [int(a) for a in wanted.split(",")], None if most is None else int(most))


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known to it."""
    spark.dataSource.register(FeedSource)
    return spark
