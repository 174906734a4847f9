"""File sources and sinks."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: The contract of an event log for spark.read.schema(...).
EVENT_SCHEMA = (
    "event_id bigint, ts bigint, kind string, g bigint, p bigint, m bigint, stack_id bigint, "
    "trans struct<res_kind:string,res_id:bigint,from_state:string,to_state:string,reason:string,stack_id:bigint>"
)

#: The whole contract: an event log with all kinds of records.
RECORD_SCHEMA = (
    EVENT_SCHEMA + ", range struct<name:string,scope_kind:string,scope_id:bigint,attrs:map<string,bigint>>, task struct<id:bigint,parent:bigint,type:string>, "
    "log struct<task:bigint,category:string,message:string>, metric struct<name:string,value:bigint>"
)


def read_events(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """An event log from Parquet, ORC or JSON; the schema is given, not inferred."""
    return spark.read.format(kind).schema(EVENT_SCHEMA).load(path)


def write_statistics_csv(stats: DataFrame, path: str) -> None:
    """The statistics table as CSV with a header, in its own order."""
    stats.coalesce(1).write.mode("overwrite").csv(path, header=True)


class TraceHeaderSource(DataSource):
    """Headers of binary traces, one row a file: path, version, size, and what is wrong.

    The records' format belongs to a library that is not public API here; the
    source tells versions and truncated files apart without reading further.
    """

    @classmethod
    def name(cls) -> str:
        return "trace_header"

    def schema(self) -> str:
        return "path string, version string, n_bytes bigint, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeaderReader(self.options.get("path", ""))


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        root = Path(self.path)
        files = sorted(p for p in root.rglob("*") if p.is_file()) if root.is_dir() else [root]
        return [InputPartition(str(p)) for p in files]

    def read(self, partition):
        data = Path(partition.value).read_bytes()
        try:
            (head,) = struct.unpack("16s", data[:16])
        except struct.error:
            yield (partition.value, None, len(data), "shorter than a header")
            return
        text = head.rstrip(b"\0 ").decode("ascii", "replace")
        ok = text.startswith("go 1.") and text.endswith(" trace")
        yield (partition.value, text[3:-6] if ok else None, len(data), None if ok else "not a trace")
