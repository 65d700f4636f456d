"""One GeoJSON collection in one file, written by many tasks.

Records are dealt by ranges of their numbers; each task writes its features to a part of its own, and the commit puts header,
parts in order and footer together, some bytes at a time, so no task and no driver holds the document.  The file appears under its name only
when it is whole; a failed write leaves none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from terrane.sources import files, geojson

HEADER, FOOTER = b'{"type":"FeatureCollection","features":[', b"]}"


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its place among all, its file, and whether it holds any feature."""

    place: int
    path: str
    any: bool


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        path = f"{self.path}.parts-{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        some = False
        with files.output(path) as out:
            for batch in iterator:
                for feature in batch.column("feature"):
                    out.write((b"," if some else b"") + feature.as_py().encode())
                    some = True
        return Part(task.partitionId(), path, some)

    def commit(self, messages: list[Part | None]) -> None:
        whole = f"{self.path}.parts-{self.run}/whole"
        with files.output(whole) as out:
            out.write(HEADER)
            for k, part in enumerate(sorted((m for m in messages if m and m.any), key=lambda m: m.place)):
                out.write(b"," if k else b"")
                for piece in files.pieces(part.path):
                    out.write(piece)
            out.write(FOOTER)
        files.move(whole, self.path)
        files.remove_folder(f"{self.path}.parts-{self.run}")

    def abort(self, messages: list[Part | None]) -> None:
        files.remove_folder(f"{self.path}.parts-{self.run}")


class Collection(DataSource):
    """The sink of write_collection(): rows of one column, feature."""

    @classmethod
    def name(cls) -> str:
        return "geojson-collection"

    def schema(self) -> str:
        return "feature string"

    def writer(self, schema, overwrite: bool) -> Writer:
        if not overwrite and files.is_there(self.options["path"]):
            raise FileExistsError(self.options["path"])
        return Writer(self.options["path"])


def write_collection(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes records to one file, in order of their numbers, those of equal numbers by their paths where there are such."""
    df.sparkSession.dataSource.register(Collection)
    order = ["record_number", *(["path"] if "path" in df.columns else [])]
    rows = df.select(*order, geojson.feature(F.col("geometry"), F.col("attributes")).alias("feature"))
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("feature")
    sorted_.write.format("geojson-collection").mode("overwrite" if overwrite else "append").save(path)
