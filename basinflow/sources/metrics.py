"""A table of metric rows that survives repeats: a run's rows are there once, however often it is written.

Tasks write part files of their own and tell the driver which; the commit writes one manifest for the run, and
only what manifests name is read.  A retried or speculative task leaves a part that no manifest names, a run
that is written again replaces its manifest, and a failed one leaves none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from basinflow.sources.shared import arrow_folder

SCHEMA = "run string, metric string, value double"


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: a file under the table's folder, or nothing."""

    file: str | None


@dataclass
class Named(InputPartition):
    run: str
    file: str


class MetricWriter(DataSourceWriter):
    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path, run

    def write(self, iterator: Iterator) -> Part:
        rows = [(r["metric"], r["value"]) for r in iterator]
        if not rows:
            return Part(None)
        system, folder = arrow_folder(self.path)
        name = f"parts/{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{folder}/parts", recursive=True)
        metrics, values = zip(*rows, strict=True)
        pq.write_table(pa.table({"metric": pa.array(metrics, pa.string()), "value": pa.array(values, pa.float64())}), f"{folder}/{name}", filesystem=system)
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        """The manifest is written beside its place and moved there, so readers see the old one or the new one."""
        system, folder = arrow_folder(self.path)
        system.create_dir(f"{folder}/runs", recursive=True)
        target = f"{folder}/runs/{quote(self.run, safe='')}.json"
        aside = f"{folder}/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(aside) as out:
            out.write(json.dumps({"run": self.run, "files": [m.file for m in messages if m and m.file]}).encode())
        system.move(aside, target)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = arrow_folder(self.path)
        for message in messages:
            if message and message.file:
                system.delete_file(f"{folder}/{message.file}")


class MetricReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Named]:
        system, folder = arrow_folder(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(f"{folder}/runs", allow_not_found=True)):
            with system.open_input_stream(info.path) as source:
                manifest = json.loads(source.read())
            found += [Named(manifest["run"], f) for f in manifest["files"]]
        return sorted(found, key=lambda p: (p.run, p.file)) or [Named("", "")]

    def read(self, partition: Named) -> Iterator[pa.RecordBatch]:
        if partition.file:
            system, folder = arrow_folder(self.path)
            for batch in pq.read_table(f"{folder}/{partition.file}", filesystem=system).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([partition.run] * batch.num_rows), *batch.columns], names=["run", "metric", "value"])


class MetricTable(DataSource):
    """Format ``metric_rows`` with the options ``path`` and, to write, ``run``."""

    @classmethod
    def name(cls) -> str:
        return "metric_rows"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> MetricWriter:
        return MetricWriter(self.options["path"], self.options["run"])

    def reader(self, schema) -> MetricReader:
        return MetricReader(self.options["path"])


def write_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Make ``metrics(metric, value)`` the rows of a run in the table at ``path``; other columns are left out."""
    metrics.sparkSession.dataSource.register(MetricTable)
    rows = metrics.selectExpr("cast(NULL as string) AS run", "metric", "value")
    rows.write.format("metric_rows").mode("append").option("run", run).option("path", path).save()


def read_metrics(spark, path: str) -> DataFrame:
    """``run, metric, value`` of all runs that were written whole."""
    spark.dataSource.register(MetricTable)
    return spark.read.format("metric_rows").option("path", path).load()
