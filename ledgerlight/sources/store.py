"""Data sets on disk: one folder each, a subfolder a version, the model beside the rows.

A version counts only once its marker is written, after everything else; readers take the latest
marked version, so they never see half of one, and a failed job leaves the former version in force.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.plans.build import build
from ledgerlight.plans.model import Claim, Model


@dataclass
class Dataset:
    id: str
    version: int
    rows: DataFrame
    model: Model


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, at: str, text: str) -> None:
        out = self.fs.create(self.path(at), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, at: str) -> str:
        stream = self.fs.open(self.path(at))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _names(self, at: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(at))] if self.fs.exists(self.path(at)) else []

    def versions(self, dataset: str) -> list[int]:
        """Whole versions, the latest last."""
        found = [int(n[2:]) for n in self._names(f"{self.root}/{dataset}") if n.startswith("v=")]
        return sorted(v for v in found if self.fs.exists(self.path(f"{self.root}/{dataset}/v={v}/READY")))

    def ids(self) -> list[str]:
        return sorted(n for n in self._names(self.root) if self.versions(n))

    def put(self, dataset: str, df: DataFrame, claims: list[Claim] | None = None, provider: Callable[[dict], Any] | None = None, at: Callable[[str], None] = lambda stage: None) -> Dataset:
        """Writes rows, builds the model from what was written, and promotes both; on an error nothing stays."""
        version = max([int(n[2:]) for n in self._names(f"{self.root}/{dataset}") if n.startswith("v=")], default=0) + 1
        folder = f"{self.root}/{dataset}/v={version}"
        try:
            at("loading")
            df.write.mode("error").parquet(f"{folder}/rows")
            rows = self.spark.read.parquet(f"{folder}/rows")
            at("profiling")
            model = build(rows, dataset, claims, provider)
            at("promoting")
            self._write(f"{folder}/model.json", model.to_json())
            self._write(f"{folder}/READY", "")
        except BaseException:
            self.fs.delete(self.path(folder), True)
            raise
        return Dataset(dataset, version, rows, model)

    def get(self, dataset: str) -> Dataset:
        """The latest version. A model of an earlier format, or one that doesn't belong to the rows, is derived again
        from the claims that it was built from, so that declared and provided roles stay, and written in its place."""
        versions = self.versions(dataset)
        if not versions:
            raise KeyError(dataset)
        folder = f"{self.root}/{dataset}/v={versions[-1]}"
        rows = self.spark.read.parquet(f"{folder}/rows")
        model = Model.from_json(self._read(f"{folder}/model.json"))
        if model.lacking or set(model.types) != set(rows.columns) or model.row_count != rows.count():
            model = build(rows, dataset, model.claims)
            self._write(f"{folder}/model.json", model.to_json())
        return Dataset(dataset, versions[-1], rows, model)

    def prune(self, dataset: str, keep: int = 2) -> None:
        for v in self.versions(dataset)[:-keep]:
            self.fs.delete(self.path(f"{self.root}/{dataset}/v={v}"), True)
