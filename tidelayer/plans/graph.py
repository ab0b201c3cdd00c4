"""A graph of datasets: what each reads is inferred, checked without writing, and run in order.

A dataset is a plain function `(read) -> DataFrame`, or SQL with `{upstream}` placeholders. Calling
it yields an unexecuted plan; `read(name)` inside it both gives the upstream and records the edge.
Spark analyses the plan while it is built, so a dry run is: build everything, execute nothing.
"""

from __future__ import annotations

import datetime as dt
import string
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelayer.streaming.sinks import append_files

Reader = Callable[[str], DataFrame]
REPORT = "dataset STRING, layer STRING, kind STRING, reads ARRAY<STRING>, status STRING, n_rows BIGINT, message STRING"


class MissingUpstream(LookupError):
    """A dataset reads a name that no dataset has."""


@dataclass(frozen=True)
class Dataset:
    name: str
    layer: str
    build: Callable[[Reader], DataFrame]
    kind: str = "view"  # view: recomputed by each run; stream: takes what is new since the last run
    comment: str = ""
    source: Callable[[], DataFrame] | None = None  # stream only: the stream that `build` starts from


def sql_dataset(spark: SparkSession, text: str) -> Callable[[Reader], DataFrame]:
    """SQL whose `{name}` placeholders are its upstream datasets."""
    names = {field for _, field, _, _ in string.Formatter().parse(text) if field}
    return lambda read: spark.sql(text, **{name: read(name) for name in sorted(names)})


class Graph:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.datasets: dict[str, Dataset] = {}

    # -- registration -------------------------------------------------------------------------
    def add(self, dataset: Dataset) -> Dataset:
        if dataset.name in self.datasets:
            raise ValueError(f"dataset {dataset.name} is registered twice")
        self.datasets[dataset.name] = dataset
        return dataset

    def view(self, name: str, layer: str, comment: str = ""):
        """Decorator: a dataset that every run recomputes."""

        def register(build: Callable[[Reader], DataFrame]):
            self.add(Dataset(name, layer, build, "view", comment))
            return build

        return register

    def stream(self, name: str, layer: str, source: Callable[[], DataFrame], comment: str = ""):
        """Decorator: an append-only dataset; its function maps the source stream, `(stream) -> DataFrame`."""

        def register(build: Callable[[DataFrame], DataFrame]):
            self.add(Dataset(name, layer, lambda read: build(source()), "stream", comment, source))
            return build

        return register

    def sql(self, name: str, layer: str, text: str, comment: str = "") -> Dataset:
        return self.add(Dataset(name, layer, sql_dataset(self.spark, text), "view", comment))

    def sql_files(self, folder: str, layer: str) -> list[Dataset]:
        """One dataset per .sql file, named like the file."""
        return [self.sql(path.stem, layer, path.read_text()) for path in sorted(Path(folder).glob("*.sql"))]

    # -- analysis -----------------------------------------------------------------------------
    def reads(self) -> tuple[dict[str, list[str]], dict[str, Exception]]:
        """Per dataset what it reads, and per dataset that cannot be analysed why. Executes nothing."""
        edges: dict[str, list[str]] = {}
        plans: dict[str, DataFrame] = {}
        errors: dict[str, Exception] = {}

        def build(name: str, path: tuple[str, ...]) -> DataFrame:
            if name in path:
                raise CycleError(f"datasets read each other: {' -> '.join([*path, name])}")
            if name in plans:
                return plans[name]
            if name in errors:
                raise errors[name]
            if name not in self.datasets:
                raise MissingUpstream(f"{path[-1] if path else name} reads {name}, which no dataset has")
            edges[name] = []

            def read(upstream: str) -> DataFrame:
                edges[name].append(upstream)
                plan = build(upstream, (*path, name))
                # Upstreams are empty and of the right schema: size checks inside a dataset read nothing.
                # A stream is read downstream as the table it leaves.
                return self.spark.createDataFrame([], plan.schema) if plan.isStreaming else plan.limit(0)

            try:
                plans[name] = self.datasets[name].build(read)
            except (AnalysisException, MissingUpstream, CycleError) as error:
                errors[name] = error
                raise
            return plans[name]

        for name in self.datasets:
            try:
                build(name, ())
            except (AnalysisException, MissingUpstream, CycleError) as error:
                errors.setdefault(name, error)
        return {name: list(dict.fromkeys(found)) for name, found in edges.items()}, errors

    def order(self) -> list[str]:
        """Datasets with upstreams first. Raises the first analysis error there is."""
        return list(self._ordered())

    def _ordered(self) -> dict[str, list[str]]:
        """What each dataset reads, upstreams first."""
        edges, errors = self.reads()
        for error in errors.values():
            raise error
        return {name: edges[name] for name in TopologicalSorter(edges).static_order()}

    def dry_run(self) -> DataFrame:
        """One row per dataset: what it reads and whether it can be analysed. Writes nothing."""
        edges, errors = self.reads()
        rows = [
            (
                name,
                dataset.layer,
                dataset.kind,
                edges.get(name, []),
                "failed" if name in errors else "valid",
                None,
                str(errors[name]).splitlines()[0] if name in errors else None,
            )
            for name, dataset in self.datasets.items()
        ]
        return self.spark.createDataFrame(rows, REPORT)

    # -- execution ----------------------------------------------------------------------------
    def run(self, root: str, only: Iterable[str] | None = None) -> DataFrame:
        """Materialises the datasets below `root` and reports rows and status per dataset.

        Downstream datasets read the written table, so no plan spans two datasets and a lost executor costs one dataset's
        tasks. A view is written to a folder of this run, and readers are switched to it once it is whole; a stream adds what
        is new, from its checkpoint. A dataset whose job fails is reported as failed with the message, those that read it as
        skipped, and their old tables stay; all others run. Running again is safe. A full refresh is a run with a new root.
        """
        wanted = set(only) if only else set(self.datasets)
        run_id = uuid.uuid4().hex
        rows, missing = [], set()
        for name, reads in self._ordered().items():
            if name not in wanted:
                continue
            dataset = self.datasets[name]
            if lost := [upstream for upstream in reads if upstream in missing]:
                missing.add(name)
                rows.append((name, dataset.layer, dataset.kind, reads, "skipped", None, f"{', '.join(lost)} did not complete"))
                continue
            try:
                n_rows = self._materialise(root, dataset, run_id)
            except (PySparkException, Py4JJavaError) as error:
                missing.add(name)
                rows.append((name, dataset.layer, dataset.kind, reads, "failed", None, str(error).strip().splitlines()[0]))
                continue
            rows.append((name, dataset.layer, dataset.kind, reads, "completed", n_rows, None))
        return self.spark.createDataFrame(rows, REPORT)

    def _materialise(self, root: str, dataset: Dataset, run_id: str) -> int:
        plan = dataset.build(lambda upstream: self.table(root, upstream))
        if dataset.kind == "stream":
            append_files(plan, self.path(root, dataset.name), f"{root}/_checkpoints/{dataset.name}")
            return self.table(root, dataset.name).count()
        counted = Observation()
        plan.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path(root, dataset.name)}/{run_id}")
        current = [(run_id, dt.datetime.now())]
        switch = self.spark.createDataFrame(current, "run STRING, at TIMESTAMP").coalesce(1)
        switch.write.mode("append").parquet(f"{root}/_current/{dataset.name}")
        return counted.get["n"]

    def path(self, root: str, name: str) -> str:
        return f"{root}/{self.datasets[name].layer}/{name}"

    def table(self, root: str, name: str) -> DataFrame:
        if name not in self.datasets:
            raise MissingUpstream(f"no dataset is named {name}")
        if self.datasets[name].kind == "stream":
            return self.spark.read.parquet(self.path(root, name))
        last = self.spark.read.schema("run STRING, at TIMESTAMP").parquet(f"{root}/_current/{name}").orderBy(F.desc("at")).first()
        return self.spark.read.parquet(f"{self.path(root, name)}/{last['run']}")

    def preview(self, root: str, name: str, n: int = 10) -> DataFrame:
        return self.table(root, name).limit(n)

    def layers(self) -> DataFrame:
        """layer, dataset, kind, comment."""
        rows = [(d.layer, d.name, d.kind, d.comment) for d in self.datasets.values()]
        return self.spark.createDataFrame(rows, "layer STRING, dataset STRING, kind STRING, comment STRING")
