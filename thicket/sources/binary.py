"""Binary sample, model and distance files as Spark data sources.

``register(spark)`` adds the formats ``forest_samples`` (header n, nlabels, nfeats; rows id, label,
features), ``forest_training`` (the same header; rows label, id, path cost, features),
``forest_model`` and ``forest_distances``. Records have a fixed width, so a file is read in
ranges of rows by many tasks; ``partition_rows`` sets their size. All numbers are 32-bit little
endian. ``write_*`` lay out one file, as these formats ask for, into which every task writes its own
rows at their offset; paths are local ones or those of a mounted folder that all executors share. A file shorter than its header says raises ValueError.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from thicket.plans.runtime import cut, numbered

_INT, _FLOAT = np.dtype("<i4"), np.dtype("<f4")


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    head = 12

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.step = int(options.get("partition_rows", 100_000))
        with open(self.path, "rb") as f:
            self.meta = np.frombuffer(f.read(self.head), _INT)
        self.n = int(self.meta[0])
        self.feats = int(self.meta[2]) if len(self.meta) > 2 else 0
        if os.path.getsize(self.path) < self.head + self.n * self.record().itemsize:
            raise ValueError(f"{self.path} is shorter than its header says")

    def record(self) -> np.dtype:
        raise NotImplementedError

    def partitions(self) -> list[_Range]:
        return [_Range(i, min(self.n, i + self.step)) for i in range(0, self.n, self.step)] or [_Range(0, 0)]

    def rows(self, part: _Range) -> np.ndarray:
        kind = self.record()
        with open(self.path, "rb") as f:
            f.seek(self.head + part.first * kind.itemsize)
            return np.frombuffer(f.read((part.last - part.first) * kind.itemsize), kind)


class _Samples(_Reader):
    def record(self) -> np.dtype:
        return np.dtype([("position", _INT), ("truelabel", _INT), ("feat", _FLOAT, (self.feats,))])

    def read(self, part: _Range) -> Iterator[tuple]:
        for r in self.rows(part):
            yield int(r["position"]), int(r["truelabel"]), r["feat"].tolist()


class _Training(_Reader):
    def record(self) -> np.dtype:
        return np.dtype([("truelabel", _INT), ("position", _INT), ("pathval", _FLOAT), ("feat", _FLOAT, (self.feats,))])

    def read(self, part: _Range) -> Iterator[tuple]:
        for r in self.rows(part):
            yield int(r["position"]), int(r["truelabel"]), float(r["pathval"]), r["feat"].tolist()


class _Model(_Reader):
    head = 28

    def record(self) -> np.dtype:
        return np.dtype([("position", _INT), ("truelabel", _INT), ("pred", _INT), ("label", _INT), ("pathval", _FLOAT), ("radius", _FLOAT), ("feat", _FLOAT, (self.feats,))])

    def read(self, part: _Range) -> Iterator[tuple]:
        start = self.head + self.n * self.record().itemsize
        order = np.fromfile(self.path, _INT, self.n, offset=start)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(1, self.n + 1)
        for i, r in enumerate(self.rows(part), part.first):
            pred = int(r["pred"])
            yield int(r["position"]), int(r["truelabel"]), None if pred < 0 else pred, int(r["label"]), float(r["pathval"]), float(r["radius"]), int(rank[i]), r["feat"].tolist()


class _Distances(_Reader):
    head = 4

    def record(self) -> np.dtype:
        return np.dtype([("d", _FLOAT, (self.n,))])

    def read(self, part: _Range) -> Iterator[tuple]:
        for i, r in enumerate(self.rows(part), part.first):
            for j, d in enumerate(r["d"].tolist()):
                yield i, j, d


def _source(title: str, columns: str, reader: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return reader(self.options)

    return Source


SOURCES = [
    _source("forest_samples", "position long, truelabel int, feat array<float>", _Samples),
    _source("forest_training", "position long, truelabel int, pathval double, feat array<float>", _Training),
    _source("forest_model", "position long, truelabel int, pred long, label int, pathval double, radius double, rank int, feat array<float>", _Model),
    _source("forest_distances", "i long, j long, d float", _Distances),
]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


def header(path: str) -> dict[str, int]:
    """Rows, labels and features from the header alone."""
    n, labels, feats = np.fromfile(path, _INT, 3)
    return {"nnodes": int(n), "nlabels": int(labels), "nfeats": int(feats)}


def model_header(path: str) -> dict[str, float]:
    """The header of a model file with its density parameters."""
    df, k, low, high = np.fromfile(path, _FLOAT, 4, offset=12)
    return header(path) | {"df": float(df), "kscale": float(k), "mindens": float(low), "maxdens": float(high)}


def _size(df: DataFrame) -> tuple[int, int, int]:
    from thicket.operators.prepare import info

    r = info(df).first()
    return r.nnodes, r.nlabels, r.nfeats


def _write(df: DataFrame, path: str, head: bytes, kind: np.dtype, cols: list[str]) -> DataFrame:
    """Records in order of position, each task writing its own stretch of the file at its offset.

    The folder of ``path`` must be one that all executors share. Returns the rows with their number ``row``.
    """
    rows = cut(numbered(df.select(*cols), "row", F.col("position"), start=0))
    n = rows.count()
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + n * kind.itemsize)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("row")
            out = np.zeros(len(b), kind)
            for c in kind.names:
                v = b[c]
                out[c] = np.stack(v.to_numpy()) if c == "feat" and len(b) else v.fillna(-1 if c == "pred" else 0).to_numpy()
            at = b["row"].to_numpy()
            with open(path, "r+b") as f:
                for lo, hi in zip(*(np.flatnonzero(np.diff(at, **end) != 1) for end in ({"prepend": -9}, {"append": -9}))):
                    f.seek(len(head) + int(at[lo]) * kind.itemsize)
                    f.write(out[lo : hi + 1].tobytes())
            yield pd.DataFrame({"n": [len(b)]})

    rows.mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return rows


def write_samples(df: DataFrame, path: str) -> None:
    n, labels, feats = _size(df)
    kind = np.dtype([("position", _INT), ("truelabel", _INT), ("feat", _FLOAT, (feats,))])
    _write(df, path, np.array([n, labels, feats], _INT).tobytes(), kind, ["position", "truelabel", "feat"])


def write_training(df: DataFrame, path: str) -> None:
    n, labels, feats = _size(df)
    kind = np.dtype([("truelabel", _INT), ("position", _INT), ("pathval", _FLOAT), ("feat", _FLOAT, (feats,))])
    _write(df, path, np.array([n, labels, feats], _INT).tobytes(), kind, ["position", "truelabel", "pathval", "feat"])


def write_model(df: DataFrame, path: str, width: float = 0.0, kscale: float = 0.0, low: float = 0.0, high: float = 0.0) -> None:
    """Rows in order of position; the conquest order follows as row numbers."""
    n, labels, feats = _size(df)
    kind = np.dtype([("position", _INT), ("truelabel", _INT), ("pred", _INT), ("label", _INT), ("pathval", _FLOAT), ("radius", _FLOAT), ("feat", _FLOAT, (feats,))])
    full = df if "radius" in df.columns else df.withColumn("radius", F.lit(0.0))
    head = np.array([n, labels, feats], _INT).tobytes() + np.array([width, kscale, low, high], _FLOAT).tobytes()
    rows = _write(full, path, head, kind, [*kind.names, "rank"])
    start = len(head) + n * kind.itemsize
    with open(path, "r+b") as f:
        f.truncate(start + 4 * n)
    ordered = rows.select("rank", "row")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("rank")
            at = b["rank"].to_numpy() - 1
            with open(path, "r+b") as f:
                for lo, hi in zip(*(np.flatnonzero(np.diff(at, **end) != 1) for end in ({"prepend": -9}, {"append": -9}))):
                    f.seek(start + 4 * int(at[lo]))
                    f.write(b["row"].to_numpy(_INT)[lo : hi + 1].tobytes())
            yield pd.DataFrame({"n": [len(b)]})

    ordered.repartitionByRange("rank").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def write_distances(pairs: DataFrame, n: int, path: str) -> None:
    """Positions must be 0 to n - 1; a task writes whole rows of the matrix."""
    with open(path, "wb") as f:
        f.write(np.array([n], _INT).tobytes())
        f.truncate(4 + 4 * n * n)

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(n, _FLOAT)
        row[pdf.j.to_numpy()] = pdf.d.to_numpy()
        with open(path, "r+b") as f:
            f.seek(4 + 4 * n * int(pdf.i.iloc[0]))
            f.write(row.tobytes())
        return pd.DataFrame({"n": [len(pdf)]})

    pairs.select("i", "j", "d").groupBy("i").applyInPandas(put, "n long").agg(F.sum("n")).collect()
