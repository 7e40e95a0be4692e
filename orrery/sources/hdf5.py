"""Datasets of HDF5 files, where the h5py library is installed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    import h5py
except ImportError:  # optional
    h5py = None


def _arrays(data: bytes, wanted: list[tuple[str, int | None]]) -> list[np.ndarray]:
    with h5py.File(io.BytesIO(data), "r") as f:
        out = []
        for name, index in wanted:
            values = f[name][()]
            if values.ndim not in (1, 2):
                raise ValueError(f"{name} has {values.ndim} dimensions")
            if values.ndim == 2:  # rows run along the longer side
                values = values if values.shape[0] >= values.shape[1] else values.T
                values = values[:, (index or 1) - 1]
            out.append(np.array([v.decode() if isinstance(v, bytes) else v for v in values]) if values.dtype.kind in "SO" else values)
        if len({len(v) for v in out}) > 1:
            raise ValueError("the datasets differ in length")
        return out


def read_hdf5(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Datasets as columns c1, c2, ...; `name(i)` is the i-th column of a two-dimensional dataset."""
    if h5py is None:
        raise ImportError("HDF5 catalogues need the h5py library")
    wanted = [(c[: c.index("(")], int(c[c.index("(") + 1 : -1])) if c.endswith(")") else (c, None) for c in columns]
    kinds = {"i": "bigint", "u": "bigint", "f": "double", "U": "string", "S": "string"}
    files = spark.read.format("binaryFile").load(path)
    first = _arrays(bytes(files.select("content").limit(1).collect()[0][0]), wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = _arrays(data.as_py(), wanted)
                kind = {"i": np.int64, "u": np.int64, "f": np.float64}
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(kind[v.dtype.kind]) if v.dtype.kind in kind else v.tolist()) for v in found], [f"c{n + 1}" for n in range(len(found))])

    return files.select("content").mapInArrow(read, ", ".join(f"c{n + 1} {kinds[v.dtype.kind]}" for n, v in enumerate(first)))
