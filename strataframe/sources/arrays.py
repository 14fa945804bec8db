"""NumPy files as DataFrames: Spark reads the bytes, each task decodes its own files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, name string, at array<long>, value double"


def read_arrays(spark: SparkSession, path: str, batch: int = 1 << 16) -> DataFrame:
    """``path, name, at, value``: a row for each element of the ``.npy`` and ``.npz`` files below a path, with its place along
    each axis; ``name`` is the member of an archive, null otherwise. Numbers only; object arrays are refused."""

    def decode(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for name, a in ([(None, got)] if isinstance(got, np.ndarray) else got.items()):
                    for lo in range(0, a.size, batch):
                        flat = np.arange(lo, min(lo + batch, a.size))
                        at = np.stack(np.unravel_index(flat, a.shape), 1) if a.ndim else np.zeros((len(flat), 0), int)
                        yield pd.DataFrame({"path": where, "name": name, "at": list(at), "value": a.reshape(-1)[flat].astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(decode, SCHEMA)
