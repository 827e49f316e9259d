"""Sums of large arrays over partitions: every partition cuts its array in pieces, and pieces meet on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim

PARTS = 16  #: pieces of an array


def pieces(x: np.ndarray) -> pa.RecordBatch:
    """An array as rows (part, v)."""
    own = np.array_split(x.ravel().astype("<f8"), PARTS)
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in own], pa.binary())], ["part", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("none")
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, v in zip(b.column("part").to_pylist(), b.column("v").to_pylist(), strict=True):
            x = np.frombuffer(v, "<f8")
            total[part] = total[part] + x if part in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "v"])


def summed(rows: DataFrame) -> DataFrame:
    """Rows (part, v) added up by part."""
    return rows.repartition(PARTS, "part").mapInArrow(_added, "part int, v binary")


def combined(rows: DataFrame, size: int) -> np.ndarray:
    """The whole array of summed rows; zeros without any row."""
    got: dict[int, np.ndarray] = {}
    for r in rows.collect():
        x = np.frombuffer(bytes(r["v"]), "<f8")
        got[r["part"]] = got[r["part"]] + x if r["part"] in got else x
    return np.concatenate([got[p] for p in range(PARTS)]) if got else np.zeros(size)
