"""Arrays that every task has summed over its own rows, added up across tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: What a task yields: ``v`` is its sum for ``row``; ``part`` spreads the tasks.
PARTIAL = "row bigint, part bigint, v array<double>"
GATHERED = 16  # places in which the sums of many tasks meet first


def partial_sums(rows: np.ndarray) -> pa.RecordBatch:
    """One task's sums, a matrix, as rows of ``PARTIAL``."""
    context = TaskContext.get()
    part = context.partitionId() % GATHERED if context else 0
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows)), pa.int64()), pa.array([part] * len(rows), pa.int64()), listed(rows)],
        ["row", "part", "v"],
    )


def listed(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def added(parts: DataFrame) -> np.ndarray:
    """The sums over all tasks, a matrix; the driver gets one array a row."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column("v")
            for i, row in enumerate(batch.column("row").to_pylist()):
                v = column[i].values.to_numpy(zero_copy_only=False)
                sums[row] = sums[row] + v if row in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), listed(np.stack(list(sums.values())))], ["row", "v"]
            )

    by_part = parts.repartition("row", "part").mapInArrow(add, "row bigint, v array<double>")
    whole = by_part.repartition("row").mapInArrow(add, "row bigint, v array<double>").collect()
    return np.array([r["v"] for r in sorted(whole, key=lambda r: r["row"])])
