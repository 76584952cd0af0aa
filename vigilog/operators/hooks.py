"""User functions over logs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

LOG = logging.getLogger(__name__)

Hook = Callable[[DataFrame], DataFrame | None]


def run_log_hooks(logs: DataFrame, hooks: Sequence[Hook]) -> DataFrame:
    """Pass the logs through each hook in turn.

    A hook may return other rows or columns, or nothing to leave the logs as they
    are. A hook that fails is skipped.
    """
    for hook in hooks:
        try:
            changed = hook(logs)
        except (AnalysisException, KeyError, TypeError, ValueError) as error:
            LOG.warning("log hook %s skipped: %s", getattr(hook, "__name__", hook), error)
            continue
        if changed is not None:
            logs = changed
    return logs


def _fitting(new: dict, old: dict, schema: pa.Schema, failed: list) -> dict:
    try:
        pa.RecordBatch.from_pylist([new], schema)
    except (pa.ArrowException, TypeError, ValueError, OverflowError) as error:
        failed.append(error)
        return old
    return new


def record_hook(change: Callable[[dict], dict | None]) -> Hook:
    """A hook that changes one record at a time; one it fails on stays as it is.

    ``change`` takes the record's columns by name and returns those that change, or
    nothing. Its columns keep their types.
    """

    def hook(logs: DataFrame) -> DataFrame:
        columns = logs.columns

        def run(batches):
            for batch in batches:
                rows, out, failed = batch.to_pylist(), [], []
                for row in rows:
                    try:
                        changed = change(dict(row)) or {}
                        out.append({**row, **{c: v for c, v in changed.items() if c in columns}})
                    except Exception as error:  # whatever a user's function raises
                        failed.append(error)
                        out.append(row)
                try:
                    made = pa.RecordBatch.from_pylist(out, batch.schema)
                except (pa.ArrowException, TypeError, ValueError, OverflowError):
                    # Some value does not fit its column: find the records one by one.
                    out = [_fitting(new, old, batch.schema, failed) for new, old in zip(out, rows)]
                    made = pa.RecordBatch.from_pylist(out, batch.schema)
                if failed:
                    LOG.warning("record hook left %d records as they were: %s", len(failed), failed[-1])
                yield made

        return logs.mapInArrow(run, logs.schema)

    return hook
