"""The log store as a set of whole batches.

A batch is several tables: log rows, details of each type, sightings of servers, counters.
Their folders are written first; then one small manifest file names the batch, and it appears
at once, by a rename. Readers go by the manifests, so they see all tables of a batch or none.
A batch that failed between two tables has no manifest and is written anew; one that has a
manifest is never written again, so its files do not change under a reader.

``compact`` writes the rows of many batches into a few files under a new name and commits a
manifest that replaces theirs. Readers see the batches before that commit and the new files
after it; the replaced folders stay, for readers that still hold them, until ``vacuum``.

The manifests are one row a batch or compaction and are read on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch bigint, tables array<string>, replaces array<bigint>, received bigint, parsed bigint, saved bigint"


@dataclass(frozen=True)
class Entry:
    """A committed batch (from 0), or a compaction (below 0)."""

    batch: int
    tables: tuple[str, ...]
    replaces: tuple[int, ...] = ()
    received: int = 0
    parsed: int = 0
    saved: int = 0


class LogStore:
    """Reading and committing the batches below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def committed(self) -> list[Entry]:
        """Every manifest, replaced ones too, by batch."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        found = [Entry(r[0], tuple(r[1]), tuple(r[2] or ()), *r[3:]) for r in rows]
        return sorted(set(found), key=lambda e: e.batch)

    def entries(self) -> list[Entry]:
        """What readers see: manifests that no compaction has replaced."""
        every = self.committed()
        gone = {b for e in every for b in e.replaces}
        return [e for e in every if e.batch not in gone]

    def has(self, batch: int) -> bool:
        return any(e.batch == batch for e in self.committed())

    def commit(self, entry: Entry) -> None:
        """Make a batch visible: one file, moved into place when it is whole."""
        row = (entry.batch, list(entry.tables), list(entry.replaces), entry.received, entry.parsed, entry.saved)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of the committed batches; ``schema`` names its columns, ``batch`` among them.

        Without a schema it is that of the files, of which there must be some.
        """
        own = [self.folder(name, e.batch) for e in self.entries() if name in e.tables]
        if not own and schema:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.path}/{name}")
        return (reader.schema(schema) if schema else reader).parquet(*own)

    def counters(self) -> dict[str, int]:
        """Lines received, parsed, saved and failed, and batches, of all that was committed."""
        own = [e for e in self.committed() if e.batch >= 0]
        sums = {k: sum(getattr(e, k) for e in own) for k in ("received", "parsed", "saved")}
        return {**sums, "errors": sums["received"] - sums["parsed"], "batches": sum(e.received > 0 for e in own)}

    def compact(
        self,
        schemas: dict[str, str | None],
        partitions: dict[str, list[str]] | None = None,
        derived: dict[str, Callable[[LogStore, int], DataFrame]] | None = None,
        fewest: int = 2,
    ) -> int | None:
        """Join all visible batches into one; its number, or None if there are too few.

        ``schemas`` are those of ``table``; ``partitions`` the columns a table is split by on
        disk; ``derived`` tables are made of the new files. Rows are dealt to files by size,
        so no task writes a table alone.
        """
        old = self.entries()
        if len(old) < fewest:
            return None
        number = min(-1, min(e.batch for e in self.committed()) - 1)

        def join(name: str, schema: str | None) -> None:
            rows = self.table(name, schema).drop("batch")
            by = (partitions or {}).get(name, [])
            writer = rows.hint("rebalance", *by).write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(self.folder(name, number))

        at_once(self.spark, [lambda own=own: join(*own) for own in schemas.items()])
        for name, make in (derived or {}).items():
            make(self, number).write.mode("overwrite").parquet(self.folder(name, number))
        self.commit(Entry(number, (*schemas, *(derived or {})), tuple(e.batch for e in old)))
        return number

    def vacuum(self) -> list[int]:
        """Remove folders of replaced batches, once no reader holds them; the batches removed."""
        every, seen = self.committed(), {e.batch for e in self.entries()}
        gone = [e for e in every if e.batch not in seen]
        for entry in gone:
            for table in entry.tables:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(table, entry.batch))
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return [e.batch for e in gone]


def at_once(spark: SparkSession, jobs: Iterable[Callable[[], None]], threads: int = 4) -> None:
    """Run jobs of Spark that do not wait for each other; small ones leave cores idle alone.

    All have ended on return; the first error among them is raised. Like the caller's, their
    work ends when the stream that they belong to is stopped.
    """
    with ThreadPoolExecutor(threads) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()


EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"
EMPTY_STAGES = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@contextmanager
def observed(spark: SparkSession) -> Iterator[None]:
    """Writes inside keep their observations when no row reaches the end of a stage.

    A stage without rows is otherwise taken out of the plan, and what was observed in it is lost.
    """
    before = spark.conf.get(EXCLUDED, None)
    spark.conf.set(EXCLUDED, ",".join(filter(None, (before, EMPTY_STAGES))))
    try:
        yield
    finally:
        spark.conf.set(EXCLUDED, before) if before else spark.conf.unset(EXCLUDED)


def row_id(batch: int) -> Column:
    """Ids that no other row of any batch has: the batch above 64 bits, the row's number below.

    The row's number is Spark's own (partition and row in it), so neither is bounded here.
    """
    n = F.monotonically_increasing_id().cast("decimal(38,0)")
    return (F.lit(str(batch << 64)).cast("decimal(38,0)") + n).cast("decimal(38,0)")
