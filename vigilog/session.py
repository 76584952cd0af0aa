"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every query relies on; they can be changed on a running session.
# The JVM does not compile methods beyond 8000 bytes, so a stage of many rules runs
# faster as separate operators than as one huge generated method.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **RUNTIME,
}


def get_session(app: str = "vigilog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per Spark application.

    Workers run functions of the package but need not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="vigilog-package-"), "vigilog")
        context.addPyFile(shutil.make_archive(target, "zip", root, "vigilog"))
        _SHIPPED.add(context.applicationId)
    return spark


_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``. Only where that is
    unset (local runs, tests) is a folder of this machine used, and then it is
    also made the session's checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_base(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _local_base(spark: SparkSession) -> str:
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    base = os.environ.get("VIGILOG_LOCAL_DIR") or tempfile.mkdtemp(prefix="vigilog-")
    os.environ["VIGILOG_LOCAL_DIR"] = base
    return base


def cut_lineage(spark: SparkSession, df, name: str):
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the executors that computed it.
    """
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
