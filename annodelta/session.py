"""Session defaults and the lineage cut used by multi-stage operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "annodelta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` overrides any default.

    The shuffle partition count is left to the cluster (adaptive execution coalesces it),
    only local masters get a small one.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        defaults |= {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that a job can be started from any folder."""
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="annodelta-package-")) / "annodelta.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for module in sorted(package.rglob("*.py")):
            packed.write(module, Path("annodelta") / module.relative_to(package))
    spark.sparkContext.addPyFile(str(archive))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Used where a plan reads the same intermediate several times: without it every reader
    would recompute the chain before it. Reliable checkpoints survive the loss of executors.
    A folder is chosen here only when the session names none (tests, local runs).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":  # local-cluster has executors of its own
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="annodelta-checkpoint-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
