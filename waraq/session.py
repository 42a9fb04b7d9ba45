"""Session defaults, table access and the few places where a plan touches the cluster itself."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks to aim at for work that is heavier than its input is large."""
    return 3 * max(spark.sparkContext.defaultParallelism, 2)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the scan has fewer splits than cores.

    Scans split by compressed bytes; text work costs far more per byte than a scan, so a small
    compressed table would otherwise keep most cores idle. A table with enough splits is left alone.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if "Repartition" in plan and not any(x in plan for x in ("Join", "Aggregate", "Generate", "Union", "Window")):
        return df  # rows that were dealt before and have stayed in place since
    cores = max(spark.sparkContext.defaultParallelism, 2)
    # the planner's estimate: asking the physical plan for its partitions would run its shuffles
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if size >= 2 * cores * split:
        return df
    return df.repartition(3 * cores)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of this machine only for a session that is all on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = os.path.join(tempfile.gettempdir(), "waraq-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of any cluster, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="waraq-")) / "waraq.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
