"""Session settings and the lineage cuts that long plans need."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster pass your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("inkwell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.conf.set(SCAN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared folder, where the loss of an
    executor can't take it. The folder is the session's ``spark.checkpoint.dir``; only
    where a session names none (tests) a temporary one is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="inkwell-checkpoint-", dir=os.environ.get("TMPDIR")))
    return df.checkpoint(eager=True)


#: Session setting: into how many partitions ``spread`` deals rows. Unset: scans stay as they are read.
SCAN_PARTITIONS = "inkwell.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over ``inkwell.scan.partitions`` partitions where the session sets that, else ``df``
    as it stands. ``local_session`` sets it, as a test table is one file of one row group, which can't
    be split; on a cluster leave it unset, so that no text is moved before it is read."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the session's executors this package, so that Arrow functions find it wherever
    they run. Once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="inkwell-package-")) / "inkwell.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
