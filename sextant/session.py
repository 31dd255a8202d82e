"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "sextant", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder under the warehouse stands in
    for it, if the master is local or the warehouse lies in a store that all machines reach; else this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    is_remote = "://" in warehouse and not warehouse.startswith("file:")
    if not (is_remote or re.match(r"local(\[|$)", spark.sparkContext.master)):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_sextant_checkpoints"


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a plain scan that has fewer partitions than there are cores.

    One small file is one partition whatever the cluster; work on it would run on one core. Plans with
    a shuffle, and scans that are already wide enough, stay as they are.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that a lost executor costs no earlier stage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``scratch_path`` that nothing reads any more."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is no scratch table")
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors, unless their Python path already holds it.

    A zip of the package goes through Spark's own file distribution, once for each context.
    """
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    paths = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if str(root) in paths or getattr(context, "_sextant_shipped", False):
        return
    # Executors fetch the file from the driver as they come up, so it stays until the driver ends.
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/sextant.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "sextant").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(archive)
    context._sextant_shipped = True
