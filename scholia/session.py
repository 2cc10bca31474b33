"""Session construction, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "scholia", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with; a cluster session needs none of this."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    for key, value in (DEFAULT_CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions (small tables of one file), for costly Python stages."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    shared = shared_folder(spark)
    parent = local_path(shared) if shared.startswith(("file:", "/")) else None  # else the driver's own folder; Spark serves it
    if parent:
        os.makedirs(parent, exist_ok=True)
    archive = Path(tempfile.mkdtemp(prefix="scholia-", dir=parent)) / "scholia.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or (only where that is unset, as in tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors see")
    folder = f"file://{tempfile.gettempdir()}/scholia-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/scholia-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing ``df`` as a table in the shared folder and reading it again.

    Unlike a cached frame it survives the loss of any executor, and unlike ``checkpoint`` it keeps
    column pruning and size statistics for the plans that read it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table of a `materialize` that no plan reads any more."""
    _delete(df.sparkSession, df._scratch)


def local_path(uri: str) -> str:
    return uri[len("file://"):] if uri.startswith("file://") else uri[len("file:"):] if uri.startswith("file:") else uri


def read_shared(uri: str):
    """A table of the shared folder as an Arrow table, readable inside a Python worker."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return ds.dataset(local_path(uri), format="parquet", exclude_invalid_files=True).to_table()
    filesystem, path = fs.FileSystem.from_uri(uri)
    return ds.dataset(path, format="parquet", filesystem=filesystem, exclude_invalid_files=True).to_table()
