"""What the operators of this subpackage share: shared-folder tables, cleanup and worker set-up."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: texts can be long, and two workers share what an executor leaves them.
ARROW_ROWS = 2048


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a source checkout, and keep batches of texts small."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def give_back() -> None:
    """Hand memory that a fit has freed back to the system, where the C library can: the driver lives on beside Spark's
    own process, and what it keeps for later is memory that nobody else has."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_name(columns: list[str], name: str) -> str:
    """The name of an added column: underscores follow until none of the columns there has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all of
    Spark runs in one process (tests)."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return base.rstrip("/")


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. The table is
    deleted when the driver ends, or before that by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.options(**options).parquet(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
