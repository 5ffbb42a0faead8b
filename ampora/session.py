"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python needs no search path of its own."""
    sc = spark.sparkContext
    if getattr(sc, "_ampora_shipped", False):
        return
    sc._ampora_shipped = True
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ampora-")) / "ampora_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: only an input of fewer partitions than cores (a single small file) is dealt out anew."""
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``; where it is unset, one of our own in local mode, an error elsewhere."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = os.path.join(tempfile.gettempdir(), "ampora-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later stages read files that survive a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read from there.

    A checkpoint keeps what is known of its plan (constraints, order), which each round of a loop multiplies; a file keeps nothing of it.
    """
    target = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def local_session(cpus: str | int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ampora")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
