"""Session helpers: tables, shared folders and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Working columns are prefixed, so that extra input columns cannot clash with them.
WORK = "_rl_"


def session(app: str = "ragloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_ragloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ragloom-code-"), "ragloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._ragloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session may lack the setting; it then gets a temporary folder. A cluster without
    the setting is refused, as a folder of one machine would lose data with that machine.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have is None:
        have = sc.getConf().get("spark.checkpoint.dir")
        if have is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            have = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        sc.setCheckpointDir(have)
        have = sc.getCheckpointDir() or have
    return have


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder."""
    return os.path.join(shared_dir(spark), f"ragloom-{what}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Even partitions for a costly Python stage over few input splits; compact rows only."""
    return df.repartition(shuffle_width(df.sparkSession), *cols)


def blank(c) -> F.Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
