"""What the operators share when they meet a session: code on the workers, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, if the session's paths don't already."""
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(_ROOT) in known or Path.cwd() == _ROOT:
        return
    sc = spark.sparkContext
    if getattr(sc, "_tidepool_shipped", False):
        return
    bundle = Path(tempfile.mkdtemp()) / "tidepool.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(bundle, "w") as z:
        for p in (_ROOT / "tidepool").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(bundle))
    sc._tidepool_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where the setting is absent (tests, a single machine) a folder in the
    warehouse is used instead.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here."""
    path = f"{shared_dir(spark)}/tidepool/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written``."""
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A key with more than this share of all rows is hot, so there are at most as many hot keys as its inverse.
HOT_SHARE, HOT_ROWS = 1e-4, 1_000


def looked_up(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with the columns of names (one row per key), null where it has none.

    Rows of hot keys stay where they are and take their names from a broadcast,
    which has 1 / HOT_SHARE rows at most; only the others are shuffled.
    """
    cut = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > cut) & F.col(key).isNotNull()).select(key)
    hot = written(rows.sparkSession, hot.join(names, key, "left"), "hot")
    if hot.isEmpty():
        return rows.join(names, key, "left")
    some = rows.join(F.broadcast(hot), key)
    return some.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names, key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
