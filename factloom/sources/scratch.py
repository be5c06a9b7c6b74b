"""The session's checkpoint folder for operators that cut lineage with checkpoint()."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder the cluster names; set a local one only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    else:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir"))


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and return the table read back; in columns it takes a small part of checkpoint()'s bytes."""
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
