"""Tables that outlive executors, and connected components built on them.

Lineage is cut by writing Parquet under the shared folder the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set and Spark runs in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = held.get() if held.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            set_dir = spark.conf.get("spark.sql.warehouse.dir")
        else:
            set_dir = tempfile.mkdtemp(prefix="factloom-")
            spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], n: int | None = None) -> str:
    """Write ``df`` to the shared folder in buckets by ``keys``, each sorted by them; the table's name.

    Joins on these keys with tables of as many buckets read them as they lie, without a shuffle.
    """
    spark = df.sparkSession
    table = f"factloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    n = n or shuffle_width(spark)
    # A bucket is one task's and one file; where the rows lie so already, Spark leaves the exchange out.
    writer = df.repartition(n, *keys).write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    _written.append((spark, path))
    return table


def bucket_files(spark: SparkSession, tables: list[str]) -> DataFrame:
    """The rows of tables of ``bucketed`` of one schema, without their buckets."""
    return spark.read.schema(spark.table(tables[0]).schema).parquet(*(f"{shared_folder(spark)}/{t}" for t in tables))


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Delete a table of ``bucketed`` that nothing will read again."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    for entry in [x for x in _written if x[1].endswith(f"/{table}")]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than this part of all rows is joined by broadcast; there are fewer such keys than the reciprocal.
HOT = 1 / 2000


def join_by_share(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, share: float = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique keys; ``count``: how many rows have the key), without a task that gets all of a hot key.

    At most ``1 / share`` keys can have more than ``share`` of the rows, however many rows there
    are, so these are broadcast; all others meet in a shuffle.
    """
    keyed = settle(keyed, "keyed")
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col(count) > total * share)).drop(count)
    cold = keyed.where(F.col(count) <= total * share).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(cold, keys))


#: Edges that a task unites at a time: about 100 MB with everything made of them, whatever a partition holds.
EDGES = 1_000_000


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) with the smallest node each reaches, those left out that are it: labels sink along edges, then jump to their own labels."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(limit: int):
    """Unite the edges of one partition, ``limit`` at a time: what one share leaves is united over all partitions later."""

    def fn(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= limit:
                yield _united(held)
                held = []
        if held:
            yield _united(held)

    return fn


def _united(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in united(u, v)], names=["u", "v"])


def _star_round(e: DataFrame) -> DataFrame:
    """Large-star, then small-star; an aggregate and a join each, which Spark can combine or split at a node with very many neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node it reaches.

    Each round unites the edges of every partition by themselves, which leaves one edge a node,
    and then alternates large-star and small-star over all, until each node points at its
    component's smallest: no node points at two nodes, or is pointed at and points on. A task
    holds ``EDGES`` edges of its partition at a time.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        e = settle(e.mapInArrow(_contract(EDGES), "u long, v long"), "edges")
        ends = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")))
        label = ends.groupBy("node").agg(F.min("comp").alias("comp"), F.max("comp").alias("top"))
        if label.where("comp <> top").limit(1).count() == 0:
            return label.select("node", "comp")
        e = _star_round(e)
