"""Tables in the shared folder, and global positions without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of this machine only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="kinetrail-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads neither recompute it nor depend on its executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kinetrail/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order: list[str], name: str = "pos", total: str | None = None, before: str = "begin") -> DataFrame:
    """``df`` with ``name``, its row number from 0 in ``order``; with ``total``, also the sum of that column over earlier rows.

    Two phases: a range shuffle sorts rows into partitions and stores them with their place
    there; each partition's count (and sum), a row for each partition, is then accumulated and
    joined back. Equal keys of very many rows are told apart by the further columns of
    ``order``, which must order rows fully for reruns to agree.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part)
    sums = [F.count("*").alias("_n")] + ([F.sum(total).alias("_t")] if total else [])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = placed.groupBy("_part").agg(*sums)
    offsets = counts.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_t")[: len(sums)]])
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_n0") + own)
    if total:
        inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.col("_t0") + F.coalesce(F.sum(total).over(inside), F.lit(0)))
    return out.drop("_part", "_id", "_n0", "_t0")
