"""Tables written to the folder that driver and executors share, and positions in a total order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written as Parquet and read back: what it holds does not change any more."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `settled` made, once all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` with `position`, 0 for the first row in the order.

    Rows are dealt to ranges of the order and sorted there; the rows before a range are counted
    by range, one row for each, so no task sees all rows.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("_part", F.shiftright("_row", 33)).withColumn("_row", F.col("_row").bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    other = sizes.select(F.col("_part").alias("_other"), F.col("n").alias("_n"))
    before = sizes.join(other, F.col("_other") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")
