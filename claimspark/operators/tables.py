"""Written tables between rounds of iterative jobs, and numbers of rows in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def saved(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir (one of our own where unset and Spark runs on one machine) and read
    again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="claimspark-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df for a join that shuffles it. Pairs repeat few values, so millions of them take a few hundred KB in a file; by that
    size Spark would take them for a small table and send them through the driver to all tasks. Holds up to the next join."""
    return df.hint("merge")


def numbered(df: DataFrame, *by, running: dict[str, str] | None = None, keep: list | None = None) -> DataFrame:
    """df with number, from 1 without gaps in the order of `by`, and for each new name of running the xor of the named
    long column from the first row up to this one.

    No window over all rows: rows are dealt by ranges of the order and sorted there; each range counts its own, and the
    counts, one row a range, become offsets. `by` should order rows fully, else equal rows are numbered in any order. An
    empty table gives none. The order is written down once, so a lost executor can't change it. keep: the columns to go on
    with, if not all."""
    running = running or {}
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).select(*(keep or df.columns)).withColumns({"_range": F.spark_partition_id(), "_place": place}))
    totals = rows.groupBy("_range").agg(F.count("*").alias("n"), *(F.bit_xor(c).alias(name) for name, c in running.items())).orderBy("_range").collect()  # a row a range
    offsets, n, xors = [], 0, dict.fromkeys(running, 0)
    for t in totals:
        offsets.append((t["_range"], n, *xors.values()))
        n, xors = n + t["n"], {k: v ^ (t[k] or 0) for k, v in xors.items()}
    if not offsets:
        return rows.drop("_range", "_place").withColumn("number", F.lit(0).cast("long")).withColumns({k: F.lit(0).cast("long") for k in running})
    before = df.sparkSession.createDataFrame(offsets, ", ".join(["_range int", "_before long", *(f"_x_{k} long" for k in running)]))
    if running:
        upto = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({k: F.bit_xor(c).over(upto) for k, c in running.items()})
    rows = rows.join(F.broadcast(before), "_range").withColumn("number", F.col("_before") + F.col("_place") + 1)
    rows = rows.withColumns({k: F.col(k).bitwiseXOR(F.col(f"_x_{k}")) for k in running})
    return rows.drop("_range", "_place", "_before", *(f"_x_{k}" for k in running))
