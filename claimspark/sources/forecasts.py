"""Reading nested forecast documents and ledgers, and publishing tables behind a gate."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.tables import numbered

FORECAST = """updated string, basis string,
 years array<struct<year: int, summary: string, events: array<struct<t: string, d: string, prob: int, high: boolean, revisedAt: string, changeNote: string, m: int, mBand: int, mPrecision: string, mBasis: string>>>>,
 postSuperintelligence struct<title: string, summary: string, items: array<struct<id: string, t: string, d: string, epistemic: string, conditionalProb: int, dependencies: array<string>, indicators: array<string>, caveat: string>>>"""
#: The year that undated claims get.
HORIZON_YEAR = 2041


def read_forecast(spark: SparkSession, path: str, defaults: list[tuple[int, str]] = ()) -> DataFrame:
    """(claim_id, year, title, domain, probability, origin) of a forecast document, one row a claim. A missing file gives
    `defaults` (year, title) with origin `default`; a file that is there must parse."""
    try:
        doc = spark.read.schema(FORECAST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame(list(defaults), "year int, title string")
        return rows.select(F.concat_ws("-", "year", F.lit("0")).alias("claim_id"), "year", "title", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("int").alias("probability"), F.lit("default").alias("origin"))
    years = doc.select(F.explode("years").alias("y")).select("y.year", F.posexplode("y.events").alias("i", "e"))
    dated = years.select(F.concat_ws("-", "year", "i").alias("claim_id"), "year", F.col("e.t").alias("title"), F.col("e.d").alias("domain"), F.col("e.prob").alias("probability"))
    items = doc.select(F.explode("postSuperintelligence.items").alias("e"))
    horizon = items.select(F.concat(F.lit("horizon-"), "e.id").alias("claim_id"), F.lit(HORIZON_YEAR).alias("year"), F.col("e.t").alias("title"), F.col("e.d").alias("domain"), F.col("e.conditionalProb").alias("probability"))
    return dated.unionByName(horizon).withColumn("origin", F.lit("file"))


def well_formed_years(doc: DataFrame) -> DataFrame:
    """For viewing: (year, summary, events) of years that have a year, a summary and events, in order; others are left."""
    years = doc.select(F.explode("years").alias("y")).select("y.*")
    return years.where("year between 2000 and 2100 and trim(summary) <> '' and size(events) > 0").orderBy("year")


def flatten(nested: DataFrame, key: str, items: str) -> DataFrame:
    """(key, claim_id, event): one row for each of items, its id `key-place` from 0."""
    return nested.select(key, F.posexplode(items).alias("i", "event")).withColumn("claim_id", F.concat_ws("-", key, "i"))


def numbered_claims(events: DataFrame, key: str, *order: str) -> DataFrame:
    """events (key, ...) with claim_id `key-place`: the place of a row among those of its key from 0, in an order of all
    rows, so that no key's rows are gathered. `order` should tell rows of a key apart."""
    rows = numbered(events, key, *order)
    first = rows.groupBy(key).agg(F.min("number").alias("_first"))
    return rows.join(first, key).withColumn("claim_id", F.concat_ws("-", key, F.col("number") - F.col("_first"))).drop("number", "_first")


def ledger_groups(mapping: DataFrame, source: str, claim: str, most: int = 1000) -> DataFrame:
    """(source, ids): ledger groups of a mapping (source, claim), of `most` ids at the utmost; a larger group is several."""
    rows = numbered(mapping.select(source, claim), source, claim)
    return rows.groupBy(source, F.floor(F.col("number") / most).alias("_part")).agg(F.collect_list(claim).alias("ids")).drop("_part")


def census(rows: DataFrame, reason: Column) -> DataFrame:
    """(outcome, n, registered): what is kept and what is dropped for which reason, beside all that was read."""
    counts = rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("registered"))))  # one row


def mappings(groups: DataFrame, source: str, ids: str) -> DataFrame:
    """(source, claim): ledger groups with one row a claim."""
    return groups.select(source, F.explode(ids).alias("claim"))


def duplicates(mapping: DataFrame) -> DataFrame:
    """Claims that more than one group maps."""
    return mapping.groupBy("claim").agg(F.count("*").alias("n")).where("n > 1")


def publish(table: DataFrame, violations: DataFrame, path: str, run_date: str) -> None:
    """Writes table as the partition run_date of path, only if violations has no row; else fails and writes nothing.

    The table is computed into a folder beside the partitions, which readers skip, and takes the partition's place by a
    rename once it is whole. A run that fails before leaves the last output as it was; one that fails between the two
    renames puts it back."""
    broken = violations.limit(20).collect()
    if broken:
        raise ValueError(f"not published: {[tuple(r) for r in broken]}")
    session, mark = table.sparkSession, uuid.uuid4().hex
    at = session._jvm.org.apache.hadoop.fs.Path
    staged, former, target = at(f"{path}/_staged-{mark}"), at(f"{path}/_former-{mark}"), at(f"{path}/run_date={run_date}")
    fs = target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    try:
        table.write.parquet(staged.toString())
        had = fs.exists(target)
        if had and not fs.rename(target, former):
            raise OSError(f"can't move the last output of {target.toString()}")
        if not fs.rename(staged, target):
            if had:
                fs.rename(former, target)
            raise OSError(f"can't move the new output to {target.toString()}")
        fs.delete(former, True)
    finally:
        fs.delete(staged, True)


def write_report(report: DataFrame, path: str) -> None:
    """The full run report, one JSON document a row."""
    report.write.mode("overwrite").json(path)


def previous_run(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last published partition, or no rows of schema."""
    try:
        runs = spark.read.schema(f"{schema}, run_date string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    last = runs.agg(F.max("run_date").alias("run_date"))
    return runs.join(F.broadcast(last), "run_date").drop("run_date")


def pin_once(texts: DataFrame, path: str) -> DataFrame:
    """Writes texts if path has no pins yet; returns the pins that stand."""
    texts.write.mode("ignore").parquet(path)
    return texts.sparkSession.read.parquet(path)
