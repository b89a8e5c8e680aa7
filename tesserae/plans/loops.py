"""Helpers of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode, where none is set, a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage replaced by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df shuffled by key into a fixed number of partitions. For work on groups that is long for its bytes: a shuffle whose
    number of partitions is left open is cut down by its bytes, often to a single task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *key)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back. Unlike cut it also drops what the planner has inferred of df, which
    in long loops over joins and sums grows until planning takes longer than running."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every end of the edges (u, v): hooking to smaller ids, chains halved."""
    links = cut(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct())
    found = None
    while not links.isEmpty():
        up = cut(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")))
        while True:
            higher = up.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            up = cut(up.join(higher, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        to = up.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        found = up if found is None else cut(found.join(to, "root", "left").select("id", F.coalesce("higher", "root").alias("root")).union(up.join(found.select("id"), "id", "left_anti")))
        for end in ("a", "b"):
            links = links.join(up.select(F.col("id").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    ends = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    if found is None:
        return ends.withColumn("component", F.col("id"))
    return ends.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
