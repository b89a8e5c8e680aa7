"""Connected components of a link table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id that has a link to another one.

    links: two long columns, a and b, in any order, with repetitions; null ends and self-links count for nothing.
    Each round hooks every id to its smallest smaller neighbour, shortens the chains by doubling, and goes on with the
    links between different roots; those ids that have a smaller neighbour are gone after a round. Each round is
    written to the shared folder. Sums over an id are aggregated before they are shuffled, so an id with very many
    links costs no more than others.
    """
    edges = stored(_canonical(links.select("a", "b")), "links")
    found = None
    while not edges.isEmpty():
        up = stored(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "hooks")
        while True:
            above = up.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            moved = stored(up.join(above, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "hooks")
            if moved.where("moved").isEmpty():
                break
            up = moved.drop("moved")
        if found is None:
            found = up
        else:
            older = found.join(up.select(F.col("id").alias("root"), F.col("root").alias("higher")), "root", "left").select("id", F.coalesce("higher", "root").alias("root"))
            found = stored(older.union(up.join(found.select("id"), "id", "left_anti")), "roots")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("id").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = stored(_canonical(edges), "links")
    if found is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return found.select("id", F.col("root").alias("component")).union(found.select(F.col("root").alias("id"), F.col("root").alias("component")).distinct())


def _canonical(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
