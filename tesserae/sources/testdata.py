"""Pixel, label, motion and graph relations made from plain tables, for queries and tests.

Order k is pixel (t, y, x) of a video of 50 x 30 frames; its colours are whole numbers from 0 to 255.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH, HEIGHT = 50, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = WIDTH * HEIGHT
    return table(spark, sf_dir, "orders").selectExpr(
        f"cast(o_orderkey div {n} AS int) AS t", f"cast(o_orderkey % {n} div {WIDTH} AS int) AS y", f"cast(o_orderkey % {WIDTH} AS int) AS x",
        "cast(cast(floor(o_totalprice) AS bigint) % 256 AS double) AS c0", "cast(o_custkey % 256 AS double) AS c1", "cast(month(o_orderdate) * 20 AS double) AS c2")


def segments(spark: SparkSession, sf_dir: str, side: int = 5) -> DataFrame:
    """pixels with spix, square regions, and gt, diagonal stripes that move by one pixel a frame."""
    return pixels(spark, sf_dir).selectExpr("*", f"cast((y div {side}) * {-(-WIDTH // side)} + x div {side} AS int) AS spix", "cast((x + y + t) div 8 AS int) AS gt")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-pixel motion by region."""
    return segments(spark, sf_dir).selectExpr("t", "y", "x", "spix", "cast(spix % 3 - 1 AS double) AS fx", "cast(spix div 3 % 3 - 1 AS double) AS fy")


def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with the colours (0 to 1) of upright stripes, ten pixels wide, that move by two pixels to the left a frame."""
    band = "(x + 2 * t) div 10"
    return pixels(spark, sf_dir).selectExpr("t", "y", "x", f"cast({band} % 3 AS double) * 0.45 AS c0", f"cast({band} % 2 AS double) * 0.75 AS c1", "0.25D AS c2")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with the colours of five upright bands that stand still and change colour from frame to frame."""
    band = "(x div 10 + t)"
    return pixels(spark, sf_dir).selectExpr("t", "y", "x", f"cast({band} % 3 AS double) * 0.45 AS c0", f"cast({band} % 2 AS double) * 0.75 AS c1", "0.25D AS c2")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion of the stripes."""
    return pixels(spark, sf_dir).selectExpr("t", "y", "x", "-2D AS fx", "0D AS fy")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges u < v between parts (even vertices) and suppliers (odd vertices) of the same line items."""
    return table(spark, sf_dir, "lineitem").selectExpr("cast(least(2 * l_partkey, 2 * l_suppkey + 1) AS int) AS u", "cast(greatest(2 * l_partkey, 2 * l_suppkey + 1) AS int) AS v").distinct()


def vertices(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """Points of the graph: v, position, colours and a region, all arithmetic. e: the edges, where they are at hand."""
    e = edges(spark, sf_dir) if e is None else e
    v = e.selectExpr("u AS v").union(e.select("v")).distinct()
    return v.selectExpr("v", "cast(v % 17 AS double) AS px", "cast(v % 23 AS double) AS py", "cast(v % 29 AS double) AS pz", "cast(v % 31 AS double) AS f0", "cast(v % 37 AS double) AS f1", "cast(v % 41 AS double) AS f2", "cast(v % 7 AS int) AS spix")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles f of a strip that folds back on itself, so that edges have one, two or more faces."""
    f = table(spark, sf_dir, "part").selectExpr("cast(p_partkey AS int) AS f", "cast(p_partkey div 4 * 2 AS int) AS a")
    return f.selectExpr("f", "a", "a + 1 AS b", "a + 2 + f % 4 AS c")


#: DuckDB CTEs for the same relations.
PX = f"""px AS (SELECT CAST(o_orderkey // {WIDTH * HEIGHT} AS INTEGER) AS t, CAST(o_orderkey % {WIDTH * HEIGHT} // {WIDTH} AS INTEGER) AS y, CAST(o_orderkey % {WIDTH} AS INTEGER) AS x,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS DOUBLE) AS c0, CAST(o_custkey % 256 AS DOUBLE) AS c1, CAST(month(o_orderdate) * 20 AS DOUBLE) AS c2 FROM orders)"""
SEG = PX + ", seg AS (SELECT *, CAST((y // 5) * 10 + x // 5 AS INTEGER) AS spix, CAST((x + y + t) // 8 AS INTEGER) AS gt FROM px)"
STRIPE = PX + ", stripe AS (SELECT t, y, x, (x + 2 * t) // 10 AS band, CAST((x + 2 * t) // 10 % 3 AS DOUBLE) * 0.45 AS c0, CAST((x + 2 * t) // 10 % 2 AS DOUBLE) * 0.75 AS c1 FROM px)"
BAND = PX + ", band AS (SELECT t, y, x, CAST((x // 10 + t) % 3 AS DOUBLE) * 0.45 AS c0, CAST((x // 10 + t) % 2 AS DOUBLE) * 0.75 AS c1 FROM px)"
FLOW = SEG + ", flow AS (SELECT t, y, x, spix, CAST(spix % 3 - 1 AS DOUBLE) AS fx, CAST(spix // 3 % 3 - 1 AS DOUBLE) AS fy FROM seg)"
EDGE = "edge AS (SELECT DISTINCT CAST(least(2 * l_partkey, 2 * l_suppkey + 1) AS INTEGER) AS u, CAST(greatest(2 * l_partkey, 2 * l_suppkey + 1) AS INTEGER) AS v FROM lineitem)"
VERTEX = EDGE + """, vertex AS (SELECT v, CAST(v % 17 AS DOUBLE) AS px, CAST(v % 23 AS DOUBLE) AS py, CAST(v % 29 AS DOUBLE) AS pz, CAST(v % 31 AS DOUBLE) AS f0, CAST(v % 37 AS DOUBLE) AS f1,
    CAST(v % 41 AS DOUBLE) AS f2, CAST(v % 7 AS INTEGER) AS spix FROM (SELECT u AS v FROM edge UNION SELECT v FROM edge))"""
FACE = "face AS (SELECT f, a, CAST(a + 1 AS INTEGER) AS b, CAST(a + 2 + f % 4 AS INTEGER) AS c FROM (SELECT CAST(p_partkey AS INTEGER) AS f, CAST(p_partkey // 4 * 2 AS INTEGER) AS a FROM part))"
