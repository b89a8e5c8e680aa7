"""Grids of options as tables: products, zipped groups, defaults, conditional menus, ids, reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defaults of the region algorithms' options.
DEFAULTS = {"sp_size": 25, "niters": -1, "potts": 10.0, "sigma_app": 0.009, "alpha": -0.6931471805599453, "gamma": 4.0, "epsilon_new": 0.05, "epsilon_reid": 1e-6, "split_alpha": 0.0, "video_mode": True, "rgb2lab": True, "target_nspix": 0, "prop_nc": 1, "prop_icov": 1, "overlap": 1}


def _kind(values: list) -> T.DataType:
    kinds = {type(v) for v in values}
    return T.BooleanType() if kinds == {bool} else T.IntegerType() if kinds == {int} else T.DoubleType() if kinds <= {int, float} else T.StringType()


def _cast(values: list):
    kind = _kind(values)
    return kind, [float(v) if isinstance(kind, T.DoubleType) else v if isinstance(kind, (T.IntegerType, T.BooleanType)) else str(v) for v in values]


def axis(spark: SparkSession, name: str, values: list) -> DataFrame:
    """One option's values in order."""
    kind, values = _cast(values)
    schema = T.StructType([T.StructField(f"__{name}", T.IntegerType(), False), T.StructField(name, kind)])
    return spark.createDataFrame(list(enumerate(values)), schema).coalesce(1)


def speed(names: list[str]) -> list[str]:
    """Names from the slowest-moving to the fastest: of two the first is slower; of three and more the last but one is
    slowest, then the last, then the others back to the first, which is fastest."""
    return list(names) if len(names) < 3 else [names[-2], names[-1], *names[-3::-1]]


def grid(spark: SparkSession, options: dict[str, list], zipped: dict[str, list] | None = None) -> DataFrame:
    """id and the product of all values; the lists of zipped move together and slowest."""
    tables = [axis(spark, n, v) for n, v in options.items()]
    order = [f"__{n}" for n in speed(list(options))]
    if zipped:
        if len({len(v) for v in zipped.values()}) != 1:
            raise ValueError("zipped lists have one length")
        cast = {n: _cast(v) for n, v in zipped.items()}
        schema = T.StructType([T.StructField("__group", T.IntegerType(), False), *(T.StructField(n, k) for n, (k, _) in cast.items())])
        tables.insert(0, spark.createDataFrame([(i, *(v[i] for _, v in cast.values())) for i in range(len(next(iter(zipped.values()))))], schema).coalesce(1))
        order.insert(0, "__group")
    full = reduce(DataFrame.crossJoin, tables)
    place: Column = F.lit(0)
    size = {**{f"__{n}": len(v) for n, v in options.items()}, "__group": len(next(iter(zipped.values()))) if zipped else 1}
    for name in order:
        place = place * size[name] + F.col(name)
    names = [*(zipped or {}), *options]
    return full.select(F.concat(F.lit("id_"), place.cast("string")).alias("id"), place.alias("place"), *names)


def with_defaults(experiments: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Missing columns and nulls take their default; what is given wins."""
    out = experiments
    for name, value in (defaults or DEFAULTS).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out


def with_menu(experiments: DataFrame, menu: DataFrame, key: str) -> DataFrame:
    """Adds the columns of the menu row whose key is the experiment's, or of the row of key ``_def_``."""
    columns = [c for c in menu.columns if c != key]
    default = menu.where(F.col(key) == "_def_").select(*(F.col(c).alias(f"__{c}") for c in columns))
    out = experiments.join(menu.where(F.col(key) != "_def_"), key, "left").join(F.broadcast(default), F.lit(True), "left")
    return out.select(*experiments.columns, *(F.coalesce(c, f"__{c}").alias(c) for c in columns))


def without(experiments: DataFrame, pairs: list[tuple[str, object, str, object]]) -> DataFrame:
    """Drops the experiments that hold both values of one of the pairs of fields."""
    for a, x, b, y in pairs:
        experiments = experiments.where(~((F.col(a).eqNullSafe(F.lit(x))) & (F.col(b).eqNullSafe(F.lit(y)))))
    return experiments


def field_pairs(fields: DataFrame) -> DataFrame:
    """All pairs f1 < f2 of a column f."""
    return fields.select(F.col("f").alias("f1")).join(fields.select(F.col("f").alias("f2")), F.col("f1") < F.col("f2"))


def pending(experiments: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Experiments without a stored result."""
    return experiments.join(results.select(*keys).distinct(), keys, "left_anti")


def report(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and standard error of each metric by group, sorted."""
    n = F.count("*")
    out = results.groupBy(*by).agg(n.alias("n"), *(c for m in metrics for c in (F.avg(m).alias(m), (F.stddev_samp(m) / F.sqrt(n)).alias(f"{m}_stderr"))))
    return out.orderBy(*by)


_LOG = {x: math.log(x) for x in (0.1, 0.5, 2.0, 10.0)}
#: The option values of the named suites; a suite is one grid or several, and how many rows it leaves out.
SUITES: dict[str, tuple[list[dict[str, list]], int]] = {
    "video": ([{"video_mode": [True]}], 0),
    "image": ([{"video_mode": [False]}], 0),
    "split": ([{"gamma": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0], "alpha": [_LOG[0.5], 0.0, _LOG[2.0]], "group": ["split_g5"]}], 11),
    "rsplit": ([{"gamma": [0.0], "alpha": [-10.0, -20.0, -50.0], "group": ["rsplit_g0"]}, {"gamma": [4.0], "alpha": [_LOG[10.0]], "group": ["rsplit_g1"]}, {"gamma": [4.0], "alpha": [_LOG[0.1]], "group": ["rsplit_g2"]}, {"gamma": [8.0], "alpha": [_LOG[0.5]], "group": ["rsplit_g3"]}], 0),
    "relabel": ([{"epsilon_new": [1e-1, 5e-2, 1e-2, 1e-3], "epsilon_reid": [1e-6, 1e-5, 1e-4], "group": ["relabel"]}], 0),
    "overlap": ([{"overlap": [0, 1], "group": ["overlap"]}], 0),
    "bshape": ([{"sigma_app": [0.0045, 0.009, 0.018], "potts": [1.0, 10.0, 20.0], "group": ["bshape"]}], 0),
    "cboundary": ([{"prop_nc": [0, 1], "prop_icov": [0, 1], "group": ["cboundary"]}], 0),
    "flow": ([{"flow": ["default", "raft", "spynet"], "group": ["flow"]}], 0),
}


def suite(spark: SparkSession, name: str) -> DataFrame:
    """The experiments of a named suite with all defaults; ids count within each grid."""
    grids, skip = SUITES[name]
    parts = [grid(spark, g if "group" in g else g | {"group": [name]}) for g in grids]
    return with_defaults(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where(F.col("place") >= skip).drop("place"))


def only(experiments: DataFrame, pairs: list[tuple[str, object, str, object]]) -> DataFrame:
    """Keeps the experiments that hold both values of one of the pairs of fields."""
    kept = F.lit(False)
    for a, x, b, y in pairs:
        kept = kept | (F.col(a).eqNullSafe(F.lit(x)) & F.col(b).eqNullSafe(F.lit(y)))
    return experiments.where(kept)


def with_results(experiments: DataFrame, results: DataFrame, on: Column | list[str]) -> DataFrame:
    """Every experiment with its results, null where there are none yet."""
    return experiments.join(results, on, "left")


def united(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The rows of all tables, with the table's name in a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(name, F.lit(k)) for k, t in tables.items()])


def timings(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and deviation of repeated times."""
    return times.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("sd"))
