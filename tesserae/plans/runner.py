"""Runs a table of experiments over videos, and evaluates what they gave; both skip what is done already.

Labels and scores lie in one folder, partitioned by group, id and rep, which name a run.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import rgb_to_lab
from ..operators import metrics
from ..sources.files import write_results
from . import drivers
from .frame import Options

KEYS = ("group", "id", "rep")
#: What an experiment may name beside the options of the algorithms: its own name, and what run itself heeds.
NAMES = {*KEYS, "place", "video_mode", "flow", "rgb2lab", "nimgs", "overlap"}


def options_of(experiment: dict) -> Options:
    """The options that an experiment names. niters below 0 and null stand for the default; overlap says whether the smaller
    of two regions that meet wins. A name that nothing heeds is an error, so that no experiment silently equals another."""
    known = {f.name: type(f.default) for f in fields(Options)}
    unknown = set(experiment) - set(known) - NAMES
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    given = {k: known[k](v) for k, v in experiment.items() if k in known and v is not None and not (k == "niters" and v < 0)}
    if experiment.get("overlap") is not None:
        given["smaller_wins"] = bool(experiment["overlap"])
    return Options(**given)


def done(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """group, id and rep of the runs that have files of that part."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], "group string, id string, rep int")
    return spark.read.parquet(f"{folder}/{part}").select("group", "id", "rep").distinct()


def run(experiments: DataFrame, pixels: DataFrame, flows: DataFrame | dict[str, DataFrame] | None, folder: str, reps: int = 1) -> int:
    """Segments the videos for every experiment and repetition without labels yet; returns how many that were.

    The driver loops over the experiments, which are a grid of options; each is one Spark job over all videos. With
    video_mode false, frames are segmented one by one. flows: the motion, or one table for each name that experiments
    give as flow. With rgb2lab true the colours (red, green, blue from 0 to 1) are converted first; nimgs above 0 keeps the
    frames below that number.
    """
    spark = experiments.sparkSession
    named = experiments if "group" in experiments.columns else experiments.withColumn("group", F.lit("all"))
    wanted = named.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    rows = wanted.join(done(spark, folder, "labels"), list(KEYS), "left_anti").orderBy(*KEYS).collect()
    for row in rows:
        given = row.asDict()
        o, px, motion = options_of(given), pixels, flows
        if isinstance(flows, dict):
            if given.get("flow") not in flows:
                raise ValueError(f"no motion named {given.get('flow')}")
            motion = flows[given["flow"]]
        elif given.get("flow") not in (None, "default"):
            raise ValueError("experiments that name a flow need a table for each name")
        if given.get("nimgs"):
            px = px.where(F.col("t") < given["nimgs"])
        if given.get("rgb2lab"):
            px = px.withColumns(dict(zip(("c0", "c1", "c2"), rgb_to_lab(F.col("c0"), F.col("c1"), F.col("c2")), strict=True)))
        labels = drivers.segment_frames(px, o) if given.get("video_mode") is False else drivers.segment_videos(px, motion, o)
        write_results(labels.withColumns({k: F.lit(row[k]) for k in KEYS}), f"{folder}/labels", KEYS)
    return len(rows)


def evaluate(spark: SparkSession, folder: str, truth: DataFrame, area: int) -> DataFrame:
    """Scores by group, id, rep and video; runs that have scores aren't scored again. truth: [video,] t, y, x, gt, c0-2."""
    truth = drivers.with_video(truth)
    for row in done(spark, folder, "labels").join(done(spark, folder, "scores"), list(KEYS), "left_anti").orderBy(*KEYS).collect():
        here = f"{folder}/labels/group={row['group']}/id={row['id']}/rep={row['rep']}"
        seg = spark.read.parquet(here).select("video", "t", "y", "x", "spix")
        # labels take few bytes on disk, by which the planner would send them whole through the driver
        seg = seg.hint("merge").join(truth, ["video", "t", "y", "x"])
        write_results(metrics.evaluate(seg, area).withColumns({k: F.lit(row[k]) for k in KEYS}), f"{folder}/scores", KEYS)
    return spark.read.parquet(f"{folder}/scores")
