"""Where the videos and the ground truth of the known datasets lie below their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders, first frame numbers and extensions of the datasets.
DATASETS = {
    "segtrack": {"images": "PNGImages", "truth": "GroundTruth", "start": 1, "ext": "png", "threshold": 128, "names": None},
    "davis": {"images": "JPEGImages/480p", "truth": "Annotations/480p", "start": 0, "ext": "jpg", "threshold": None, "names": "ImageSets/2017/val.txt"},
}


def known(dataset: str) -> dict:
    """The entry whose name stands in the dataset's."""
    for name, entry in DATASETS.items():
        if name in dataset.lower():
            return entry
    raise KeyError(f"no dataset {dataset}")


def images(dataset: str, root: str, video: str) -> str:
    return f"{root.rstrip('/')}/{known(dataset)['images']}/{video}"


def truth(dataset: str, root: str, video: str) -> str:
    return f"{root.rstrip('/')}/{known(dataset)['truth']}/{video}"


def videos(spark: SparkSession, dataset: str, root: str) -> DataFrame:
    """video: the names in the dataset's list, or those of the folders of its ground truth."""
    entry = known(dataset)
    if entry["names"]:
        return spark.read.text(f"{root}/{entry['names']}").select(F.trim("value").alias("video")).where("video <> ''").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{entry['truth']}").select("path")
    return files.select(F.regexp_extract("path", rf"/{entry['truth']}/([^/]+)/", 1).alias("video")).where("video <> ''").distinct()
