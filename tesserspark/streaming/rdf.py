"""A running pair histogram over a stream of frames.

Counts are additive, so a batch's result is one row per pair and bin, written under the batch's number:
a batch that runs again writes the same rows to the same place.  A frame counts once all its atoms
have come; atoms of frames that wait are written under the batch's number too, and the next batch reads
them.  So a query that is started again on its folder goes on where it was.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

ATOMS = "frame long, atom long, species string, x double, y double, z double"
COUNTS = "a string, b string, place int, n long"


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of atoms, as they arrive."""
    return spark.readStream.schema(ATOMS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def add_batch(batch: DataFrame, number: int, side: float, atoms_a_frame: int, pairs: list[tuple[str, str]], edges: np.ndarray, folder: str) -> None:
    """Writes the counts of the frames that this batch completes, and the atoms of those that still wait."""
    from tesserspark.operators.rdf import pair_histogram
    from tesserspark.sources.trajectory import Trajectory

    spark = batch.sparkSession
    before = f"{folder}/waiting/batch={number - 1}"
    rows = batch.select("frame", "atom", "species", "x", "y", "z")
    if number and _exists(spark, f"{before}/_SUCCESS"):
        rows = rows.unionByName(spark.read.schema(ATOMS).parquet(before))
    rows = rows.dropDuplicates(["frame", "atom"])
    whole = F.broadcast(rows.groupBy("frame").agg(F.count(F.lit(1)).alias("came")).where(F.col("came") >= atoms_a_frame).select("frame"))  # one row a frame of a batch
    rows.join(whole, "frame", "left_anti").write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
    frames = whole.select("frame", *[F.lit(float(side)).alias(x) for x in "abc"])
    counts = pair_histogram(Trajectory.from_dataframe(rows.join(whole, "frame", "left_semi"), frames), pairs, edges)
    counts.select("a", "b", F.col("place").cast("int").alias("place"), F.col("n").cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")


def running_histogram(stream: DataFrame, side: float, atoms_a_frame: int, pairs: list[tuple[str, str]], edges: np.ndarray, folder: str):
    """Starts a query that keeps the counts of all whole frames seen so far in ``folder``, in a cube of the given side."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    return writer.foreachBatch(lambda batch, number: add_batch(batch, number, side, atoms_a_frame, pairs, edges, folder)).start()


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b, place, n) of all batches."""
    return spark.read.schema(COUNTS).parquet(f"{folder}/counts").groupBy("a", "b", "place").agg(F.sum("n").alias("n"))
