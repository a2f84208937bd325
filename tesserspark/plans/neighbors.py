"""The one range join that every neighbor query uses.

Atoms are dealt into cells of at least the cutoff's width; one side is repeated for the cells around
its own, so the join is an equi-join on (frame, cell) with a distance residual, which streams pairs.
On an axis with one or two cells only the distinct neighbors are generated, so no pair comes twice.
The generator stands in a projection: written as cross joins, the optimizer would join on frame first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tesserspark.functions import box as cells
from tesserspark.sources.trajectory import Trajectory


def check_radius(trajectory: Trajectory, r_max: float) -> None:
    """Raises if the cutoff is beyond the safe radius of some frame: there the nearest image is not the only one."""
    row = trajectory.extent["tightest"]
    if row is None:
        raise ValueError("frames must select at least one frame")
    if r_max > row["safe_radius"]:
        raise ValueError(f"r_max={r_max:g} exceeds the safe periodic radius {row['safe_radius']:g} at source frame {row['source_frame']}")


def safe_radius(trajectory: Trajectory) -> tuple[float, int]:
    row = trajectory.extent["tightest"]
    return row["safe_radius"], row["source_frame"]


#: Candidate pairs that one task of the join tests, about.
TASK_PAIRS = 50_000_000


def join_partitions(trajectory: Trajectory, r_max: float) -> int:
    """How many tasks share the join: the work is in the pairs, so their number is reckoned, by the first frame's atoms and the mean volume.

    A number that is too small only makes tasks longer; at the least there are as many as the session asks for.
    """
    spark = trajectory.atoms.sparkSession
    row = trajectory.extent
    atoms = trajectory.n_atoms if row["n"] else 0
    around = min(float(atoms), 27 * r_max**3 * atoms / row["volume"]) if atoms else 0.0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, math.ceil(row["n"] * atoms * around / TASK_PAIRS))


def _located(trajectory: Trajectory, r_max: float, species: list[str] | None) -> DataFrame:
    """Atoms with fractional coordinates and their cells."""
    frames = trajectory.frames.select(F.col("frame").alias("__f"), *cells.H, *cells.G, *[F.greatest(F.lit(1), F.floor(F.col(f"w{k}") / r_max)).cast("long").alias(f"n{k}") for k in (1, 2, 3)])
    atoms = trajectory.atoms if species is None else trajectory.atoms.where(F.col("species").isin(sorted(set(species))))
    joined = atoms.join(frames, F.col("frame") == F.col("__f")).drop("__f")
    xyz = [F.col(k) for k in "xyz"]
    with_f = joined.withColumns({f"f{k}": cells.fractional(*xyz, k) for k in (1, 2, 3)})
    return with_f.withColumns({f"k{k}": F.least(F.col(f"n{k}") - 1, F.floor((F.col(f"f{k}") - F.floor(f"f{k}")) * F.col(f"n{k}")).cast("long")) for k in (1, 2, 3)})


def _around(k: int) -> Column:
    return F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(F.col(f"k{k}") + o, F.col(f"n{k}"))))


def _cell(x, y, z) -> Column:
    return (x * F.col("n2") + y) * F.col("n3") + z


def neighbor_pairs(trajectory: Trajectory, r_max: float, *, centers: list[str] | None = None, neighbors: list[str] | None = None, half: bool = False, check: bool = True, only: DataFrame | None = None) -> DataFrame:
    """frame, i, si, j, sj, d2, dx, dy, dz, tx, ty, tz of every pair closer than r_max.

    The displacement runs from i to the nearest image of j, whose translation in cell vectors is
    (tx, ty, tz) relative to the coordinates as given.  An atom is no neighbor of itself; coincident
    atoms are.  ``half``: each unordered pair once, with i < j (then both sides must allow the same species).
    ``only``: a table (frame, i) of the centers wanted.
    """
    if check:
        check_radius(trajectory, r_max)
    around = F.flatten(F.transform(_around(1), lambda x: F.flatten(F.transform(_around(2), lambda y: F.transform(_around(3), lambda z: _cell(x, y, z))))))
    left = _located(trajectory, r_max, centers).select("frame", F.col("atom").alias("i"), F.col("species").alias("si"), *[F.col(f"f{k}").alias(f"p{k}") for k in (1, 2, 3)], *cells.H, F.explode(around).alias("cell"))
    if only is not None:
        left = left.join(only.select("frame", "i"), ["frame", "i"], "left_semi")
    right = _located(trajectory, r_max, neighbors).select(F.col("frame").alias("__frame"), F.col("atom").alias("j"), F.col("species").alias("sj"), *[F.col(f"f{k}").alias(f"q{k}") for k in (1, 2, 3)], _cell(F.col("k1"), F.col("k2"), F.col("k3")).alias("__cell"))
    own = F.col("i") < F.col("j") if half else F.col("i") != F.col("j")
    parts = join_partitions(trajectory, r_max)  # partitions of a given number are not coalesced by size
    left, right = left.repartition(parts, "frame", "cell"), right.repartition(parts, "__frame", "__cell")
    f = [F.col(f"q{k}") - F.col(f"p{k}") for k in (1, 2, 3)]
    g = [x - cells.image(x) for x in f]
    joined = left.join(right, (F.col("frame") == F.col("__frame")) & (F.col("cell") == F.col("__cell")) & own)
    near = joined.withColumns({f"__g{k}": g[k - 1] for k in (1, 2, 3)} | {f"t{'xyz'[k - 1]}": (-cells.image(f[k - 1])).cast("int") for k in (1, 2, 3)})
    wrapped = [F.col(f"__g{k}") for k in (1, 2, 3)]
    moved = near.withColumns({f"d{'xyz'[k - 1]}": cells.cartesian(*wrapped, k) for k in (1, 2, 3)})
    out = moved.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return out.where(F.col("d2") < r_max * r_max).select("frame", "i", "si", "j", "sj", "d2", "dx", "dy", "dz", "tx", "ty", "tz")


def neighbor_lists(trajectory: Trajectory, r_max: float, *, centers: list[str] | None = None, neighbors: list[str] | None = None) -> DataFrame:
    """(frame, i, neighbors): the atoms within the cutoff of every center, ascending; centers without any have an empty list."""
    near = neighbor_pairs(trajectory, r_max, centers=centers, neighbors=neighbors).groupBy("frame", "i").agg(F.array_sort(F.collect_set("j")).alias("found"))
    every = trajectory.atoms if centers is None else trajectory.atoms.where(F.col("species").isin(sorted(set(centers))))
    joined = every.select("frame", F.col("atom").alias("i")).join(near, ["frame", "i"], "left")
    return joined.select("frame", "i", F.coalesce("found", F.array().cast("array<bigint>")).alias("neighbors"))
