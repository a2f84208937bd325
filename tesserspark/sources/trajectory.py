"""Trajectories: a table of frames with their cells and a table of atoms, both lazy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from tesserspark.functions import box as cells
from tesserspark.sources.selections import selected

#: Frames that a selection lists in its predicate; more are joined.
MOST_LISTED = 1_000


@dataclass(frozen=True)
class TrajectoryFrame:
    """One frame's atoms, brought to the driver."""

    index: int
    source_index: int
    species: list
    positions: list
    dimensions: tuple
    origin: tuple | None = None

    def positions_of(self, species: str) -> list:
        return [p for s, p in zip(self.species, self.positions) if s == species]


@dataclass(frozen=True)
class Trajectory:
    """frames(frame, source_frame, cell columns) and atoms(frame, atom, species, x, y, z)."""

    frames: DataFrame
    atoms: DataFrame
    filename: str | None = None
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_dataframe(cls, atoms: DataFrame, frames: DataFrame, *, filename: str | None = None, shift_by_origin: bool = False) -> Trajectory:
        """Frames need ``frame`` and lengths a, b, c (angles default to 90 degrees), or h11..h33; ox, oy, oz are optional."""
        if "source_frame" not in frames.columns:
            frames = frames.withColumn("source_frame", F.col("frame"))
        if "h11" not in frames.columns:
            for angle in cells.ANGLES:
                if angle not in frames.columns:
                    frames = frames.withColumn(angle, F.lit(90.0))
            frames = cells.cell_matrix(frames)
        frames = cells.with_inverse(frames)
        xyz = {k: F.col(k).cast("double") for k in "xyz"}
        atoms = atoms.select(F.col("frame").cast("long").alias("frame"), F.col("atom").cast("long").alias("atom"), F.col("species").cast("string").alias("species"), *[v.alias(k) for k, v in xyz.items()])
        if shift_by_origin and "ox" in frames.columns:
            origin = frames.select(F.col("frame").alias("__f"), "ox", "oy", "oz")
            moved = atoms.join(origin, F.col("frame") == F.col("__f"))
            atoms = moved.select("frame", "atom", "species", *[(F.col(k) - F.coalesce(F.col("o" + k), F.lit(0.0))).alias(k) for k in "xyz"])
        return cls(frames, atoms, filename)

    @cached_property
    def extent(self) -> Row:
        """What plans need to know of all frames, in one pass: their number, the first, the tightest (safe_radius, source_frame), mean volume and mean inverse volume."""
        tightest = F.min(F.struct("safe_radius", "source_frame")).alias("tightest")
        return self.frames.agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), tightest, F.avg("volume").alias("volume"), F.avg(1 / F.col("volume")).alias("inverse")).first()

    @cached_property
    def _first(self) -> dict[str, int]:
        return dict(sorted(self.atoms.where(F.col("frame") == self.extent["first"]).groupBy("species").count().collect()))

    @property
    def species(self) -> tuple[str, ...]:
        return tuple(self._first)

    @property
    def atom_counts(self) -> dict[str, int]:
        return dict(self._first)

    @property
    def n_atoms(self) -> int:
        return sum(self._first.values())

    @cached_property
    def frame_index(self) -> list[tuple[int, int]]:
        """(frame, source frame) in order; one row per frame."""
        return [tuple(r) for r in self.frames.select("frame", "source_frame").orderBy("frame").collect()]

    def __len__(self) -> int:
        return len(self.frame_index)

    @property
    def dimensions(self) -> tuple | None:
        row = self.frames.orderBy("frame").first()
        return None if row is None else tuple(row[x] for x in (cells.LENGTHS + cells.ANGLES)) if "a" in row.asDict() else tuple(row[x] for x in cells.H)

    def close(self) -> None:
        """Nothing is held open."""

    def __enter__(self) -> Trajectory:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def resolve_frame_indices(self, frames: slice | Sequence[int] | None) -> tuple[int, ...]:
        """Logical frames in the order asked for; negative ones count from the end."""
        known = [f for f, _ in self.frame_index]
        if frames is None:
            return tuple(known)
        if isinstance(frames, slice):
            return tuple(known[frames])
        out = []
        for i in frames:
            if not -len(known) <= int(i) < len(known):
                raise IndexError(f"frame index {i} is out of range")
            out.append(known[int(i)])
        if len(set(out)) != len(out):
            raise ValueError("frame indices must be unique")
        return tuple(out)

    def select_frames(self, frames: slice | Sequence[int] | None) -> Trajectory:
        if frames is None:
            return self
        chosen = list(self.resolve_frame_indices(frames))
        if not chosen:
            raise ValueError("frames must select at least one frame")
        if len(chosen) > MOST_LISTED:  # a long list is a table
            listed = F.broadcast(self.frames.sparkSession.createDataFrame([(k,) for k in chosen], "wanted long"))
            kept = [df.join(listed, F.col("frame") == F.col("wanted"), "left_semi") for df in (self.frames, self.atoms)]
        else:
            kept = [df.where(F.col("frame").isin(chosen)) for df in (self.frames, self.atoms)]
        return Trajectory(*kept, self.filename, self.metadata)

    def select_atoms(self, selection: str, *others: str, where: str | None = None) -> Trajectory:
        """Atoms of any of the selections, in the language of ``selections``; ``where`` is a further SQL predicate on the atoms' columns."""
        keep = selected(selection)
        for other in others:
            keep = keep | selected(other)
        keep = keep if where is None else keep & F.expr(where)
        return Trajectory(self.frames, self.atoms.where(keep), self.filename, self.metadata)

    def positions_of(self, species: str) -> DataFrame:
        return self.atoms.where(F.col("species") == species)

    def frame(self, index: int) -> TrajectoryFrame:
        k = self.resolve_frame_indices([index])[0]
        rows = self.atoms.where(F.col("frame") == k).orderBy("atom").collect()
        cell = self.frames.where(F.col("frame") == k).first().asDict()
        origin = tuple(cell[x] for x in ("ox", "oy", "oz")) if cell.get("ox") is not None else None
        dims = tuple(cell.get(x) for x in cells.LENGTHS + cells.ANGLES)
        return TrajectoryFrame(k, cell["source_frame"], [r["species"] for r in rows], [(r["x"], r["y"], r["z"]) for r in rows], dims, origin)

    def iter_frames(self, frames=None):
        for k in self.resolve_frame_indices(frames):
            yield self.frame([f for f, _ in self.frame_index].index(k))


def project_embeddings(spark: SparkSession, sf_dir: str, side: float = 20.0) -> Trajectory:
    """A trajectory from the embeddings table: 21 frames of three components each, one atom per vector, in a cube."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spread = vectors.select(F.col("vec_id").cast("long").alias("atom"), F.col("label").cast("int").alias("label"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("f"))

    def coordinate(k: int):
        e = 97 * F.get("embedding", 3 * F.col("f") + k).cast("double")
        return side * (e - F.floor(e))

    species = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("label") % 3 + 1)
    atoms = spread.select(F.col("f").cast("long").alias("frame"), "atom", species.alias("species"), coordinate(0).alias("x"), coordinate(1).alias("y"), coordinate(2).alias("z"))
    frames = spark.range(21).select(F.col("id").alias("frame"), F.lit(side).alias("a"), F.lit(side).alias("b"), F.lit(side).alias("c"))
    return Trajectory.from_dataframe(atoms, frames)
