"""Trajectory formats of the MDAnalysis readers, where that library is installed: frames are read by tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from tesserspark.functions.box import ANGLES, H, LENGTHS
from tesserspark.sources.trajectory import Trajectory

#: Frames that one task reads.
FRAMES_A_TASK = 16


def library():
    """The reader library, or an error that says what else there is."""
    try:
        import MDAnalysis
    except ImportError:
        raise ValueError("this format needs MDAnalysis, which is not installed; XYZ and Parquet are read without it") from None
    return MDAnalysis


def labels(universe, attribute: str) -> list[str]:
    """What names the atoms: the attribute asked for, else the first of elements, names and types that all atoms have."""
    for name in ("elements", "names", "types") if attribute == "auto" else (attribute,):
        found = [str(v) for v in getattr(universe.atoms, name, ())]
        if found and all(found):
            return found
    raise ValueError(f"the atoms have no {attribute!r} to name their species")


def read_frames(universe, rows: list[tuple[int, int]], attribute: str) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Atoms and (frame, source frame, lengths and angles) of (frame, source frame)."""
    names = labels(universe, attribute)
    for frame, source in rows:
        step = universe.trajectory[source]
        xyz = np.asarray(universe.atoms.positions, float)
        cell = (None,) * 6 if step.dimensions is None else tuple(map(float, step.dimensions))
        atoms = [pa.array(np.full(len(names), frame)), pa.array(np.arange(len(names))), pa.array(names), *(pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3))]
        yield pa.RecordBatch.from_arrays(atoms, names=["frame", "atom", "species", "x", "y", "z"]), (frame, source, *cell)


def load(spark: SparkSession, topology: str, coordinates: str | None, frames, box, attribute: str, format: str | None, topology_format: str | None, options: dict) -> Trajectory:
    from tesserspark.sources.xyz import ATOMS, _selected, box_matrix

    reader = library()
    files = (topology,) if coordinates is None else (topology, coordinates)
    options = {**options, **({"format": format} if format else {}), **({"topology_format": topology_format} if topology_format else {})}
    chosen = _selected(len(reader.Universe(*files, **options).trajectory), frames)
    if not chosen:
        raise ValueError("frames must select at least one frame")

    def opened(batches: Iterator[pa.RecordBatch]):
        universe = library().Universe(*files, **options)
        for batch in batches:
            yield from read_frames(universe, list(zip(*(c.to_pylist() for c in batch.columns))), attribute)

    def atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (batch for batch, _ in opened(batches))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row in opened(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(("frame", "source_frame", *LENGTHS, *ANGLES), row))])

    listed = spark.createDataFrame(list(enumerate(chosen)), "frame long, source long").repartitionByRange(-(-len(chosen) // FRAMES_A_TASK), "frame")
    if box is None:
        table = listed.mapInArrow(cells, "frame long, source_frame long, " + ", ".join(f"{c} double" for c in (*LENGTHS, *ANGLES)))
    else:
        table = listed.select("frame", F.col("source").alias("source_frame"), *[F.lit(v).alias(h) for h, v in zip(H, box_matrix(box))])
    return Trajectory.from_dataframe(listed.mapInArrow(atoms, ATOMS), table, filename=coordinates or topology)
