"""XYZ and extended-XYZ files: frames found by tasks, read in Arrow batches; order checks and normalization.

A frame's head is a line with nothing but a number, which no line of an atom is, though a comment may
be.  Tasks scan byte ranges for such lines; the driver follows the heads from the first on, each by the
line number that the one before gives, so a comment is never taken for a head.  What it holds is one
row a frame.  Atoms are read by tasks that seek to their frames, so frames that are not asked for are
never read.  Files may lie on any file system that ``pyarrow.fs`` opens by its address.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserspark.functions.box import H
from tesserspark.sources.trajectory import Trajectory

_KEY = {k: re.compile(rf'{k}\s*=\s*(?:"([^"]*)"|(\S+))', re.I) for k in ("Lattice", "Origin", "Properties")}
#: Bytes of a range that a task scans for heads, and of the frames that one partition of atoms holds, about.
RANGE_BYTES, PARTITION_BYTES = 64 << 20, 16 << 20
ATOMS = "frame long, atom long, species string, x double, y double, z double"


def header_value(line: str, key: str) -> str | None:
    m = _KEY[key].search(line)
    return None if m is None else (m[1] if m[1] is not None else m[2])


def columns_of(line: str) -> tuple[int, int]:
    """(species column, first position column) by ``Properties``; species x y z if it is missing or malformed."""
    parts = (header_value(line, "Properties") or "").split(":")
    if len(parts) < 3 or len(parts) % 3:
        return 0, 1
    at, species, position = 0, None, None
    for name, _, count in zip(parts[::3], parts[1::3], parts[2::3]):
        if not count.isdigit():
            return 0, 1
        if name.lower() in ("species", "element", "type") and species is None:
            species = at
        if name.lower() in ("pos", "position", "positions") and count == "3":
            position = at
        at += int(count)
    return (0, 1) if species is None or position is None else (species, position)


def lattice_of(line: str) -> list[float] | None:
    text = header_value(line, "Lattice")
    if text is None:
        return None
    v = [float(x) for x in text.split()]
    if len(v) == 3:
        return [v[0], 0.0, 0.0, 0.0, v[1], 0.0, 0.0, 0.0, v[2]]
    if len(v) != 9:
        raise ValueError("Lattice must have 3 or 9 numbers")
    return v


def origin_of(line: str) -> list[float] | None:
    text = header_value(line, "Origin")
    if text is None:
        return None
    v = [float(x) for x in text.split()]
    if len(v) != 3:
        raise ValueError("Origin must have 3 numbers")
    return v


@dataclass(frozen=True)
class FrameOffset:
    index: int
    offset: int
    size: int  # bytes
    atoms: int
    comment: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def scan_range(path: str, begin: int, end: int, chunk: int = 8 << 20) -> tuple[int, list[tuple[int, int, int, str]], list[int]]:
    """Of the lines that begin in [begin, end): how many, the possible heads (line, offset, number, next line), and the blank ones."""
    where, name = _opened(path)
    lines, heads, blank = 0, [], []
    with where.open_input_file(name) as f:
        at = begin
        if begin:  # the first line that begins here comes after the line break before it
            f.seek(begin - 1)
            rest = f.read(chunk)
            at = begin - 1
            while b"\n" not in rest and rest:
                at += len(rest)
                rest = f.read(chunk)
            at = at + rest.index(b"\n") + 1 if rest else end
        while at < end:
            f.seek(at)
            data = f.read(chunk)
            if not data:
                break
            while data.count(b"\n") < 2 and (more := f.read(chunk)):
                data += more
            last = at + len(data) >= f.size()
            stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            if last and (not len(stops) or stops[-1] != len(data) - 1):
                stops = np.append(stops, len(data))
            begins = np.concatenate(([0], stops[:-1] + 1))
            inside = begins + at < end
            if not last:
                inside[-1] = False  # its next line may lie beyond what was read
            for k in np.flatnonzero(inside & (stops - begins <= 24)):  # a head is short
                line = data[begins[k] : stops[k]].strip()
                if line.isdigit():
                    after = data[begins[k + 1] : stops[k + 1]] if k + 1 < len(begins) else b""
                    heads.append((lines + int(k), int(at + begins[k]), int(line), after.decode("utf-8", "replace").rstrip("\r")))
                elif not line:
                    blank.append(lines + int(k))
            n = int(inside.sum())
            if n == 0:
                break
            lines += n
            at += int(stops[n - 1]) + 1
    return lines, heads, blank


def _chained(path: str, size: int, ranges: Iterable[tuple[int, int, list, list]]) -> list[FrameOffset]:
    """The frames from what the scans of all ranges found; a file that breaks off within a frame is an error, not a shorter trajectory."""
    total, found, blank = 0, {}, set()
    for _, lines, heads, empty in sorted(ranges):
        found |= {total + line: (offset, n, comment) for line, offset, n, comment in heads}
        blank |= {total + line for line in empty}
        total += lines
    out, line = [], 0
    while line < total:
        if line in blank:
            line += 1
            continue
        if line not in found:
            raise ValueError(f"frame {len(out)} of {path} does not begin with an atom count")
        offset, n, comment = found[line]
        if line + 2 + n > total or blank and not blank.isdisjoint(range(line + 2, line + 2 + n)):
            raise ValueError(f"frame {len(out)} of {path} is incomplete")
        out.append((offset, n, comment))
        line += 2 + n
    ends = [offset for offset, _, _ in out[1:]] + [size]
    return [FrameOffset(k, offset, stop - offset, n, comment) for k, ((offset, n, comment), stop) in enumerate(zip(out, ends))]


def _size(path: str) -> int:
    where, name = _opened(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def frame_offsets(path: str, spark: SparkSession | None = None, range_bytes: int = RANGE_BYTES) -> list[FrameOffset]:
    """The frames of a file; with a session, tasks scan it range by range."""
    size = _size(path)
    ranges = [(k, min(size, k + range_bytes)) for k in range(0, size, range_bytes)]
    if spark is None or len(ranges) < 2:
        return _chained(path, size, [(a, *scan_range(path, a, b)) for a, b in ranges])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, heads, blank = scan_range(path, a, b)
                yield pa.RecordBatch.from_pylist([{"begin": a, "lines": lines, "heads": [dict(zip(("line", "offset", "n", "comment"), h)) for h in heads], "blank": blank}], schema=made)

    head = pa.struct([("line", pa.int64()), ("offset", pa.int64()), ("n", pa.int64()), ("comment", pa.string())])
    made = pa.schema([("begin", pa.int64()), ("lines", pa.int64()), ("heads", pa.list_(head)), ("blank", pa.list_(pa.int64()))])
    listed = spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges))
    rows = listed.mapInArrow(scan, "begin long, lines long, heads array<struct<line: long, offset: long, n: long, comment: string>>, blank array<long>").collect()  # a row a range, an entry a frame
    return _chained(path, size, [(r["begin"], r["lines"], [tuple(h) for h in r["heads"]], list(r["blank"])) for r in rows])


def _parsed(data: bytes, frame: int, n: int) -> pa.RecordBatch:
    """The atoms of a frame, from its bytes."""
    head = data.split(b"\n", 2)
    species, position = columns_of(head[1].decode("utf-8", "replace"))
    words = head[2].split()
    if n and len(words) % n == 0 and len(words) // n > max(species, position + 2):
        width = len(words) // n
        names, xyz = words[species::width], [np.array(words[position + k :: width], float) for k in range(3)]
    else:  # lines of unequal length
        rows = [line.split() for line in head[2].split(b"\n")[:n]]
        names, xyz = [r[species] for r in rows], [np.array([r[position + k] for r in rows], float) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, frame)), pa.array(np.arange(n)), pa.array([x.decode() for x in names], pa.string()), *map(pa.array, xyz)], names=["frame", "atom", "species", "x", "y", "z"])


def _read(path: str, frames: Iterable[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Atoms of frames (frame, offset, size, atoms)."""
    where, name = _opened(path)
    with where.open_input_file(name) as f:
        for frame, offset, size, n in frames:
            f.seek(offset)
            yield _parsed(f.read(size), frame, n)


def read_atoms(spark: SparkSession, path: str, frames: Sequence[FrameOffset], partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(frame, atom, species, x, y, z) of the given frames, numbered in their order."""
    rows = [(k, f.offset, f.size, f.atoms) for k, f in enumerate(frames)]
    parts = max(1, min(len(rows), -(-sum(f.size for f in frames) // partition_bytes)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _read(path, zip(*(c.to_pylist() for c in batch.columns)))

    listed = spark.createDataFrame(rows, "frame long, offset long, size long, atoms long")
    return listed.repartitionByRange(parts, "frame").mapInArrow(read, ATOMS)


@dataclass
class _Frames(InputPartition):
    frames: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        wanted = options.get("frames")
        self.wanted = None if wanted is None else [int(x) for x in wanted.split(",") if x]

    def partitions(self) -> list[InputPartition]:
        known = frame_offsets(self.path)
        chosen = range(len(known)) if self.wanted is None else self.wanted
        out, held = [[]], 0
        for k, s in enumerate(chosen):
            if held >= PARTITION_BYTES:
                out.append([])
                held = 0
            out[-1].append((k, known[s].offset, known[s].size, known[s].atoms))
            held += known[s].size
        return [_Frames(rows) for rows in out]

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition.frames)


class XYZDataSource(DataSource):
    """``spark.read.format("xyz").option("frames", "0,2").load(path)``; the path must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "xyz"

    def schema(self) -> str:
        return ATOMS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _selected(count: int, frames) -> list[int]:
    if frames is None:
        return list(range(count))
    if isinstance(frames, slice):
        if any(v is not None and v < 0 for v in (frames.start, frames.stop)):
            raise ValueError("source frame slices must not have negative bounds")
        return list(range(count))[frames]
    out = [int(k) for k in frames]
    if any(k < 0 or k >= count for k in out):
        raise IndexError("source frame index is out of range")
    if len(set(out)) != len(out):
        raise ValueError("source frame indices must be unique")
    return out


def box_matrix(box: float | Sequence[float]) -> list[float]:
    """Row vectors of a box given as one length, three lengths, or lengths and angles."""
    v = [float(box)] * 3 if isinstance(box, (int, float)) else [float(x) for x in box]
    if len(v) == 3:
        v += [90.0] * 3
    if len(v) != 6 or not all(math.isfinite(x) and x > 0 for x in v):
        raise ValueError("box must be a positive scalar or have 3 or 6 positive numbers")
    a, b, c, *angles = v
    ca, cb, cg = (0.0 if abs(x - 90) <= 1e-7 else math.cos(math.radians(x)) for x in angles)
    sg = math.sqrt(1 - cg * cg)
    cy = c * (ca - cb * cg) / sg
    return [a, 0.0, 0.0, b * cg, b * sg, 0.0, c * cb, cy, math.sqrt(c * c - (c * cb) ** 2 - cy * cy)]


def _with_box(frames: DataFrame, box) -> DataFrame:
    """The frames with one cell for all, if a box is given."""
    if box is None:
        return frames
    kept = [c for c in frames.columns if c not in {*H, "a", "b", "c", "alpha", "beta", "gamma"}]
    return frames.select(*kept, *[F.lit(v).alias(h) for h, v in zip(H, box_matrix(box))])


def _from_parquet(spark, path: str, frames, box, shift_by_origin: bool, attribute: str) -> Trajectory:
    atoms = spark.read.parquet(f"{path}/atoms")
    named = [attribute] if attribute != "auto" else [c for c in ("species", "elements", "names", "types") if c in atoms.columns]
    if not named or named[0] not in atoms.columns:
        raise ValueError(f"the atoms have no column {attribute!r} to name their species")
    if named[0] != "species":
        atoms = atoms.drop("species").withColumnRenamed(named[0], "species")
    whole = Trajectory.from_dataframe(atoms, _with_box(spark.read.parquet(f"{path}/frames"), box), filename=path, shift_by_origin=shift_by_origin)
    return whole if frames is None else whole.select_frames(_selected(len(whole), frames))


def _from_xyz(spark, path: str, frames, box, shift_by_origin: bool) -> Trajectory:
    known = frame_offsets(path, spark)
    chosen = [known[k] for k in _selected(len(known), frames)]
    if not chosen:
        raise ValueError("frames must select at least one frame")
    given = None if box is None else box_matrix(box)
    rows = []
    for k, s in enumerate(chosen):
        cell = given or lattice_of(s.comment)
        if cell is None:
            raise ValueError(f"source frame {s.index} has no Lattice; pass box=")
        rows.append((k, s.index, *cell, *(origin_of(s.comment) or (None, None, None))))
    schema = "frame long, source_frame long, " + ", ".join(f"{h} double" for h in H) + ", ox double, oy double, oz double"
    return Trajectory.from_dataframe(read_atoms(spark, path, chosen), spark.createDataFrame(rows, schema), filename=path, shift_by_origin=shift_by_origin)


XYZ = ("xyz", "extxyz", "exyz")


def load_trajectory(
    topology, coordinates=None, *, frames=None, box=None, shift_by_origin=False, atom_attribute="auto", normalize_species_order="auto", format=None, topology_format=None, spark: SparkSession | None = None, **universe_kwargs
) -> Trajectory:
    """A trajectory from an XYZ file, a Parquet folder (atoms and frames), an existing one, or another format where its library is installed.

    With ``coordinates`` the atoms lie where that file has them and are named as in the topology's first
    frame.  ``box`` is the cell of all frames, whatever the files say.  ``atom_attribute`` names the
    column that holds the species (Parquet, other formats).  If ``normalize_species_order`` is True, or
    is "auto" and sampled frames of an XYZ file differ in it, atoms are numbered by species.
    """
    if normalize_species_order not in ("auto", True, False):
        raise ValueError(f"normalize_species_order is {normalize_species_order!r}, not 'auto', True or False")
    spark = spark or SparkSession.active()
    if isinstance(topology, Trajectory):
        if coordinates is not None:
            raise ValueError("a trajectory has its own coordinates")
        whole = topology if box is None else Trajectory.from_dataframe(topology.atoms, _with_box(topology.frames.select(*[c for c in topology.frames.columns if c in ("frame", "source_frame", "ox", "oy", "oz")]), box), filename=topology.filename)
        return whole.select_frames(frames)
    path = os.fspath(coordinates if coordinates is not None else topology)
    kind = (format or os.path.splitext(path)[1].lstrip(".")).lower()
    top = os.fspath(topology)
    top_kind = kind if coordinates is None else (topology_format or os.path.splitext(top)[1].lstrip(".")).lower()
    if kind not in (*XYZ, "parquet") or top_kind not in (*XYZ, "parquet"):
        from tesserspark.sources import universe

        return universe.load(spark, top, None if coordinates is None else path, frames, box, atom_attribute, format, topology_format, universe_kwargs)
    if kind == "parquet":
        found = _from_parquet(spark, path, frames, box, shift_by_origin, atom_attribute)
    else:
        found = _from_xyz(spark, path, frames, box, shift_by_origin)
    if coordinates is not None:
        first = _from_parquet(spark, top, [0], (1, 1, 1), False, atom_attribute) if top_kind == "parquet" else _from_xyz(spark, top, [0], (1, 1, 1), False)
        if first.n_atoms != found.n_atoms:
            raise ValueError(f"the topology has {first.n_atoms} atoms, the coordinates {found.n_atoms}")
        names = first.atoms.select(F.col("atom").alias("named"), F.col("species").alias("label"))
        labelled = found.atoms.join(names, F.col("atom") == F.col("named")).select("frame", "atom", F.col("label").alias("species"), "x", "y", "z")
        return Trajectory(found.frames, labelled, found.filename, found.metadata)
    if normalize_species_order is True or normalize_species_order == "auto" and kind in XYZ and xyz_has_variable_species_order(path, spark=spark):
        return Trajectory(found.frames, normalized(found.atoms), found.filename, {**found.metadata, "normalized_species_order": True})
    return found


def xyz_has_variable_species_order(filename, sample_frames=(0, 1, 10, 100), spark: SparkSession | None = None) -> bool:
    """Whether a sampled frame lists its species in another order than the first."""
    spark = spark or SparkSession.active()
    path = os.fspath(filename)
    known = frame_offsets(path, spark)
    chosen = [known[k] for k in sorted({0, *(k for k in sample_frames if 0 <= k < len(known))})] if known else []
    if len({f.atoms for f in chosen}) > 1:
        return True
    orders = {tuple(batch.column(2).to_pylist()) for batch in _read(path, [(0, f.offset, f.size, f.atoms) for f in chosen])}  # a few sampled frames
    return len(orders) > 1


def xyz_needs_column_normalization(filename, spark: SparkSession | None = None) -> bool:
    """Whether the first frame's columns are not species, x, y, z at the beginning of the line."""
    known = frame_offsets(os.fspath(filename), spark)
    return bool(known) and columns_of(known[0].comment) != (0, 1)


def normalized(atoms: DataFrame, frame: str = "frame") -> DataFrame:
    """Atoms renumbered so that species stand together, in the order they first appear in the first frame; stable within a species."""
    least = atoms.agg(F.min(frame).alias("least"))
    ranks = atoms.join(F.broadcast(least), F.col(frame) == F.col("least"), "left_semi").groupBy("species").agg(F.min("atom").alias("rank")).withColumnRenamed("species", "s0")
    order = Window.partitionBy(frame).orderBy(F.col("rank").asc_nulls_last(), "species", "atom")
    return atoms.join(F.broadcast(ranks), F.col("species") == F.col("s0"), "left").withColumn("place", F.row_number().over(order) - 1).select(frame, F.col("place").cast("long").alias("atom"), "species", "x", "y", "z")


def normalize_xyz_species_order(filename, output_filename=None, spark: SparkSession | None = None) -> str:
    """Writes the normalized trajectory as a Parquet folder (atoms, frames) and returns its path; reused while the source file is the same.

    It is written beside its place and moved there when it is whole, so the folder is whole or not there.
    """
    spark = spark or SparkSession.active()
    path = os.fspath(filename)
    where, name = _opened(path)
    info = where.get_file_info(name)
    key = hashlib.sha1(f"{name}|{info.size}|{info.mtime_ns}".encode()).hexdigest()[:16]
    out = os.fspath(output_filename) if output_filename else f"{path}.{key}.parquet"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(out)
    disk = final.getFileSystem(conf)
    if disk.exists(jvm.org.apache.hadoop.fs.Path(f"{out}/frames/_SUCCESS")):
        return out
    t = load_trajectory(path, normalize_species_order=False, spark=spark)
    draft = f"{out}.{uuid.uuid4().hex}"
    normalized(t.atoms).repartitionByRange("frame").write.parquet(f"{draft}/atoms")
    t.frames.select("frame", "source_frame", *H, "ox", "oy", "oz").write.parquet(f"{draft}/frames")
    if not disk.rename(jvm.org.apache.hadoop.fs.Path(draft), final):
        disk.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
        raise OSError(f"cannot move the normalized trajectory to {out}")
    return out
