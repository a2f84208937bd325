"""Frames cut into blocks, each worked on by one Arrow group where its pairs are too many to be rows.

A block holds its own atoms and those within reach around it, so the shuffle carries atoms and what a
group gives back: counts, or the few links that hold a block together.  Inside, atoms lie in finer
cells, sorted, and a cell meets the cells around as one run of candidates after the other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserspark.functions import box as cells
from tesserspark.plans.neighbors import check_radius, join_partitions
from tesserspark.sources.trajectory import Trajectory

#: Atoms that a block holds about, unless its reach asks for more; and those of a cell inside.
BLOCK_ATOMS, CELL_ATOMS = 4_000, 48
#: Pairs whose distances are held at once.
CHUNK = 1 << 16


class Block:
    """One block's atoms with the images that lie within reach, sorted by cell, kind and number.

    ``atom``, ``kind`` (number of the species), ``f`` (fractions as given), ``turn`` (the cell vectors
    added to them) and ``base`` (the atom's row) hold a value an image.
    """

    def __init__(self, head: dict, atoms: pa.Table, reach: float, half: bool, rounds: int = 1):
        self.half, self.reach = half, reach
        self.h = np.array([head[x] for x in cells.H], float).reshape(3, 3)
        width = np.array([head[f"w{k}"] for k in (1, 2, 3)])
        blocks, place = np.array([head[f"n{k}"] for k in (1, 2, 3)]), np.array([head[f"b{k}"] for k in (1, 2, 3)])
        f = np.stack([atoms.column(f"f{k}").to_numpy() for k in (1, 2, 3)], 1)
        ids, kinds = atoms.column("atom").to_numpy(), atoms.column("kind").to_numpy().astype(np.int16)
        inside = max(1, head["n_atoms"]) / head["volume"]
        side = max((CELL_ATOMS / inside) ** (1 / 3), reach / 6)
        fine = np.maximum(1, (width / blocks / side).astype(int))  # cells of a block along each axis
        whole = blocks * fine
        steps = np.floor(reach / width * whole + 1e-9).astype(int) + 1  # a cell's neighbors along each axis
        low, high = place * fine - steps * rounds, (place + 1) * fine - 1 + steps * rounds
        if half:
            low[0] = place[0] * fine[0]
        down = np.floor(f)
        own_cell = np.minimum(((f - down) * whole).astype(int), whole - 1)
        self.shape = high - low + 1
        rows, keys = [], []
        spans = [range(int(np.floor(a / n)), int(np.floor(b / n)) + 1) for a, b, n in zip(low, high, whole)]
        met = [{m: (c + m * n >= a) & (c + m * n <= b) for m in span} for c, n, a, b, span in zip(np.ascontiguousarray(own_cell.T), whole, low, high, spans)]
        flat, images = self._key(own_cell - low), list(itertools.product(*spans))
        for m in images:
            rows.append(np.flatnonzero(met[0][m[0]] & met[1][m[1]] & met[2][m[2]]))
            keys.append(flat[rows[-1]] + self._key(np.array(m) * whole))
        base, key, image = np.concatenate(rows), np.concatenate(keys), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, kinds))] = np.arange(len(ids))
        order = np.argsort(key * max(1, len(ids)) + rank[base])
        base, key = base[order], key[order]
        self.base, self.turn = base, np.array(images)[image[order]] - down[base].astype(int)
        self.f, self.atom, self.kind = f[self.base], ids[self.base], kinds[self.base]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=int(self.shape.prod())))])
        # positions about the middle of the block: for reckoning, where exact values follow if they matter
        self.x = (self.f + self.turn - (place + 0.5) / blocks) @ self.h
        first = place * fine - low
        self.own_cells, self.near_cells = ([self._key(np.array(c)) for c in itertools.product(*[range(a - more, a + n + more) for a, n, more in zip(first, fine, steps * k)])] for k in (0, rounds - 1))
        right = np.allclose(self.h, np.diag(np.diag(self.h)), atol=1e-12 * abs(self.h).max())
        gap = width / whole
        around = []
        for d in itertools.product(range(-steps[0], steps[0] + 1), range(-steps[1], steps[1] + 1)):
            if half and d < (0, 0):
                continue
            free = [max(0, abs(x) - 1) * g for x, g in zip(d, gap)]
            reached = [z for z in range(-steps[2], steps[2] + 1) if (np.hypot(np.hypot(*free), max(0, abs(z) - 1) * gap[2]) if right else 0.0) <= reach + 1e-9]
            if half and d == (0, 0):
                reached = [z for z in reached if z > 0]
            if reached:
                around.append((self._key(np.array([*d, reached[0]])), self._key(np.array([*d, reached[-1]]))))
        self.runs = np.array(around).reshape(-1, 2)

    def _key(self, c: np.ndarray) -> np.ndarray:
        return (c[..., 0] * self.shape[1] + c[..., 1]) * self.shape[2] + c[..., 2]

    def cells(self, keys: list[int] | None = None) -> Iterator[tuple[slice, np.ndarray]]:
        """(own images, candidates) of each cell of the block, or of the cells given; with ``half`` a cell itself is not among its candidates, and each pair of cells comes once."""
        for key in self.own_cells if keys is None else keys:
            a, z = int(self.starts[key]), int(self.starts[key + 1])
            if a == z:
                continue
            begin, end = self.starts[key + self.runs[:, 0]], self.starts[key + self.runs[:, 1] + 1]
            n = end - begin
            total = int(n.sum())
            yield slice(a, z), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(total)

    def own(self) -> np.ndarray:
        """Images that are the block's own atoms."""
        return np.concatenate([np.arange(self.starts[k], self.starts[k + 1]) for k in self.own_cells])

    def steps(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(displacement, squared distance, translation) from images i to images j, as the pair join has them."""
        t = self.turn[j] - self.turn[i]
        d = moved((self.f[j] - self.f[i]) + t, self.h)
        return d, d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2], t

    def pairs(self, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, keys: list[int] | None = None) -> Iterator[list[np.ndarray]]:
        """(i, j, displacement, squared distance, translation) of pairs closer than the reach, some chunks at a time.

        With ``half`` each pair comes once, in whatever order; else from both ends, an atom never with itself.
        ``keep`` says of candidate images (columns of i, rows of j) which are wanted.
        """
        held, n = [], 0
        for chunk in self._chunks(keep, keys):
            held.append(chunk)
            n += len(chunk[0])
            if n > 4 * CHUNK:
                yield [np.concatenate(x) for x in zip(*held)]
                held, n = [], 0
        if n:
            yield [np.concatenate(x) for x in zip(*held)]

    def _chunks(self, keep, keys) -> Iterator[tuple[np.ndarray, ...]]:
        limit, slack = self.reach * self.reach, 1e-9 * max(1.0, self.reach * self.reach)
        for own, others in self.cells(keys):
            if self.half:
                others = np.concatenate([np.arange(own.start, own.stop), others])
            for first in range(own.start, own.stop, max(1, CHUNK // max(1, len(others)))):
                i = np.arange(first, min(own.stop, first + max(1, CHUNK // max(1, len(others)))))
                d2 = sum((self.x[others, k][None] - self.x[i, k][:, None]) ** 2 for k in range(3))
                near = d2 < limit + slack
                if keep is not None:
                    near &= keep(i[:, None], others[None])
                left, right = np.nonzero(near)
                left, right = i[left], others[right]
                apart = left < right if self.half else self.base[left] != self.base[right]
                if self.half:  # candidates beyond the own cell have no part in the order
                    apart |= (right < own.start) | (right >= own.stop)
                left, right = left[apart], right[apart]
                d, exact, t = self.steps(left, right)
                inside = exact < limit
                yield left[inside], right[inside], d[inside], exact[inside], t[inside]


def moved(f: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Cartesian vectors of fractional ones, summed in the order of the columns' expressions."""
    return np.stack([f[..., 0] * h[0, k] + f[..., 1] * h[1, k] + f[..., 2] * h[2, k] for k in range(3)], -1)


def _sides(reach: float, n_atoms: int):
    """Blocks along each axis of a frame: as wide as the reach at least."""
    side = F.greatest(F.lit(float(reach)), F.pow(F.col("volume") * (BLOCK_ATOMS / max(1, n_atoms)), F.lit(1 / 3)))
    return [F.greatest(F.lit(1), F.floor(F.col(f"w{k}") / side)).cast("int").alias(f"n{k}") for k in (1, 2, 3)]


def _number():
    return (F.col("b1").cast("long") * F.col("n2") + F.col("b2")) * F.col("n3") + F.col("b3")


def _parts(trajectory: Trajectory, reach: float, halo: float, n_atoms: int) -> int:
    """Tasks: by the pairs, as of the join, but not more than there are blocks; few blocks a task, as some tasks get more of them than others."""
    spark = trajectory.atoms.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not n_atoms:
        return least
    volume = trajectory.extent["volume"]
    blocks = trajectory.extent["n"] * max(1.0, volume / max(halo**3, volume * BLOCK_ATOMS / n_atoms))
    return max(least, min(math.ceil(blocks), join_partitions(trajectory, reach)))


#: An atom as it goes to a block.
PACKED = np.dtype([("atom", "<i8"), ("kind", "<i4"), ("f1", "<f8"), ("f2", "<f8"), ("f3", "<f8")])


def _packed(batches: Iterator[pa.RecordBatch], half: bool) -> Iterator[pa.RecordBatch]:
    """Of every batch of atoms a row for each block that some of them belong to or are around of, with these atoms as bytes: an atom goes to many blocks, and rows are dear to shuffle and to sort."""
    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        met = []
        for k in (1, 2, 3):  # blocks along an axis; a cell may be as wide as the block, so the ends are those of cells
            f, n, r = (columns[f"{x}{k}"] for x in "fnr")
            u = f - np.floor(f)
            low = np.floor((u - r) * n - 1e-6).astype(np.int64)
            high = np.floor((u if half and k == 1 else u + r) * n + 1e-6).astype(np.int64)
            more = np.minimum(high - low, n - 1)  # each block once
            met.append([((low + step) % n, more >= step) for step in range(int(more.max(initial=-1)) + 1)])
        rows, blocks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (a, is_a), (b, is_b), (c, is_c) in itertools.product(*met):
            rows.append(np.flatnonzero(is_a & is_b & is_c))
            blocks.append((a * columns["n2"] + b)[rows[-1]] * columns["n3"][rows[-1]] + c[rows[-1]])
        row, block = np.concatenate(rows), np.concatenate(blocks)
        order = np.lexsort((block, columns["frame"][row]))
        row, block = row[order], block[order]
        frame = columns["frame"][row]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (frame[1:] != frame[:-1]) | (block[1:] != block[:-1])]))
        held = np.empty(len(row), PACKED)
        for n in PACKED.names:
            held[n] = columns[n][row]
        ends = (np.append(first, len(row)) * PACKED.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(held)])
        yield pa.RecordBatch.from_arrays([pa.array(frame[first], pa.int64()), pa.array(block[first], pa.int64()), packed], ["frame", "block", "packed"])


def by_blocks(trajectory: Trajectory, reach: float, species: list[str], run: Callable[[Block, int], dict | Iterator[dict] | None], schema: str, *, rounds: int = 1, half: bool = False, check: bool = True, stream: bool = False) -> DataFrame:
    """Rows of ``run(block, frame)``, a mapping from the schema's names to columns, for every block of every frame; with ``stream`` as many mappings as it yields, never held together.

    ``reach`` is how far pairs go; the atoms around a block lie within ``rounds`` times as far.  ``kind`` of an atom is the place of its species in ``species``.  ``half``: a block meets only what
    lies on one side of it.
    """
    if check:
        check_radius(trajectory, reach)
    halo = reach * rounds
    spark = trajectory.atoms.sparkSession
    n_atoms = trajectory.n_atoms if trajectory.extent["n"] else 0
    frames = trajectory.frames.select(F.col("frame").alias("__f"), *cells.H, *cells.G, "volume", "w1", "w2", "w3", *_sides(halo, n_atoms))
    kind = F.array_position(F.array(*map(F.lit, species)), F.col("species")).cast("int") - 1
    atoms = trajectory.atoms.where(F.col("species").isin(species)).join(frames, F.col("frame") == F.col("__f"))
    placed = atoms.select(F.col("frame").cast("long").alias("frame"), F.col("atom").cast("long").alias("atom"), kind.alias("kind"), "n1", "n2", "n3", *[(F.lit(halo) / F.col(f"w{k}")).alias(f"r{k}") for k in (1, 2, 3)], *[cells.fractional(F.col("x"), F.col("y"), F.col("z"), k).alias(f"f{k}") for k in (1, 2, 3)])

    located = placed.where(F.col("f1").isNotNull() & F.col("f2").isNotNull() & F.col("f3").isNotNull())
    dealt = located.mapInArrow(lambda batches: _packed(batches, half), "frame long, block long, packed binary")
    heads = frames
    for k in (1, 2, 3):
        heads = heads.withColumn(f"b{k}", F.explode(F.sequence(F.lit(0), F.col(f"n{k}") - 1)))
    heads = heads.select(F.col("__f").alias("frame"), _number().alias("block"), *cells.H, "volume", "w1", "w2", "w3", "n1", "n2", "n3", "b1", "b2", "b3", F.lit(n_atoms).cast("long").alias("n_atoms"))
    arrow = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))])

    def one(atoms: pa.Table, head: pa.Table) -> pa.Table:
        if not len(atoms) or not len(head):
            return arrow.empty_table()
        row = head.to_pylist()[0]
        held = np.concatenate([np.frombuffer(x.as_buffer(), PACKED) for x in atoms.column("packed")])
        table = pa.table({n: np.ascontiguousarray(held[n]) for n in PACKED.names})
        out = run(Block(row, table, reach, half, rounds), row["frame"])
        return arrow.empty_table() if out is None else pa.table([pa.array(out[n], t) for n, t in zip(arrow.names, arrow.types)], schema=arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        row = next((r for r in whole.filter(whole.column("packed").is_null()).drop(["packed"]).to_pylist()), None)
        bytes_ = [x.as_buffer() for x in whole.column("packed") if x.is_valid]
        if row is None or not bytes_:
            return
        held = np.concatenate([np.frombuffer(x, PACKED) for x in bytes_])
        table = pa.table({n: np.ascontiguousarray(held[n]) for n in PACKED.names})
        for out in run(Block(row, table, reach, half, rounds), row["frame"]):
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], t) for n, t in zip(arrow.names, arrow.types)], schema=arrow)

    if stream:  # cogroups give back whole tables, so a block's head comes as one more of its rows
        parts = _parts(trajectory, reach, halo, n_atoms)
        return dealt.unionByName(heads, allowMissingColumns=True).repartition(parts, "frame", "block").groupBy("frame", "block").applyInArrow(each, schema)

    parts = _parts(trajectory, reach, halo, n_atoms)
    sides = [df.repartition(parts, "frame", "block").groupBy("frame", "block") for df in (dealt, heads)]
    return sides[0].cogroup(sides[1]).applyInArrow(one, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


class FineBins:
    """Counts of values by coarse bins from a finer, even grid: all values of a fine bin are in one coarse bin, save where an edge cuts it; those are told by their exact value."""

    def __init__(self, edges: np.ndarray, low: float, high: float, size: int, error: float):
        """``edges`` in the reckoned quantity, ascending; ``error`` bounds the difference between a reckoned and an exact value."""
        self.low, self.scale = low, size / (high - low)
        self.size = int(np.ceil((high - low) * self.scale)) + 3  # one bin below and two above for values that rounding takes out
        middle = (np.arange(self.size) - 0.5) / self.scale + low
        self.place = np.searchsorted(edges, middle, "right") - 1
        self.cut = np.zeros(self.size, bool)
        at, off = (edges - low) * self.scale + 1, error * self.scale + 1e-9
        for a, b in zip(np.floor(at - off), np.floor(at + off)):
            self.cut[max(0, int(a)) : max(0, min(self.size, int(b) + 1))] = True
        self.place[(self.place < 0) | (self.place >= len(edges) - 1)] = -1
        #: What is added to a scaled value before it is cut off.
        self.shift = 1 - low * self.scale

    def coarse(self, counts: np.ndarray, n: int) -> np.ndarray:
        """Coarse counts of the last axis' fine ones, but for the bins that edges cut."""
        flat = counts.reshape(-1, self.size)
        known = (self.place >= 0) & ~self.cut
        return np.stack([np.bincount(self.place[known], row[known], n) for row in flat]).astype(np.int64).reshape(*counts.shape[:-1], n)


def place_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Place among exact edges, the last bin closed; -1 outside."""
    out = np.searchsorted(edges, values, "right") - 1
    out[values == edges[-1]] = len(edges) - 2
    out[(out >= len(edges) - 1) | (values < edges[0])] = -1
    return out
