"""Periodic cells as column expressions.

``frames`` carries the cell matrix h (rows are the vectors), its inverse g, the volume and the safe
radius; displacements are wrapped through fractional coordinates, which is the nearest image for any
pair within the safe radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

H = [f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
G = [f"g{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
LENGTHS = ["a", "b", "c"]
ANGLES = ["alpha", "beta", "gamma"]


def _cos(angle: Column) -> Column:
    return F.when(F.abs(angle - 90) <= 1e-7, 0.0).otherwise(F.cos(F.radians(angle)))


def cell_matrix(frames: DataFrame) -> DataFrame:
    """Adds h11..h33 from lengths and angles: the first vector along x, the second in the xy plane."""
    a, b, c = (F.col(x).cast("double") for x in LENGTHS)
    ca, cb, cg = (_cos(F.col(x).cast("double")) for x in ANGLES)
    sg = F.sqrt(1 - cg * cg)
    cy = c * (ca - cb * cg) / sg
    cx = c * cb
    zero = F.lit(0.0)
    values = [a, zero, zero, b * cg, b * sg, zero, cx, cy, F.sqrt(c * c - cx * cx - cy * cy)]
    return frames.withColumns(dict(zip(H, values)))


def with_inverse(frames: DataFrame) -> DataFrame:
    """Adds g11..g33, volume, perpendicular widths w1..w3 and safe_radius to frames that have h11..h33."""
    h = {x: F.col(x) for x in H}

    def minor(i: int, j: int) -> Column:
        r = [k for k in (1, 2, 3) if k != i]
        s = [k for k in (1, 2, 3) if k != j]
        value = h[f"h{r[0]}{s[0]}"] * h[f"h{r[1]}{s[1]}"] - h[f"h{r[0]}{s[1]}"] * h[f"h{r[1]}{s[0]}"]
        return value if (i + j) % 2 == 0 else -value

    det = h["h11"] * minor(1, 1) + h["h12"] * minor(1, 2) + h["h13"] * minor(1, 3)
    one = frames.withColumn("__det", det)
    two = one.withColumns({f"g{i}{j}": minor(j, i) / F.col("__det") for i in (1, 2, 3) for j in (1, 2, 3)} | {"volume": F.abs("__det")})
    widths = {f"w{k}": 1 / F.sqrt(sum((F.col(f"g{i}{k}") ** 2 for i in (2, 3)), F.col(f"g1{k}") ** 2)) for k in (1, 2, 3)}
    three = two.withColumns(widths).drop("__det")
    half = (F.least("w1", "w2", "w3") / 2).cast("float").cast("double")
    # times 1 - 2**-24, rounded to a float, is the next float toward zero
    return three.withColumn("safe_radius", (half * (1 - 2.0**-24)).cast("float").cast("double"))


def fractional(x: Column, y: Column, z: Column, axis: int) -> Column:
    return x * F.col(f"g1{axis}") + y * F.col(f"g2{axis}") + z * F.col(f"g3{axis}")


def cartesian(f1: Column, f2: Column, f3: Column, axis: int) -> Column:
    return f1 * F.col(f"h1{axis}") + f2 * F.col(f"h2{axis}") + f3 * F.col(f"h3{axis}")


def image(f: Column) -> Column:
    """The integer translation that brings a fractional displacement nearest to zero."""
    return F.floor(f + 0.5)
