"""Carbon diffraction: form factor, Debye patterns, peak fits and crystallite sizes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tesserspark.functions import checks, constants
from tesserspark.functions.bins import with_bin


def carbon_xray_form_factor(q) -> np.ndarray:
    q = np.asarray(q, float)
    if not np.isfinite(q).all() or (q < 0).any():
        raise ValueError("q must be finite and nonnegative")
    a, b, c = constants.xray_terms("C")
    s2 = (q / (4 * np.pi)) ** 2
    return sum(x * np.exp(-y * s2) for x, y in zip(a, b)) + c


#: Limits on what one Debye pattern may ask for.
MOST_Q, MOST_BLOCK, MOST_ATOMS, MOST_BINS = 5_000, 1_024, 20_000, 1_000_000


#: Pairs whose distances a group holds at once.
PAIRS = 1 << 16


def debye_histogram(atoms: DataFrame, width: float, key: str = "fragment", block: int = 2_048) -> DataFrame:
    """(key, place, n): unordered pair distances by bin within each fragment; pairs are counted in groups and never are rows.

    The atoms of a fragment are dealt into blocks and blocks meet pairwise, so a large fragment is many tasks.
    """
    blocks = atoms.groupBy(F.col(key).alias("k0")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = atoms.join(blocks, F.col(key) == F.col("k0")).withColumn("own", F.pmod(F.xxhash64("atom"), F.col("blocks")).cast("int"))
    left = dealt.select(key, "atom", "x", "y", "z", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = dealt.select(F.col(key).alias("k2"), F.col("atom").alias("b"), *[F.col(x).alias(f"{x}2") for x in "xyz"], F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i2"), F.col("own").alias("j2"))
    kind = dict(atoms.dtypes)[key]

    def count(names: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        own, total = names[1].as_py() == names[2].as_py(), np.zeros(0, np.int64)
        (p, *m), (q, *n) = ([t.column(x).to_numpy() for x in names] for t, names in ((a, ("atom", "x", "y", "z")), (b, ("b", "x2", "y2", "z2"))))
        rows = max(1, PAIRS // max(1, len(q)))
        for at in range(0, len(p) if len(q) else 0, rows):
            part = slice(at, at + rows)
            d = np.sqrt(sum(((u[part, None] - v[None]) ** 2 for u, v in zip(m[1:], n[1:])), (m[0][part, None] - n[0][None]) ** 2))
            place = np.floor(d / width).astype(np.int64)
            found = np.bincount(place[p[part, None] < q[None]] if own else place.ravel())
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        seen = np.flatnonzero(total)
        keys = pa.array([names[0].as_py()] * len(seen), names[0].type)
        return pa.table({key: keys, "place": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counted = left.groupBy(key, "i", "j").cogroup(right.groupBy("k2", "i2", "j2")).applyInArrow(count, f"`{key}` {kind}, place long, n long")
    return counted.groupBy(key, "place").agg(F.sum("n").alias("n"))


def debye_patterns(atoms: DataFrame, q: Sequence[float], width: float = 0.001, key: str = "fragment") -> DataFrame:
    """(key, q_invA, S_q, I_per_atom, I_per_fragment) of fragments of carbon atoms (key, atom, x, y, z)."""
    spark = atoms.sparkSession
    f2 = carbon_xray_form_factor(q) ** 2
    points = F.broadcast(spark.createDataFrame([(float(x), float(f)) for x, f in zip(np.asarray(q, float), f2)], "q_invA double, f2 double"))
    counts = debye_histogram(atoms, width, key)
    x = F.col("q_invA") * (F.col("place") + 0.5) * width
    kernel = F.when(x == 0, 1.0).otherwise(F.sin(x) / x)
    sums = counts.crossJoin(points).groupBy(key, "q_invA").agg(F.sum(F.col("n") * kernel).alias("s"))
    sizes = atoms.groupBy(key).agg(F.count(F.lit(1)).alias("atoms")).crossJoin(points)
    joined = sizes.join(sums.withColumnsRenamed({key: "k2", "q_invA": "q2"}), (F.col(key) == F.col("k2")) & (F.col("q_invA") == F.col("q2")), "left")
    s = 1 + 2 * F.coalesce("s", F.lit(0.0)) / F.col("atoms")
    return joined.select(key, "q_invA", s.alias("S_q"), (s * F.col("f2")).alias("I_per_atom"), (s * F.col("f2") * F.col("atoms")).alias("I_per_fragment"))


def carbon_debye_pattern(positions, q, *, pair_bin_width_A=0.001, block_size=256, max_atoms=5000, spark: SparkSession | None = None) -> DataFrame:
    """q_invA, S_q, I_per_atom, I_per_fragment of one isolated fragment, in the order of ``q``."""
    x, points = np.asarray(positions, float), np.asarray(q, float)
    if x.ndim != 2 or x.shape[1] != 3 or not len(x) or not np.isfinite(x).all():
        raise ValueError("positions must be finite, with three components each")
    if points.ndim != 1 or not 0 < points.size <= MOST_Q or not np.isfinite(points).all() or (points < 0).any():
        raise ValueError(f"q must be 1 to {MOST_Q} finite values, none of them negative")
    if checks.whole("block_size", block_size) > MOST_BLOCK or checks.whole("max_atoms", max_atoms) > MOST_ATOMS:
        raise ValueError(f"block_size may be {MOST_BLOCK} and max_atoms {MOST_ATOMS} at most")
    if len(x) > max_atoms:
        raise ValueError(f"{len(x)} atoms, exceeding max_atoms={max_atoms}")
    if np.linalg.norm(np.ptp(x, axis=0)) / checks.number("pair_bin_width_A", pair_bin_width_A, above=0) >= MOST_BINS:
        raise ValueError("the pair distances would need more than one million bins")
    spark = spark or SparkSession.active()
    atoms = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(x)], "fragment long, atom long, x double, y double, z double")
    order = spark.createDataFrame([(k, float(v)) for k, v in enumerate(points)], "turn int, qt double")
    curve = debye_patterns(atoms, np.unique(points), pair_bin_width_A)
    return order.join(curve, F.col("qt") == F.col("q_invA")).orderBy("turn").select("q_invA", "S_q", "I_per_atom", "I_per_fragment")


def graphene_discs(spark: SparkSession, sizes: Sequence[float], bond: float) -> DataFrame:
    """Atoms (requested_L_A, fragment, atom, x, y, z) of discs of area L^2 cut from a honeycomb lattice about a hexagon's center."""
    a = bond * math.sqrt(3)
    reach = int(math.ceil(max(sizes) / math.sqrt(math.pi) / a * 1.3)) + 2
    side = spark.range(-reach, reach + 1)
    cells = side.select(F.col("id").alias("i")).crossJoin(side.select(F.col("id").alias("j")))
    basis = spark.createDataFrame([(0, 0.0, bond), (1, 0.0, -bond)], "b int, bx double, by double")
    points = cells.crossJoin(F.broadcast(basis)).select(((F.col("i") + F.col("j") / 2) * a + F.col("bx")).alias("x"), (F.col("j") * a * math.sqrt(3) / 2 + F.col("by")).alias("y"), "i", "j", "b")
    wanted = F.broadcast(spark.createDataFrame([(k, float(s)) for k, s in enumerate(sizes)], "fragment long, requested_L_A double"))
    inside = points.crossJoin(wanted).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= F.col("requested_L_A") * F.col("requested_L_A") / math.pi + 1e-10)
    key = (F.col("i") + reach) * (4 * reach + 4) + (F.col("j") + reach) * 2 + F.col("b")
    return inside.select("requested_L_A", "fragment", key.alias("atom"), "x", "y", F.lit(0.0).alias("z"))


def power_law(sizes: np.ndarray, values: np.ndarray) -> dict:
    """Coefficient and exponent of a line through the logarithms, the exponent's standard error, and the share of variance it explains."""
    x, y = np.log(sizes), np.log(values)
    dx, dy = x - x.mean(), y - y.mean()
    exponent = float(dx @ dy / (dx @ dx))
    rest, spread = float(((dy - exponent * dx) ** 2).sum()), float(dy @ dy)
    return {"coefficient": math.exp(y.mean() - exponent * x.mean()), "exponent": exponent, "exponent_stderr": math.sqrt(rest / (len(x) - 2) / float(dx @ dx)), "log_r_squared": 1 - rest / spread if spread else 0.0}


def calibrate_graphene_diffraction(sizes_A=(8, 10, 15, 22, 30, 40), *, bond_length_A=1.42, q_window=(2.5, 3.6), q_step=0.005, pair_bin_width_A=0.001, max_atoms=5000, spark: SparkSession | None = None) -> dict:
    """Peak intensity of graphene discs by size, and the exponents of power laws through it.

    A disc's size is the root of the area that its atoms have in a sheet.  The fit needs three distinct
    sizes, and peaks inside the window; else the status is ``review`` and there is no exponent.
    """
    spark = spark or SparkSession.active()
    sizes = [checks.number("size", s, above=0) for s in sizes_A]
    if not 3 <= len(sizes) <= 20:
        raise ValueError(f"{len(sizes)} sizes; a calibration takes 3 to 20")
    bond, step = checks.number("bond_length_A", bond_length_A, above=0), checks.number("q_step", q_step, above=0)
    low, high = checks.interval("q_window", *q_window)
    if low == 0 or math.ceil((high - low) / step) >= MOST_Q:
        raise ValueError(f"q_window must begin above 0 and hold at most {MOST_Q} points")
    q = np.linspace(low, high, math.ceil((high - low) / step) + 1)
    area = 3 * math.sqrt(3) * bond**2 / 4  # of an atom in a sheet
    if max(sizes) ** 2 / area > 1.2 * checks.whole("max_atoms", max_atoms):
        raise ValueError(f"a disc of {max(sizes):g} A passes the resource limit of {max_atoms} atoms")
    atoms = graphene_discs(spark, sizes, bond)
    counts = atoms.groupBy("fragment", "requested_L_A").agg(F.count(F.lit(1)).alias("atom_count")).withColumn("area_A2", F.col("atom_count") * area).withColumn("L_A", F.sqrt("area_A2"))
    numbers = [r["atom_count"] for r in counts.collect()]  # 20 rows at most
    if len(numbers) < len(sizes) or max(numbers) > max_atoms:
        raise ValueError(f"a disc is empty or passes the resource limit of {max_atoms} atoms")
    patterns = debye_patterns(atoms.drop("requested_L_A"), q, pair_bin_width_A).join(counts, "fragment")
    order = F.struct(F.col("I_per_fragment"), -F.col("q_invA"))  # of equal heights the first
    highest = [F.max_by("I_per_atom", order).alias("Imax_per_atom"), F.max("I_per_fragment").alias("Imax_per_fragment"), F.max_by("q_invA", order).alias("peak_q_invA")]
    peaks = patterns.groupBy("fragment", "L_A", "requested_L_A", "atom_count", "area_A2").agg(*highest)
    rows = [r.asDict() for r in peaks.withColumn("peak_at_boundary", F.col("peak_q_invA").isin(float(q[0]), float(q[-1]))).orderBy("fragment").drop("fragment").collect()]
    distinct, bounded = len({r["L_A"] for r in rows}) >= 3, any(r["peak_at_boundary"] for r in rows)
    faults = [text for broken, text in ((bounded, "a peak lies on the edge of q_window"), (not distinct, "fewer than three distinct sizes of discs")) if broken]
    summary = {
        "status": "review" if faults else "pass", "reason": "; ".join(faults) or "isolated small discs; larger sizes are an extrapolation", "bond_length_A": bond, "pair_bin_width_A": float(pair_bin_width_A),
        "q_min_invA": low, "q_max_invA": high, "q_step_invA": float(q[1] - q[0]), "size_convention": "sqrt_atom_count_times_bulk_graphene_area_per_atom", "intensity_convention": "coherent_raw_Debye_per_fragment_in_electron_squared",
        "reference_exponent": 2.5, "exponent": None, "coefficient": None, "per_atom_exponent": None, "fragment_count": len(rows), "max_atom_count": max(numbers),
    }
    if not faults:
        actual = np.array([r["L_A"] for r in rows])
        each = power_law(actual, np.array([r["Imax_per_atom"] for r in rows]))
        summary |= power_law(actual, np.array([r["Imax_per_fragment"] for r in rows]))
        summary |= {f"per_atom_{k}": each[k] for k in ("exponent", "exponent_stderr", "log_r_squared")}
    columns = "L_A double, requested_L_A double, atom_count long, area_A2 double, Imax_per_atom double, Imax_per_fragment double, peak_q_invA double, peak_at_boundary boolean, predicted_Imax_per_fragment double"
    fragments = [(*r.values(), None if faults else summary["coefficient"] * r["L_A"] ** summary["exponent"]) for r in rows]
    return {"summary": summary, "fragments": spark.createDataFrame(fragments, columns), "patterns": patterns.select("L_A", "q_invA", "S_q", "I_per_atom", "I_per_fragment")}


def upper_gamma_share(s: float, x: float) -> float:
    """Regularized upper incomplete gamma function: one less a series below s + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b = x + 1 - s
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _largest_deviation(sizes: DataFrame, n: int, support: float, scale: float, cells: int = 256) -> float:
    """Largest distance of the sizes' distribution function from that of the exponential beyond ``support``.

    Distinct sizes are dealt into cells of about equally many, by their quantiles, and summed up within
    each; what lies in the cells before is added to all of a cell.
    """
    ranks = sizes.groupBy("size_A").agg(F.count(F.lit(1)).alias("c"))
    cuts = ranks.agg(F.percentile_approx("size_A", [k / cells for k in range(1, cells)], 10_000).alias("cuts")).first()["cuts"]
    listed = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))])
    celled = ranks.withColumn("cell", F.size(F.filter(listed, lambda x: x < F.col("size_A"))))
    totals = celled.groupBy("cell").agg(F.sum("c").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a cell
    starts = F.broadcast(totals.select(F.col("cell").alias("k"), before.alias("start")))
    upto = F.sum("c").over(Window.partitionBy("cell").orderBy("size_A").rowsBetween(Window.unboundedPreceding, 0))
    stood = celled.withColumn("upto", upto).join(starts, F.col("cell") == F.col("k"))
    model = 1 - F.exp(-(F.col("size_A") - support) / scale)
    top = F.col("start") + F.col("upto")
    return float(stood.agg(F.max(F.greatest(F.abs(model - top / float(n)), F.abs(model - (top - F.col("c")) / float(n))))).first()[0])


#: Bins of a size histogram at most, and the deviation beyond which an exponential fit is to be reviewed.
MOST_SIZE_BINS, DEVIATION = 100_000, 0.2
_SIZE_BINS = "k int, sqrt_area_size_A double, bin_lower_A double, bin_upper_A double, number_fit_density double, weighted_fit_density double"


def summarize_crystallite_size_distribution(sizes_A: DataFrame | Sequence[float], *, intensity_exponent=2.5, minimum_samples=20, support_min_A=None, bin_width_A=1.0, diffraction_size_A=None, spark: SparkSession | None = None) -> dict:
    """Moments by number and by size to a power, their histogram, and an exponential beyond a lower support, by maximum likelihood.

    ``sizes_A`` is a table with a column size_A, or numbers; sizes must be positive.  The curve has a row
    for every bin between the least and the greatest size.  There is no fit for few samples, for fewer
    than five distinct sizes, or for a spread far below the bins; a poor one has the status ``review``.
    """
    spark = spark or (sizes_A.sparkSession if isinstance(sizes_A, DataFrame) else SparkSession.active())
    df = sizes_A.select(F.col("size_A").cast("double").alias("size_A")) if isinstance(sizes_A, DataFrame) else spark.createDataFrame([(float(s),) for s in sizes_A], "size_A double")
    power, width, least_samples = checks.number("intensity_exponent", intensity_exponent, least=0), checks.number("bin_width_A", bin_width_A, above=0), checks.whole("minimum_samples", minimum_samples, 3)
    if diffraction_size_A is not None:
        diffraction_size_A = checks.number("diffraction_size_A", diffraction_size_A, above=0)
    good = F.col("size_A").isNotNull() & ~F.isnan("size_A") & (F.col("size_A") > 0) & (F.col("size_A") < float("inf"))
    first = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("bad"), F.min("size_A").alias("least"), F.max("size_A").alias("most")).first()
    n, least, most = first["n"], first["least"], first["most"]
    if first["bad"]:
        raise ValueError(f"{first['bad']} sizes are not finite and positive")
    support = (least if n else 0.0) if support_min_A is None else checks.number("support_min_A", support_min_A, least=0)
    if n and support > least + 1e-9:
        raise ValueError(f"support_min_A is {support:g}, beyond the least size {least:g}")
    summary = {
        "count": n, "number_mean_A": None, "number_median_A": None, "weighted_mean_A": None, "weighted_empirical_mode_A": None, "exponential_scale_A": None, "weighted_fit_mode_A": None, "fit_status": "unavailable",
        "fit_reason": "there are no sizes", "intensity_exponent": power, "support_min_A": support, "support_origin": "sample_minimum" if support_min_A is None else "caller_specified", "bin_width_A": width, "diffraction_size_A": diffraction_size_A,
    }
    columns = ["sqrt_area_size_A", "bin_lower_A", "bin_upper_A", "count", "number_density", "weighted_density", "number_fit_density", "weighted_fit_density"]
    if not n:
        return {"summary": summary, "curve": spark.createDataFrame([], ", ".join(f"{c} {'long' if c == 'count' else 'double'}" for c in columns))}
    begin = math.floor(least / width)
    bins = math.floor(most / width) + 1 - begin
    if bins > MOST_SIZE_BINS:
        raise ValueError(f"{bins} bins between the least and the greatest size, more than {MOST_SIZE_BINS}")
    edges = begin * width + width * np.arange(bins + 1)

    weight = F.pow(F.col("size_A") / most, F.lit(power))  # relative to the greatest, so no power overflows
    below = [] if diffraction_size_A is None else [F.avg((F.col("size_A") < diffraction_size_A).cast("int")).alias("nb"), (F.sum(F.when(F.col("size_A") < diffraction_size_A, weight).otherwise(0.0)) / F.sum(weight)).alias("wb")]
    m = df.agg(F.avg("size_A").alias("mean"), F.percentile("size_A", 0.5).alias("median"), (F.sum(weight * F.col("size_A")) / F.sum(weight)).alias("weighted"), F.sum(weight).alias("weights"), F.avg(F.col("size_A") - support).alias("scale"), *below).first()
    counted = with_bin(df.withColumn("w", weight), F.col("size_A"), edges, "k").groupBy("k").agg(F.count(F.lit(1)).alias("count"), F.sum("w").alias("w"))
    mode = counted.orderBy(F.col("w").desc(), "k").first()["k"]
    summary |= {"number_mean_A": m["mean"], "number_median_A": m["median"], "weighted_mean_A": m["weighted"], "weighted_empirical_mode_A": float(edges[mode] + edges[mode + 1]) / 2, "min_size_A": least, "max_size_A": most}
    if diffraction_size_A is not None:
        summary |= {"number_fraction_below_diffraction_size": m["nb"], "weighted_fraction_below_diffraction_size": m["wb"]}

    scale, distinct = float(m["scale"]), df.select(F.round("size_A", 6)).distinct().limit(5).count()
    if n < least_samples:
        fault = f"{n} sizes; a fit needs {least_samples}"
    elif distinct < 5 or scale <= max(1e-8, 0.05 * width):
        fault = "the sizes are too few distinct ones, or lie too close to their support"
    else:
        fault = ""
    if fault:
        summary["fit_reason"] = fault
        share = [(None, None)] * bins
    else:
        deviation = _largest_deviation(df, n, support, scale)
        poor = deviation > DEVIATION
        summary |= {
            "fit_status": "review" if poor else "pass", "fit_reason": f"the distribution is {deviation:.2f} from the exponential" if poor else "exponential beyond the support, by maximum likelihood",
            "exponential_scale_A": scale, "weighted_fit_mode_A": max(support, power * scale), "exponential_cdf_max_deviation": deviation, "exponential_cdf_review_threshold": DEVIATION,
        }
        x = np.maximum(edges, support)
        beyond = np.exp(-(x - support) / scale)
        heavy = np.array([upper_gamma_share(power + 1, v / scale) for v in x]) / upper_gamma_share(power + 1, support / scale)
        share = [(float(a), float(b)) for a, b in zip(-np.diff(beyond) / width, -np.diff(heavy) / width)]
    rows = [(k, float(a + b) / 2, float(a), float(b), *fits) for k, (a, b, fits) in enumerate(zip(edges[:-1], edges[1:], share))]
    joined = spark.createDataFrame(rows, _SIZE_BINS).join(counted, "k", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    curve = joined.withColumns({"number_density": F.col("count") / (n * width), "weighted_density": F.coalesce("w", F.lit(0.0)) / (m["weights"] * width)}).orderBy("k").select(*columns)

    points = []
    if not fault:
        peak = max(support, power * scale)
        norm = (power + 1) * math.log(scale) + math.lgamma(power + 1) + math.log(upper_gamma_share(power + 1, support / scale))
        for v in np.unique(np.append(np.linspace(support, max(most, power * scale, support + 6 * scale), 300), peak)):
            logged = (power * math.log(v) if v > 0 else 0.0 if power == 0 else -math.inf) - v / scale - norm
            points.append((float(v), math.exp(-(v - support) / scale) / scale, math.exp(logged)))
    fit = spark.createDataFrame(points, "sqrt_area_size_A double, number_fit_density double, weighted_fit_density double")
    return {"summary": summary, "curve": curve, "fit_curve": fit}


def split_pseudo_voigt(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Peak with a half width on each side and one share of Lorentzian, without background: center, height, two half widths, share."""
    center, height, left, right, mix = p
    z2 = ((q - center) / np.where(q < center, left, right)) ** 2
    return height * (mix / (1 + z2) + (1 - mix) * np.exp2(-z2))


def _least_squares(residual, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Bounded Levenberg-Marquardt by projection: (solution, Jacobian, sum of squares, whether it came to rest)."""
    x, damp, rest = np.clip(start, low, high), 1e-3, False
    r = residual(x)
    cost = float(r @ r)

    def jacobian(x: np.ndarray) -> np.ndarray:
        h = 1e-6 * np.maximum(np.abs(x), 1e-2)
        up, down = np.minimum(x + h, high), np.maximum(x - h, low)
        e = np.eye(len(x))
        return np.stack([(residual(x + e[k] * (up - x)) - residual(x - e[k] * (x - down))) / (up[k] - down[k]) for k in range(len(x))], 1)

    for _ in range(rounds):
        j = jacobian(x)
        g, a = j.T @ r, j.T @ j
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-12 * max(1.0, cost):
            rest = True
            break
        moved = False
        for _ in range(40):
            step = np.zeros_like(x)
            m = a[np.ix_(free, free)]
            step[free] = np.linalg.lstsq(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), -g[free], rcond=None)[0]
            y = np.clip(x + step, low, high)
            ry = residual(y)
            cy = float(ry @ ry)
            if cy < cost:
                moved, small = True, cost - cy <= 1e-12 * cost
                x, r, cost, damp = y, ry, cy, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not moved or small:
            rest = True
            break
    return x, jacobian(x), cost, rest


#: Windows of Q by reflection, and which reflections tell the stacking (their size is Lc, others' La).
WINDOWS = {"10": (2.5, 3.6), "002": (1.2, 2.2), "11": (4.5, 5.7), "004": (3.2, 4.2)}
STACKING, POINTS = ("002", "004"), 12


def coherent_length(center: float, left: float, right: float, factor: float, instrument: float, wavelength: float | None) -> float | None:
    """Scherrer size of a peak less the instrument's width; with a wavelength by the angles of both half heights, None where they do not exist."""
    width = left + right
    if instrument >= width:
        return None
    part = math.sqrt(1 - (instrument / width) ** 2)
    if wavelength is None:
        return 2 * math.pi * factor / (width * part)
    ends = [(center + part * right) * wavelength / (4 * math.pi), (center - part * left) * wavelength / (4 * math.pi)]
    if ends[0] >= 1 or ends[1] < 0:
        return None
    beta = 2 * (math.asin(ends[0]) - math.asin(ends[1]))
    return factor * wavelength / (beta * math.cos(math.asin(center * wavelength / (4 * math.pi))))


def _best_peak(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, bool, float]:
    """(parameters, Jacobian, sum of squares, at rest, scale) of a peak on a line, the best of several starts; parameters 5 and 6 are the line about the middle."""
    span, middle, step = x[-1] - x[0], (x[0] + x[-1]) / 2, float(np.median(np.diff(x)))
    outer = np.r_[0:3, len(x) - 3 : len(x)]
    slope, level = np.polyfit(x[outer] - middle, y[outer], 1)
    over = y - level - slope * (x - middle)
    scale = max(float(np.ptp(y)), 1e-8 * float(np.abs(y).max()), 1e-12)
    thin = max(0.4 * step, 1e-5 * span)
    low = np.array([x[0], 0, thin, thin, 0, -np.inf, -np.inf])
    high = np.array([x[-1], 50 * scale, 2 * span, 2 * span, 1, np.inf, np.inf])
    found = []
    for center in {float(x[over.argmax()]), *map(float, np.quantile(x, [0.35, 0.55, 0.7]))}:
        start = np.array([center, max(float(over.max()), 0.1 * scale), span / 8, span / 8, 0.5, level, slope])
        found.append(_least_squares(lambda p: (split_pseudo_voigt(x, p[:5]) + p[5] + p[6] * (x - middle) - y) / scale, start, low, high))
    return *min(found, key=lambda f: f[2]), scale


def fit_carbon_diffraction_peak(q, intensity, *, reflection="10", q_window=None, shape_factor=None, instrument_fwhm_q=0.0, wavelength_A=None) -> dict:
    """A split pseudo-Voigt on a line, and the size that its width stands for, unless a gate withholds it.

    Missing intensities stay missing in the curve.  The status is ``unavailable`` for fewer than 12 points,
    ``review`` with the reasons where a gate holds the size back, else ``pass``.
    """
    q, intensity = checks.ascending("q", q, least=0.0), np.asarray(intensity, float)
    if intensity.shape != q.shape:
        raise ValueError(f"{intensity.size} intensities for {q.size} points of q")
    checks.one_of("reflection", reflection, tuple(WINDOWS))
    low, high = checks.interval("q_window", *(q_window or WINDOWS[reflection]))
    factor = (0.9 if reflection in STACKING else 1.0) if shape_factor is None else checks.number("shape_factor", shape_factor, above=0)
    instrument = checks.number("instrument_fwhm_q", instrument_fwhm_q, least=0)
    wavelength = None if wavelength_A is None else checks.number("wavelength_A", wavelength_A, above=0)
    shown = (q >= low) & (q <= high)
    curve = pd.DataFrame({"q_invA": q[shown], "observed": np.where(np.isfinite(intensity[shown]), intensity[shown], np.nan), "fit": np.nan, "background": np.nan, "residual": np.nan})
    x, y = curve.dropna(subset="observed")[["q_invA", "observed"]].to_numpy().T
    axis = "Lc" if reflection in STACKING else "La"
    summary = {
        "reflection": reflection, "q_window_min_invA": low, "q_window_max_invA": high, "shape_factor": factor, "profile": "split_pseudo_voigt_linear_background", "status": "unavailable", "reason": f"{len(x)} finite points; a fit needs {POINTS}",
        "point_count": len(x), "q_peak_invA": None, "fwhm_invA": None, "La_A": None, "La_stderr_A": None, "Lc_A": None, "Lc_stderr_A": None, "d_spacing_A": None, "size_A": None, "size_stderr_A": None,
        "instrument_fwhm_invA": instrument, "wavelength_A": wavelength, "width_correction": "none" if instrument == 0 else "Gaussian_quadrature_approximation",
    }
    if len(x) < POINTS:
        return {"summary": summary, "curve": curve}
    p, j, squares, rest, scale = _best_peak(x, y)
    center, height, left, right, mix = map(float, p[:5])
    middle, step, fwhm = (x[0] + x[-1]) / 2, float(np.median(np.diff(x))), left + right
    background = p[5] + p[6] * (curve["q_invA"] - middle)
    curve["fit"], curve["background"] = split_pseudo_voigt(curve["q_invA"].to_numpy(), p[:5]) + background, background
    curve["residual"] = curve["observed"] - curve["fit"]
    noise = float(np.sqrt((curve["residual"].dropna() ** 2).mean()))
    known = np.linalg.matrix_rank(j) == len(p)
    covariance = np.linalg.pinv(j.T @ j) * squares / (len(x) - len(p)) if known else np.full((7, 7), np.nan)
    width_error = float(np.sqrt(max(0.0, covariance[2:4, 2:4].sum()))) if known else None
    core = x[(x >= center - left) & (x <= center + right)]
    gap = np.diff(core).max() if core.size > 1 else math.inf
    gates = {
        "the fit did not come to rest": not rest,
        "the peak does not rise above the residuals": height <= max(4 * noise, 0.01 * scale),
        "the points of q do not resolve the width": fwhm < 3 * step or min(left, right) < step,
        "half height or background reaches the edge of the window": center - left <= x[0] + 2 * step or center + right >= x[-1] - 2 * step,
        "missing reciprocal bins interrupt the peak": core.size < 4 or gap > max(2.5 * step, fwhm / 4),
        "the peak's parameters are not determined": not known or width_error > fwhm / 2,
        "the instrument is as wide as the peak": instrument >= fwhm,
    }
    reasons = [text for text, broken in gates.items() if broken]
    size = error = None
    if not reasons:
        length = lambda v: coherent_length(*v, factor, instrument, wavelength)
        at = np.array([center, left, right])
        size = length(at)
        if size is None:
            reasons.append("the peak lies beyond the angles of this wavelength")
        else:
            h = np.maximum(1e-6 * np.abs(at), 1e-9)
            sides = [(length(at + e), length(at - e)) for e in np.diag(h)]
            slope = np.array([(a - b) / (2 * d) if a and b else np.nan for (a, b), d in zip(sides, h)])
            error = float(np.sqrt(max(0.0, slope @ covariance[np.ix_([0, 2, 3], [0, 2, 3])] @ slope)))
    area = height * fwhm * (mix * math.pi / 2 + (1 - mix) * math.sqrt(math.pi / math.log(2)) / 2)
    summary |= {
        "status": "review" if reasons else "pass", "reason": "; ".join(reasons) or "the peak is resolved", "q_peak_invA": center, "q_peak_stderr_invA": float(np.sqrt(max(0.0, covariance[0, 0]))) if known else None,
        "fwhm_invA": fwhm, "fwhm_stderr_invA": width_error, "corrected_fwhm_invA": math.sqrt(max(0.0, fwhm**2 - instrument**2)), "amplitude": height, "integrated_peak_area": area, "asymmetry_right_over_left": right / left,
        "lorentz_fraction": mix, "residual_rms": noise, "d_spacing_A": None if reasons else 2 * math.pi / center, "size_A": size, "size_stderr_A": error, f"{axis}_A": size, f"{axis}_stderr_A": error,
    }
    return {"summary": summary, "curve": curve}


def fit_peaks(curves: DataFrame, **settings) -> DataFrame:
    """(curve_id, q_peak_invA, fwhm_invA, size_A, lorentz_fraction, status) of every curve (curve_id, q, intensity): one group per curve, fitted side by side."""
    names = ["q_peak_invA", "fwhm_invA", "size_A", "lorentz_fraction", "status"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("q")
        s = fit_carbon_diffraction_peak(part["q"], part["intensity"], **settings)["summary"]
        return pd.DataFrame([{"curve_id": part["curve_id"].iloc[0], **{k: s.get(k) for k in names}}])

    return curves.groupBy("curve_id").applyInPandas(run, "curve_id string, q_peak_invA double, fwhm_invA double, size_A double, lorentz_fraction double, status string")
