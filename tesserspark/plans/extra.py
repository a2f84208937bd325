"""Further registered queries: tilted and changing cells, percolation, weighted g(r), rings, sizes, automatic modes, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserspark.functions import constants
from tesserspark.functions.transforms import quadrature_weights
from tesserspark.operators import carbon, clustering, coordination, diffraction, plotting, rdf, scattering
from tesserspark.operators.cache import AnalysisCache
from tesserspark.plans import neighbors, registry as base
from tesserspark.plans.neighbors import neighbor_pairs
from tesserspark.plans.registry import _ATOMS, _factor_cte, _long, _pairs, _rdf_cte, _rounded, _scattering, _scattering_cte, _SHARED, _SPECTRAL, _weights_cte, ELEMENTS
from tesserspark.plans.staging import materialize, shared_path
from tesserspark.functions.bins import bin_edges
from tesserspark.operators.tables import Table
from tesserspark.sources import xyz
from tesserspark.sources.trajectory import Trajectory, project_embeddings


def project_skewed(spark: SparkSession, sf_dir: str) -> Trajectory:
    """The embeddings' trajectory in a tilted cell that grows from frame to frame: the cube's coordinates are read as fractions of it."""
    cube = project_embeddings(spark, sf_dir)
    grown = [(F.lit(x) + F.col("frame") * 0.1).alias(k) for k, x in zip("abc", (20.0, 21.0, 22.0))]
    frames = spark.range(21).select(F.col("id").alias("frame")).select("frame", *grown, F.lit(80.0).alias("alpha"), F.lit(95.0).alias("beta"), F.lit(75.0).alias("gamma"))
    cells = Trajectory.from_dataframe(cube.atoms, frames).frames.select(F.col("frame").alias("f"), *[f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)])
    part = {k: F.col(k) / 20.0 for k in "xyz"}
    moved = cube.atoms.join(F.broadcast(cells), F.col("frame") == F.col("f"))  # one row a frame
    atoms = moved.select("frame", "atom", "species", *[(part["x"] * F.col(f"h1{j}") + part["y"] * F.col(f"h2{j}") + part["z"] * F.col(f"h3{j}")).alias(k) for j, k in ((1, "x"), (2, "y"), (3, "z"))])
    return Trajectory.from_dataframe(atoms, frames)


def skewed_cells(spark, d):
    return _rounded(project_skewed(spark, d).frames.select("frame", "volume", "w1", "w2", "w3"), 6)


def skewed_pairs(spark, d):
    near = neighbor_pairs(project_skewed(spark, d), 4.0, half=True)
    shifted = F.count_if((F.col("tx") != 0) | (F.col("ty") != 0) | (F.col("tz") != 0))
    return near.groupBy("frame", "si", "sj").agg(F.count(F.lit(1)).alias("n"), shifted.alias("shifted"), F.round(F.sum(F.sqrt("d2")), 5).alias("total"))


def skewed_rdf(spark, d):
    return _long(rdf.compute_rdfs(project_skewed(spark, d), [("A", "B"), ("C", "C")], bins=30, r_range=(0.5, 6.5)))


def skewed_coordination(spark, d):
    return _long(coordination.compute_coordination(project_skewed(spark, d), [("A", "B", 3.0)], max_coordination=8))


def shifted_atoms(spark, d):
    """Origins that differ by frame are taken off the coordinates."""
    t = project_embeddings(spark, d)
    frames = spark.range(21).select(F.col("id").alias("frame"), *[F.lit(20.0).alias(k) for k in "abc"], (F.col("id") * 0.5).alias("ox"), F.lit(-1.0).alias("oy"), F.lit(None).cast("double").alias("oz"))
    return _rounded(Trajectory.from_dataframe(t.atoms, frames, shift_by_origin=True).atoms)


def selected_atoms(spark, d):
    t = project_embeddings(spark, d).select_frames(slice(2, 18, 5)).select_atoms("(name A or name B) and not index 0:99", "prop x < 1")
    return t.atoms.groupBy("frame", "species").agg(F.count(F.lit(1)).alias("n"))


def cutoff_clusters(spark, d):
    t, asked = project_embeddings(spark, d), [("A", "A", 1.8), ("A", "B", 0.5, 1.8), ("C", "B", 0.0, 1.6, "other")]
    out = None
    for normalize, unbonded in (("atom1", False), ("total", True)):
        one = _long(clustering.compute_cutoff_clusters(t, asked, normalize=normalize, include_unbonded=unbonded, max_cluster_size=6)).withColumn("kind", F.lit(normalize))
        out = one if out is None else out.unionByName(one)
    return out


def scattering_xray_structure(spark, d):
    return _long(_scattering(spark, d, probes=("xray",)).xray.structure_factor, 6)


def scattering_neutron_rdf(spark, d):
    return _long(_scattering(spark, d, probes=("neutron",)).neutron.weighted_rdf, 7)


def scattering_neutron_al(spark, d):
    return _long(_scattering(spark, d, "ashcroft-langreth", ("neutron",)).neutron.structure_factor, 6)


_TARGETS = np.round(0.5 + 0.35 * np.arange(20), 10)


def scattering_interpolated(spark, d):
    t = rdf.compute_rdfs(project_embeddings(spark, d), bins=100, r_range=(0.0, 8.0))
    out = scattering.compute_scattering(Table(materialize(t.long, "rdf"), t.axis, t.labels, t.attrs), elements=ELEMENTS, probes=("neutron",), q_range=(0.5, 10.0), r_grid=_TARGETS)
    return _long(out.neutron.weighted_rdf, 7)


def bessel_simpson(spark, d):
    """Transform of h(r) by Simpson's rule, of an odd number of points."""
    from tesserspark.functions import transforms

    t = rdf.compute_rdfs(project_embeddings(spark, d), bins=101, r_range=(0.0, 8.08))
    r = 0.04 + 0.08 * np.arange(101)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(quadrature_weights(r, "simpson"))], "place int, weight double")
    curves = t.long.select("r", "label", (F.col("value") - 1).alias("value"), F.floor(F.col("r") / 0.08).cast("int").alias("p")).join(F.broadcast(weights), F.col("p") == F.col("place"))
    return _rounded(transforms.bessel_transform(curves, spark.range(1, 21).select(F.col("id").cast("double").alias("y")), "r", "y"), 5)


def composition_table(spark, d):
    c = scattering.ScatteringComposition.from_trajectory(project_embeddings(spark, d), elements=ELEMENTS, isotopes={"B": "7Li"}, charges={"C": -1})
    rows = [(r["species"], r["element"], r["amount"], r["concentration"], r["atomic_mass"], r["neutron_b_fm"], r["xray_charge"]) for r in c.table()]
    return _rounded(spark.createDataFrame(rows, "species string, element string, amount double, concentration double, atomic_mass double, neutron_b_fm double, xray_charge int"))


def spectral_automatic(spark, d):
    """Modes chosen by the decay of the coefficients."""
    t = rdf.compute_spectral_rdfs(project_embeddings(spark, d), modes="auto", step=0.5, r_range=(1.0, 5.0), auto_min_modes=2, auto_max_modes=12)
    found = t.attrs["spectral"]["auto"]["diagnostics"]
    rows = [(k, v["selected_mode"], v["decay_rate"], v["log_noise_floor"], v["fallback"]) for k, v in found.items()]
    return _rounded(spark.createDataFrame(rows, "label string, selected_mode int, decay_rate double, log_noise_floor double, fallback boolean"), 6)


def rings(spark, d):
    """Rings up to the operator's own size."""
    return carbon.trajectory_rings(project_embeddings(spark, d), 1.8).select("frame", F.array_join("ring", ",").alias("ring"))


def honeycomb_sheets(spark: SparkSession, bond: float = 1.42) -> Trajectory:
    """Flat periodic sheets of 4 x 4 to 9 x 9 cells, one a frame."""
    a = bond * math.sqrt(3)
    n = F.col("frame") + 4
    frames = spark.range(6).select(F.col("id").alias("frame")).select("frame", *[v.alias(h) for h, v in zip([f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], [n * a, F.lit(0.0), F.lit(0.0), n * a / 2, n * a * math.sqrt(3) / 2, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(20.0)])])
    sites = spark.range(6).select(F.col("id").alias("frame")).select("frame", F.explode(F.sequence(F.lit(0), 2 * n * n - 1)).alias("atom"))
    i, j, b = F.floor(F.col("atom") / 2) % n, F.floor(F.col("atom") / (2 * n)), F.col("atom") % 2
    atoms = sites.select("frame", "atom", F.lit("C").alias("species"), ((i + j / 2) * a + 0.3).alias("x"), (j * (a * math.sqrt(3) / 2) + F.when(b == 0, bond).otherwise(-bond) + 2.0).alias("y"), F.lit(5.0).alias("z"))
    return Trajectory.from_dataframe(atoms, frames)


def graphenic_sheets(spark, d):
    """Domains of flat sheets: one that winds around the cell, of known area."""
    t = honeycomb_sheets(spark)
    bonds = neighbor_pairs(t, 1.6).select("frame", F.col("i").alias("src"), F.col("j").alias("dst"))
    out = carbon.analyze_graphenic_frames(t, bonds, "crystallites", normal_thresholds_deg=(1.0,))
    return _rounded(out.select("frame", "ring_count", "atom_count", "wrap_a", "wrap_b", "wrap_c", "area_A2", "area_scope", "normal_nematic_order"), 6)


def _xyz_file(spark, d) -> str:
    """The embeddings' trajectory as an extended XYZ file in the shared folder; every other frame lists its atoms backwards."""
    t = project_embeddings(spark, d)
    turn = F.when(F.col("frame") % 2 == 0, F.col("atom")).otherwise(-F.col("atom"))
    line = F.concat_ws(" ", F.format_string("%.6f", "x"), F.format_string("%.6f", "y"), F.format_string("%.6f", "z"), "species", F.col("atom").cast("string"))
    frames = t.atoms.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), line.alias("line")))).alias("lines"))
    head = F.format_string('Lattice="20 0 0 0 20 0 0 0 20" Origin="%.1f 0 0" Properties=pos:R:3:species:S:1:id:I:1', F.col("frame") * 0.5)
    text = F.concat_ws("\n", F.size("lines").cast("string"), head, F.array_join("lines.line", "\n"))
    folder = shared_path(spark, "xyz")
    frames.select("frame", text.alias("value")).repartition(1).sortWithinPartitions("frame").select("value").write.text(folder)
    return next(f for f in spark.read.text(folder).inputFiles()).removeprefix("file://")


def xyz_atoms(spark, d):
    """Read back from an XYZ file, origins taken off, atoms numbered by species as the frames' orders differ."""
    t = xyz.load_trajectory(_xyz_file(spark, d), shift_by_origin=True, format="xyz", spark=spark)
    return _rounded(t.atoms.groupBy("frame", "species").agg(F.count(F.lit(1)).alias("n"), F.min("atom").alias("first"), F.max("atom").alias("last"), F.sum("x").alias("x"), F.sum("y").alias("y")), 4)


def xyz_selected_frames(spark, d):
    """Frames of a file by their places in it, in the order asked for, in another box."""
    t = xyz.load_trajectory(_xyz_file(spark, d), frames=[17, 3, 4], box=(20, 20, 25), normalize_species_order=False, format="xyz", spark=spark)
    return _rounded(t.atoms.where("atom < 3").join(t.frames.select(F.col("frame").alias("f"), "source_frame", "volume"), F.col("frame") == F.col("f")).drop("f"), 6)


def neighbor_lists(spark, d):
    found = neighbors.neighbor_lists(project_embeddings(spark, d), 2.2, centers=["A", "C"], neighbors=["B", "C"])
    return found.select("frame", "i", F.array_join("neighbors", ",").alias("neighbors"))


def cached_coordination(spark, d):
    """Computed once, kept, and read from the cache."""
    cache = AnalysisCache(shared_path(spark, "cache").removeprefix("file://").removeprefix("file:"))
    t = project_embeddings(spark, d)
    for mode in ("use", "read_only"):
        out = cache.get_or_compute(coordination.compute_coordination, t, base.COORDINATION, max_coordination=6, cache_mode=mode, cache_source_id=d)
    return _long(out)


def scattering_repaired(spark, d):
    """Partials on a grid that rounding has made uneven: it is evened out first."""
    t = rdf.compute_rdfs(project_embeddings(spark, d), bins=100, r_range=(0.0, 8.0))
    ends = F.col("r").between(0.1, 7.9)
    uneven = t.long.withColumn("r", F.col("r") + F.when(ends, F.sin(F.col("r") * 100) * 2e-7).otherwise(0.0))
    out = scattering.compute_partial_structure_factors(Table(materialize(uneven, "uneven"), t.axis, t.labels, t.attrs), composition=scattering.ScatteringComposition(t.attrs["system"]["atom_counts"], elements=ELEMENTS), q_range=(0.5, 10.0))
    return _long(out, 6)


def plotted_structure_factor(spark, d):
    """What a plot shows: pair contributions on the line S = 1."""
    return _rounded(plotting.structure_factor_data(_scattering(spark, d, probes=("neutron",)).neutron), 6)


def _sizes(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_extendedprice") / 2000.0).alias("size_A"))


def crystallite_sizes_summary(spark, d):
    """Sizes from the prices of lineitem: bins, densities and the fitted ones."""
    return _rounded(diffraction.summarize_crystallite_size_distribution(_sizes(spark, d), bin_width_A=0.5)["curve"].drop("weighted_fit_density"))


def crystallite_sizes_moments(spark, d):
    s = diffraction.summarize_crystallite_size_distribution(_sizes(spark, d), bin_width_A=0.5, diffraction_size_A=12.0)["summary"]
    names = ["number_mean_A", "number_median_A", "weighted_mean_A", "weighted_empirical_mode_A", "exponential_scale_A", "weighted_fit_mode_A", "exponential_cdf_max_deviation", "weighted_fraction_below_diffraction_size"]
    return _rounded(spark.createDataFrame([(s["count"], s["fit_status"], *(float(s[n]) for n in names))], "count long, fit_status string, " + ", ".join(f"{n} double" for n in names)), 7)


def graphene_calibration(spark, d):
    return _rounded(diffraction.calibrate_graphene_diffraction(spark=spark)["fragments"], 4)


def graphene_calibration_fine(spark, d):
    """With bins of which no multiple is a distance in the lattice; on such, rounding decides the bin, and SQL may round otherwise."""
    return _rounded(diffraction.calibrate_graphene_diffraction(pair_bin_width_A=0.00093, spark=spark)["fragments"], 4)


def diffraction_peak_fit(spark, d):
    """A peak of each label's embeddings, its width from all their components: curves fitted side by side."""
    whole = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + F.abs(v.cast("double"))) / F.size("embedding")
    shapes = spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.avg(whole).alias("m"))
    q = spark.range(300).select((2.3 + F.col("id") * 0.005).alias("q"))
    z = (F.col("q") - 2.95) / (0.08 + F.col("m") / 10)
    curves = shapes.crossJoin(F.broadcast(q)).select(F.col("label").cast("string").alias("curve_id"), "q", (5 / (1 + z * z) + 1).alias("intensity"))
    return _rounded(diffraction.fit_peaks(curves), 3)


QUERIES = {
    f.__name__: f
    for f in (
        skewed_cells, skewed_pairs, skewed_rdf, skewed_coordination, shifted_atoms, selected_atoms, cutoff_clusters, scattering_xray_structure, scattering_neutron_rdf, scattering_neutron_al, scattering_interpolated, bessel_simpson,
        composition_table, spectral_automatic, rings, graphenic_sheets, xyz_atoms, xyz_selected_frames, neighbor_lists, cached_coordination, scattering_repaired, plotted_structure_factor, crystallite_sizes_summary, crystallite_sizes_moments, graphene_calibration, graphene_calibration_fine, diffraction_peak_fit,
    )
}

# ---------------------------------------------------------------------------------------------- SQL

_CELLS = """
lengths AS (SELECT CAST(f AS BIGINT) AS frame, 20.0::DOUBLE + f * 0.1::DOUBLE AS a, 21.0::DOUBLE + f * 0.1::DOUBLE AS b, 22.0::DOUBLE + f * 0.1::DOUBLE AS c, cos(radians(80.0::DOUBLE)) AS ca, cos(radians(95.0::DOUBLE)) AS cb, cos(radians(75.0::DOUBLE)) AS cg FROM range(21) t(f)),
cells AS (
  SELECT frame, a AS h11, b * cg AS h21, b * sqrt(1 - cg * cg) AS h22, c * cb AS h31, c * (ca - cb * cg) / sqrt(1 - cg * cg) AS h32,
    c * sqrt(1 - cb * cb - power((ca - cb * cg) / sqrt(1 - cg * cg), 2)) AS h33 FROM lengths)"""


def _skewed(reach: float) -> str:
    """Pairs i < j within reach by the nearest image of fractional displacements, and whether that is another image than the one given."""
    wrapped = ", ".join(f"(b.{k} - a.{k}) / 20.0::DOUBLE - floor((b.{k} - a.{k}) / 20.0::DOUBLE + 0.5::DOUBLE) AS f{k}, floor((b.{k} - a.{k}) / 20.0::DOUBLE + 0.5::DOUBLE) AS s{k}" for k in "xyz")
    return f"""{_ATOMS}, {_CELLS},
half AS (SELECT a.frame, a.atom AS i, a.species AS si, b.atom AS j, b.species AS sj, {wrapped} FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom < b.atom),
pairs AS (
  SELECT * FROM (
    SELECT half.*, sx <> 0 OR sy <> 0 OR sz <> 0 AS shifted, power(fx * h11 + fy * h21 + fz * h31, 2) + power(fy * h22 + fz * h32, 2) + power(fz * h33, 2) AS d2 FROM half JOIN cells USING (frame))
  WHERE d2 < {reach!r}::DOUBLE * {reach!r}::DOUBLE)"""


def _skewed_rdf_sql() -> str:
    edges = bin_edges(0.5, 6.5, 30, None)
    return f"""WITH {_skewed(float(np.nextafter(6.5, 7.0)))}, {base._grid(edges)},
volumes AS (SELECT frame, h11 * h22 * h33 AS v FROM cells),
scales AS (SELECT l.a, l.b, sum(x.n * (y.n - CASE WHEN l.a = l.b THEN 1 ELSE 0 END) / v) AS scale FROM (VALUES ('A', 'B'), ('C', 'C')) l(a, b)
  JOIN (SELECT frame, species, count(*) AS n FROM atoms GROUP BY ALL) x ON x.species = l.a JOIN (SELECT frame, species, count(*) AS n FROM atoms GROUP BY ALL) y ON y.species = l.b AND y.frame = x.frame JOIN volumes ON volumes.frame = x.frame GROUP BY l.a, l.b),
counts AS (SELECT a, b, place, sum(CASE WHEN a = b THEN 2 ELSE 1 END) AS n FROM (SELECT least(si, sj) AS a, greatest(si, sj) AS b, {base._bin('sqrt(d2)', edges)} AS place FROM pairs) WHERE place IS NOT NULL GROUP BY a, b, place)
SELECT round(r, 9) AS r, s.a || '-' || s.b AS label, round(coalesce(n, 0) / (scale * shell), 9) AS value FROM grid CROSS JOIN scales s LEFT JOIN counts ON counts.place = grid.place AND counts.a = s.a AND counts.b = s.b"""


def _cutoff_sql() -> str:
    asked = "defs(label, f, s, lo, hi) AS (VALUES ('A-A', 'A', 'A', 0.0::DOUBLE, 1.8::DOUBLE), ('A-B', 'A', 'B', 0.5, 1.8), ('other', 'C', 'B', 0.0, 1.6))"
    return f"""WITH RECURSIVE {_pairs(1.8)}, {asked},
links AS MATERIALIZED (SELECT label, frame, i, j FROM pairs JOIN defs ON ((si = f AND sj = s) OR (si = s AND sj = f)) AND d2 >= lo * lo AND d2 < hi * hi),
reach AS (
  SELECT label, frame, atom AS node, atom AS other FROM atoms JOIN defs ON species IN (f, s)
  UNION SELECT reach.label, reach.frame, reach.node, links.j FROM reach JOIN links ON links.label = reach.label AND links.frame = reach.frame AND links.i = reach.other),
comp AS (SELECT label, frame, node, min(other) AS c FROM reach GROUP BY ALL),
sizes AS (SELECT comp.label, comp.frame, c, count(*) AS atoms, count_if(species = f) AS firsts, count_if(species = s) AS seconds, any_value(f = s) AS same FROM comp JOIN defs USING (label) JOIN atoms ON atoms.frame = comp.frame AND atom = node GROUP BY ALL),
samples AS (
  SELECT 'atom1' AS kind, label, firsts AS size, firsts AS n FROM sizes WHERE firsts > 0 AND CASE WHEN same THEN atoms > 1 ELSE seconds > 0 END
  UNION ALL SELECT 'total', label, atoms, 1 FROM sizes),
totals AS (SELECT kind, label, sum(n) AS whole FROM samples GROUP BY ALL), counted AS (SELECT kind, label, size, sum(n) AS n FROM samples GROUP BY ALL)
SELECT CAST(k AS BIGINT) AS cluster_size, t.label, t.kind, round(CAST(coalesce(n, 0) / whole AS DOUBLE), 9) AS value FROM range(1, 7) r(k) CROSS JOIN totals t LEFT JOIN counted c ON c.kind = t.kind AND c.label = t.label AND c.size = k"""


#: Centers linked by shared neighbors with the translations of the links, and what each center reaches: plainly, by kind of link, and with the sum of translations, up to two cells away.
_NETWORK = f"""{_SHARED.replace('bonds AS (SELECT frame, i AS c, j AS g FROM pairs', 'bonds AS (SELECT frame, i AS c, j AS g, tx, ty, tz FROM moved')},
kinds(mode) AS (VALUES ('connected'), ('corner'), ('edge'), ('face')),
typed AS MATERIALIZED (SELECT *, CASE WHEN shared = 1 THEN 'corner' WHEN shared = 2 THEN 'edge' ELSE 'face' END AS type FROM links),
arcs AS MATERIALIZED (SELECT mode, frame, l AS u, r AS v FROM typed JOIN kinds ON mode = 'connected' OR mode = type UNION ALL SELECT mode, frame, r, l FROM typed JOIN kinds ON mode = 'connected' OR mode = type),
steps AS MATERIALIZED (
  SELECT DISTINCT a.frame, a.c AS u, b.c AS v, a.tx - b.tx AS tx, a.ty - b.ty AS ty, a.tz - b.tz AS tz FROM bonds a JOIN bonds b ON a.frame = b.frame AND a.g = b.g AND a.c <> b.c),
centers AS (SELECT frame, atom AS node FROM atoms WHERE species = 'A'),
reach AS (
  SELECT mode, frame, node, node AS other FROM centers CROSS JOIN kinds
  UNION SELECT reach.mode, reach.frame, reach.node, arcs.v FROM reach JOIN arcs ON arcs.mode = reach.mode AND arcs.frame = reach.frame AND arcs.u = reach.other),
comp AS (SELECT mode, frame, node, min(other) AS c FROM reach GROUP BY ALL),
far AS (
  SELECT frame, node, node AS other, 0 AS x, 0 AS y, 0 AS z FROM centers
  UNION SELECT far.frame, far.node, steps.v, far.x + steps.tx, far.y + steps.ty, far.z + steps.tz FROM far JOIN steps ON steps.frame = far.frame AND steps.u = far.other
    WHERE abs(far.x + steps.tx) <= 2 AND abs(far.y + steps.ty) <= 2 AND abs(far.z + steps.tz) <= 2),
wound AS (SELECT frame, node, bool_or(x <> 0) AS wx, bool_or(y <> 0) AS wy, bool_or(z <> 0) AS wz FROM far WHERE node = other GROUP BY ALL),
clusters AS (
  SELECT comp.frame, c, count(*) AS size, bool_or(wx) AS wx, bool_or(wy) AS wy, bool_or(wz) AS wz, bool_or(wx OR wy OR wz) AS w FROM comp JOIN wound ON wound.frame = comp.frame AND wound.node = comp.node WHERE mode = 'connected' GROUP BY comp.frame, c)"""


def _moved(reach: float) -> str:
    """Pairs with the translation of j's nearest image."""
    shifts = ", ".join(f"CAST(-floor(b.{k} * 0.05::DOUBLE - a.{k} * 0.05::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS t{k}" for k in "xyz")
    return f"moved AS (SELECT p.frame, p.i, p.si, p.j, p.sj, {shifts} FROM pairs p JOIN atoms a ON a.frame = p.frame AND a.atom = p.i JOIN atoms b ON b.frame = p.frame AND b.atom = p.j WHERE p.d2 < {reach!r}::DOUBLE * {reach!r}::DOUBLE)"


_NET = "WITH RECURSIVE " + _NETWORK.replace("\nbonds AS", f"\n{_moved(2.0)},\nbonds AS", 1)
_SUMMARY = """,
linked AS (SELECT frame, CAST(count_if(type = 'corner') AS BIGINT) AS corner_links, CAST(count_if(type = 'edge') AS BIGINT) AS edge_links, CAST(count_if(type = 'face') AS BIGINT) AS face_links, count(*) AS connected_links FROM typed GROUP BY frame),
counted AS (
  SELECT frame, CAST(sum(size) AS BIGINT) AS n_centers, CAST(count_if(size > 1) AS BIGINT) AS n_clusters_total, CAST(count_if(size > 1 AND NOT w) AS BIGINT) AS n_clusters_finite, CAST(count_if(size > 1 AND w) AS BIGINT) AS n_wrapping_clusters, max(size) AS largest_cluster_size, round(max(size) / sum(size), 9) AS largest_cluster_fraction,
    round(coalesce(sum(CASE WHEN w THEN size END), 0) / sum(size), 9) AS percolation_strength, bool_or(wx) AS wrap_x, bool_or(wy) AS wrap_y, bool_or(wz) AS wrap_z, bool_or(w) AS wrap_any,
    CAST(count_if(size > 1 AND NOT w) AS DOUBLE) AS "M0_finite", CAST(coalesce(sum(CASE WHEN size > 1 AND NOT w THEN size END), 0) AS DOUBLE) AS "M1_finite", CAST(coalesce(sum(CASE WHEN size > 1 AND NOT w THEN size * size END), 0) AS DOUBLE) AS "M2_finite"
  FROM clusters GROUP BY frame),
summary AS (SELECT counted.frame, counted.frame AS source_frame, coalesce(corner_links, 0) AS corner_links, coalesce(edge_links, 0) AS edge_links, coalesce(face_links, 0) AS face_links, coalesce(connected_links, 0) AS connected_links, counted.* EXCLUDE (frame) FROM counted LEFT JOIN linked USING (frame))"""
_METRICS = ["largest_cluster_size", "largest_cluster_fraction", "percolation_strength", "M0_finite", "M1_finite", "M2_finite"]


def _xray_sql() -> str:
    edges = bin_edges(0.0, 8.0, 100, None)
    r = 0.5 * (edges[:-1] + edges[1:])
    q = scattering.q_points(r, (0.5, 10.0), None)
    weights = ", ".join(f"({float(x)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for x, w in zip(q, quadrature_weights(q)))
    radii = ", ".join(f"({float(x)!r}::DOUBLE)" for x in r)
    top, first = f"{float(q[-1])!r}::DOUBLE", f"{float(q[0])!r}::DOUBLE"
    return f"""WITH {_scattering_cte("faber-ziman")}, {_weights_cte("xray")}, qw(q, dq) AS (VALUES {weights}), rs(r) AS (VALUES {radii}),
v AS (SELECT part.q, part.label, (value - base) * w * sin(pi() * part.q / {top}) / (pi() * part.q / {top}) * dq * part.q * part.q AS v FROM part JOIN weight ON weight.q = part.q AND weight.label = part.label JOIN qw ON qw.q = part.q),
back AS (SELECT r, v.label, sum(v * sin(q * r) / (q * r)) / (2 * pi() * pi() * rho) + w0 AS value FROM v CROSS JOIN rs CROSS JOIN density JOIN (SELECT label, w AS w0 FROM weight WHERE q = {first}) f ON f.label = v.label GROUP BY r, v.label, rho, w0)
SELECT round(r, 9) AS r, label, round(value, 6) AS value FROM back UNION ALL SELECT round(r, 9), 'Total', round(sum(value), 6) FROM back GROUP BY r"""


def _direct_sql(targets: np.ndarray | None) -> str:
    """Neutron weights act on g(r): by their value at the first Q, here at all of them."""
    factors = f"""WITH {_scattering_cte("faber-ziman")}, {_weights_cte("neutron")}, w0 AS (SELECT label, any_value(w) AS w FROM weight GROUP BY label)"""
    if targets is None:
        return f"""{factors}, v AS (SELECT g.r, g.label, g.value * w AS value FROM g JOIN w0 ON w0.label = g.label) SELECT round(r, 9) AS r, label, round(value, 7) + 0.0 AS value FROM v UNION ALL SELECT round(r, 9), 'Total', round(sum(value), 7) + 0.0 FROM v GROUP BY r"""
    rows = ", ".join(f"({float(x)!r}::DOUBLE)" for x in targets)
    return f"""{factors}, ts(t) AS (VALUES {rows}), seg AS (SELECT label, r AS x0, value AS y0, lead(r) OVER o AS x1, lead(value) OVER o AS y1 FROM g WINDOW o AS (PARTITION BY label ORDER BY r)),
v AS (SELECT t AS r, seg.label, (y0 + (y1 - y0) * (t - x0) / (x1 - x0)) * w AS value FROM seg JOIN ts ON t >= x0 AND t < x1 JOIN w0 ON w0.label = seg.label)
SELECT round(r, 9) AS r, label, round(value, 7) + 0.0 AS value FROM v UNION ALL SELECT round(r, 9), 'Total', round(sum(value), 7) + 0.0 FROM v GROUP BY r"""


def _rings_cte(most: int = 8) -> str:
    """All simple cycles from their least atom, in one direction; a ring has no chord and is a shortest cycle through one of its bonds."""
    return f"""WITH RECURSIVE {_pairs(1.8)}, e AS MATERIALIZED (SELECT frame, i, j FROM pairs),
walk AS (
  SELECT frame, i AS head, j AS tail, [i, j] AS path FROM e WHERE i < j
  UNION ALL SELECT walk.frame, head, e.j, list_append(path, e.j) FROM walk JOIN e ON e.frame = walk.frame AND e.i = tail WHERE e.j > head AND len(path) < {most} AND NOT list_contains(path, e.j)),
cycles AS MATERIALIZED (SELECT walk.frame, path, len(path) AS n FROM walk JOIN e ON e.frame = walk.frame AND e.i = tail AND e.j = head WHERE len(path) > 2 AND path[2] < path[-1]),
sides AS MATERIALIZED (SELECT frame, path, n, least(path[k], path[k % n + 1]) AS u, greatest(path[k], path[k % n + 1]) AS v FROM cycles CROSS JOIN range(1, {most + 1}) t(k) WHERE k <= n),
shortest AS (SELECT frame, u, v, min(n) AS least FROM sides GROUP BY ALL),
proper AS (SELECT DISTINCT sides.frame, path, n FROM sides JOIN shortest ON shortest.frame = sides.frame AND shortest.u = sides.u AND shortest.v = sides.v AND least = n),
bonds AS (SELECT proper.frame, path, count(*) AS m FROM proper JOIN e ON e.frame = proper.frame AND list_contains(path, e.i) AND list_contains(path, e.j) GROUP BY ALL),
found AS (SELECT frame, path, len(path) AS n FROM bonds WHERE m = 2 * len(path))"""


def _debye_sql() -> str:
    a, b, c = constants.xray_terms("C")
    f = " + ".join(f"{x!r} * exp(-{y!r} * power(q / (4 * pi()), 2))" for x, y in zip(a, b)) + f" + {c!r}"
    return f"""WITH {_ATOMS}, h AS (SELECT a.frame, floor(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 0.05::DOUBLE) AS place, count(*) AS n FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom < b.atom GROUP BY ALL),
qs AS (SELECT q, power({f}, 2) AS f2 FROM (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0)) t(q)), s AS (SELECT frame, q, any_value(f2) AS f2, sum(n * sin(q * (place + 0.5) * 0.05) / (q * (place + 0.5) * 0.05)) AS s FROM h CROSS JOIN qs GROUP BY frame, q),
k AS (SELECT frame, count(*) AS atoms FROM atoms GROUP BY frame)
SELECT s.frame, q AS "q_invA", round(1 + 2 * s / atoms, 6) AS "S_q", round((1 + 2 * s / atoms) * f2, 6) AS "I_per_atom", round((1 + 2 * s / atoms) * f2 * atoms, 3) AS "I_per_fragment" FROM s JOIN k USING (frame)"""


def _calibration_sql(width: float) -> str:
    a, b, c = constants.xray_terms("C")
    f = " + ".join(f"{x!r} * exp(-{y!r} * power(q / (4 * pi()), 2))" for x, y in zip(a, b)) + f" + {c!r}"
    area, lattice = 3 * math.sqrt(3) * 1.42**2 / 4, 1.42 * math.sqrt(3)
    return f"""WITH sites AS (SELECT i, j, b, (i + j / 2.0::DOUBLE) * {lattice!r}::DOUBLE AS x, j * {lattice * math.sqrt(3) / 2!r}::DOUBLE + b * 1.42::DOUBLE AS y FROM range(-20, 21) s(i) CROSS JOIN range(-20, 21) t(j) CROSS JOIN (VALUES (1), (-1)) u(b)),
discs AS MATERIALIZED (SELECT l, row_number() OVER () AS k, x, y FROM sites JOIN (VALUES (8), (10), (15), (22), (30), (40)) d(l) ON x * x + y * y <= l * l / pi() + 1e-10),
h AS MATERIALIZED (SELECT a.l, floor(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / {width!r}::DOUBLE) AS place, count(*) AS n FROM discs a JOIN discs b ON a.l = b.l AND a.k < b.k GROUP BY ALL),
qs AS (SELECT 2.5::DOUBLE + k * ((3.6::DOUBLE - 2.5::DOUBLE) / 220) AS q FROM range(221) t(k)), k AS (SELECT l, count(*) AS atoms FROM discs GROUP BY l),
s AS (SELECT l, q, sum(n * sin(q * (place + 0.5) * {width!r}) / (q * (place + 0.5) * {width!r})) AS s FROM h CROSS JOIN qs GROUP BY l, q),
p AS (SELECT l, atoms, q, (1 + 2 * s / atoms) * power({f}, 2) AS per FROM s JOIN k USING (l)),
peak AS (SELECT l, atoms, sqrt(atoms * {area!r}::DOUBLE) AS size, max(per) AS per, max_by(q, per) AS q FROM p GROUP BY l, atoms),
fit AS (SELECT regr_slope(ln(per * atoms), ln(size)) AS s, regr_intercept(ln(per * atoms), ln(size)) AS i FROM peak)
SELECT round(size, 4) AS "L_A", CAST(l AS DOUBLE) AS "requested_L_A", atoms AS atom_count, round(atoms * {area!r}::DOUBLE, 4) AS "area_A2", round(per, 4) AS "Imax_per_atom", round(per * atoms, 4) AS "Imax_per_fragment", round(q, 4) AS "peak_q_invA", FALSE AS peak_at_boundary,
  round(exp(i + s * ln(size)), 4) AS "predicted_Imax_per_fragment" FROM peak CROSS JOIN fit"""


_SIZES = """s AS (SELECT l_extendedprice / 2000.0::DOUBLE AS z FROM lineitem), m AS (SELECT count(*) AS n, min(z) AS lo, max(z) AS hi, avg(z) - min(z) AS scale, sum(power(z / (SELECT max(z) FROM s), 2.5)) AS w FROM s),
b AS (SELECT CAST(floor(z / 0.5) AS BIGINT) AS k, count(*) AS c, sum(power(z / hi, 2.5)) AS w FROM s CROSS JOIN m GROUP BY 1)"""

ORACLES = {
    "skewed_cells": f"""WITH {_CELLS}, v AS (SELECT *, h11 * h22 * h33 AS volume FROM cells)
      SELECT frame, round(volume, 6) AS volume, round(volume / sqrt(power(h22 * h33, 2) + power(h21 * h33, 2) + power(h21 * h32 - h22 * h31, 2)), 6) AS w1, round(volume / (h11 * sqrt(h33 * h33 + h32 * h32)), 6) AS w2, round(h33, 6) AS w3 FROM v""",
    "skewed_pairs": f"WITH {_skewed(4.0)} SELECT frame, si, sj, count(*) AS n, CAST(count_if(shifted) AS BIGINT) AS shifted, round(sum(sqrt(d2)), 5) AS total FROM pairs GROUP BY ALL",
    "skewed_rdf": _skewed_rdf_sql(),
    "skewed_coordination": f"""WITH {_skewed(3.0)}, bonds AS (SELECT frame, i AS a FROM pairs WHERE si = 'A' AND sj = 'B' UNION ALL SELECT frame, j FROM pairs WHERE sj = 'A' AND si = 'B'),
      n AS (SELECT frame, a, count(*) AS k FROM bonds GROUP BY ALL), samples AS (SELECT coalesce(k, 0) AS k FROM atoms LEFT JOIN n ON n.frame = atoms.frame AND a = atom WHERE species = 'A')
      SELECT CAST(c AS BIGINT) AS coordination, 'A-B' AS label, round((SELECT count(*) FROM samples WHERE k = c) / (SELECT count(*) FROM samples), 9) AS value FROM range(9) t(c)""",
    "shifted_atoms": f"WITH {_ATOMS} SELECT frame, atom, species, round(x - frame * 0.5, 9) AS x, round(y + 1, 9) AS y, round(z, 9) AS z FROM atoms",
    "selected_atoms": f"WITH {_ATOMS} SELECT frame, species, count(*) AS n FROM atoms WHERE frame IN (2, 7, 12, 17) AND ((species IN ('A', 'B') AND atom > 99) OR x < 1) GROUP BY ALL",
    "cutoff_clusters": _cutoff_sql(),
    "shared_neighbor_clusters": f"""{_NET}, sizes AS (SELECT mode, frame, c, count(*) AS size FROM comp GROUP BY ALL), kept AS (SELECT mode, size, sum(size) AS n FROM sizes WHERE size > 1 GROUP BY ALL),
      top AS (SELECT max(size) AS m FROM sizes)
      SELECT CAST(k AS BIGINT) AS cluster_size, kinds.mode AS label, round(CAST(coalesce(n / (SELECT sum(n) FROM kept x WHERE x.mode = kinds.mode), 0) AS DOUBLE), 9) AS value
      FROM range(1, (SELECT CAST(m AS BIGINT) FROM top) + 1) t(k) CROSS JOIN kinds LEFT JOIN kept ON kept.mode = kinds.mode AND size = k""",
    "percolation_frame_summary": f"{_NET}{_SUMMARY} SELECT * FROM summary",
    "percolation_summary": f"""{_NET}{_SUMMARY} SELECT {', '.join(f'round(avg("{m}"), 9) AS "mean_{m}", round(stddev_pop("{m}"), 9) AS "std_{m}"' for m in _METRICS)},
      {', '.join(f'round(avg(CAST(wrap_{k} AS INTEGER)), 9) AS wrap_probability_{k}' for k in ('x', 'y', 'z', 'any'))} FROM summary""",
    "percolation_clusters": f"""{_NET}, top AS (SELECT max(size) AS m FROM clusters), kept AS (SELECT 'mean_cluster_count_total' AS label, size FROM clusters WHERE size > 1 UNION ALL SELECT 'mean_cluster_count_finite', size FROM clusters WHERE size > 1 AND NOT w)
      SELECT CAST(k AS BIGINT) AS cluster_size, l.label, round((SELECT count(*) FROM kept WHERE kept.label = l.label AND size = k) / 21.0::DOUBLE, 9) AS value FROM range(1, (SELECT CAST(m AS BIGINT) FROM top) + 1) t(k) CROSS JOIN (VALUES ('mean_cluster_count_total'), ('mean_cluster_count_finite')) l(label)""",
    "scattering_xray": _xray_sql(),
    "scattering_xray_structure": base.ORACLES["scattering_neutron"].replace(_factor_cte("neutron"), _factor_cte("xray")),
    "scattering_neutron_rdf": _direct_sql(None),
    "scattering_interpolated": _direct_sql(_TARGETS),
    "scattering_neutron_al": f"""WITH {_scattering_cte("ashcroft-langreth")}, {_factor_cte("neutron")}, norm AS (SELECT q, sum(c * f * f) AS n FROM factor JOIN conc USING (species) GROUP BY q),
      weight AS (SELECT x.q, x.species || '-' || y.species AS label, CASE WHEN x.species = y.species THEN 1.0 ELSE 2.0 END * sqrt(cx.c * cy.c) * x.f * y.f / n AS w
        FROM factor x JOIN factor y ON y.q = x.q AND x.species <= y.species JOIN norm ON norm.q = x.q JOIN conc cx ON cx.species = x.species JOIN conc cy ON cy.species = y.species),
      c AS (SELECT part.q, part.label, (value - base) * w AS v FROM part JOIN weight ON weight.q = part.q AND weight.label = part.label)
      SELECT q AS "Q", label, round(v, 6) AS value FROM c UNION ALL SELECT q, 'Total', round(1 + sum(v), 6) FROM c GROUP BY q""",
    "bessel_simpson": f"""WITH {_rdf_cte(bin_edges(0.0, 8.08, 101, None))}, y AS (SELECT CAST(k AS DOUBLE) AS y FROM range(1, 21) t(k))
      SELECT y, label, round(sum(0.08::DOUBLE / 3 * CASE WHEN place IN (0, 100) THEN 1 WHEN place % 2 = 1 THEN 4 ELSE 2 END * r * r * (value - 1) * sin(r * y) / (r * y)), 5) AS value FROM g JOIN grid USING (r) CROSS JOIN y WHERE left(label, 1) <= right(label, 1) GROUP BY y, label""",
    "composition_table": f"""WITH {_ATOMS} SELECT species, e AS element, CAST(count(*) AS DOUBLE) AS amount, round(count(*) / sum(count(*)) OVER (), 9) AS concentration, any_value(m) AS atomic_mass, any_value(b) AS neutron_b_fm, CAST(any_value(q) AS INTEGER) AS xray_charge
      FROM atoms JOIN (VALUES ('A', 'O', 15.999::DOUBLE, 5.803::DOUBLE, 0), ('B', 'Li', 6.94, -2.22, 0), ('C', 'F', 18.998403163, 5.654, -1)) t(s, e, m, b, q) ON s = species WHERE frame = 0 GROUP BY species, e""",
    "spectral_automatic": f"""WITH {_SPECTRAL}, y AS (SELECT label, mode, ln(greatest(abs(value), 1e-6 * (SELECT min(abs(x.value)) FROM coef x WHERE x.label = coef.label AND x.mode > 0 AND x.value <> 0))) AS y FROM coef WHERE mode > 0),
      lines AS (SELECT label, k, regr_slope(y, least(mode, k)) AS s, regr_intercept(y, least(mode, k)) AS i FROM y CROSS JOIN range(2, 8) t(k) GROUP BY label, k),
      errors AS (SELECT y.label, lines.k, s, i, avg(power(y - i - s * least(mode, lines.k), 2)) AS e FROM y JOIN lines ON lines.label = y.label GROUP BY ALL),
      best AS (SELECT label, arg_min(k, e) AS k, arg_min(s, e) AS s, arg_min(i, e) AS i FROM errors WHERE s < 0 GROUP BY label), middle AS (SELECT label, median(y) AS m FROM y GROUP BY label)
      SELECT label, CAST(coalesce(k, 2) AS INTEGER) AS selected_mode, round(coalesce(-s, 0), 6) AS decay_rate, round(coalesce(i + s * k, m), 6) AS log_noise_floor, k IS NULL AS fallback FROM middle LEFT JOIN best USING (label)""",
    "xyz_atoms": f"""WITH {_ATOMS}, p AS (SELECT frame, species, round(x, 6) AS x, round(y, 6) AS y FROM atoms), n AS (SELECT species, count(*) AS n, CASE species WHEN (SELECT species FROM atoms WHERE frame = 0 AND atom = (SELECT min(atom) FROM atoms)) THEN 0 ELSE 1 END AS o FROM atoms WHERE frame = 0 GROUP BY species),
      seen AS (SELECT species, min(atom) AS place FROM atoms WHERE frame = 0 GROUP BY species), ranks AS (SELECT s.species, coalesce(sum(n.n), 0) AS before FROM seen s LEFT JOIN seen t ON t.place < s.place LEFT JOIN n ON n.species = t.species GROUP BY s.species)
      SELECT frame, p.species, count(*) AS n, CAST(any_value(before) AS BIGINT) AS first, CAST(any_value(before) + count(*) - 1 AS BIGINT) AS last, round(sum(x - frame * 0.5), 4) AS x, round(sum(y), 4) AS y FROM p JOIN ranks ON ranks.species = p.species GROUP BY frame, p.species""",
    "xyz_selected_frames": f"""WITH {_ATOMS}, w(frame, source_frame) AS (VALUES (0, 17), (1, 3), (2, 4)), placed AS (SELECT *, CASE WHEN frame % 2 = 0 THEN row_number() OVER (PARTITION BY frame ORDER BY atom) ELSE row_number() OVER (PARTITION BY frame ORDER BY atom DESC) END - 1 AS place FROM atoms)
      SELECT CAST(w.frame AS BIGINT) AS frame, CAST(place AS BIGINT) AS atom, species, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(source_frame AS BIGINT) AS source_frame, 10000.0::DOUBLE AS volume FROM placed JOIN w ON w.source_frame = placed.frame WHERE place < 3""",
    "neighbor_lists": f"""WITH {_pairs(2.2)}, n AS (SELECT frame, i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS l FROM pairs WHERE sj IN ('B', 'C') GROUP BY frame, i)
      SELECT a.frame, a.atom AS i, coalesce(l, '') AS neighbors FROM atoms a LEFT JOIN n ON n.frame = a.frame AND n.i = a.atom WHERE a.species IN ('A', 'C')""",
    "cached_coordination": base.ORACLES["coordination_distribution"],
    "scattering_repaired": base.ORACLES["partial_structure_factors"],
    "plotted_structure_factor": f"""WITH s AS ({base.ORACLES["scattering_neutron"]}) SELECT round("Q", 6) AS "Q", label, round(value + CASE WHEN label = 'Total' THEN 0 ELSE 1 END, 6) AS y FROM s""",
    "graphenic_sheets": """SELECT CAST(k AS BIGINT) AS frame, CAST((k + 4) * (k + 4) AS BIGINT) AS ring_count, CAST(2 * (k + 4) * (k + 4) AS BIGINT) AS atom_count, TRUE AS wrap_a, TRUE AS wrap_b, FALSE AS wrap_c,
      round((k + 4) * (k + 4) * 1.5 * sqrt(3.0::DOUBLE) * 1.42 * 1.42, 6) AS "area_A2", 'periodic_cell' AS area_scope, 1.0::DOUBLE AS normal_nematic_order FROM range(6) t(k)""",
    "rings": f"{_rings_cte()} SELECT frame, array_to_string(path, ',') AS ring FROM found",
    "ring_counts": f"{_rings_cte()} SELECT frame, n AS ring_size, count(*) AS n FROM found GROUP BY frame, n",
    "debye_pattern": _debye_sql(),
    "crystallite_sizes_summary": f"""WITH {_SIZES}, g AS (SELECT k FROM range((SELECT min(k) FROM b), (SELECT max(k) FROM b) + 1) t(k))
      SELECT g.k * 0.5 + 0.25 AS "sqrt_area_size_A", g.k * 0.5 AS "bin_lower_A", g.k * 0.5 + 0.5 AS "bin_upper_A", coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * 0.5), 9) AS number_density, round(coalesce(b.w, 0) / (m.w * 0.5), 9) AS weighted_density,
        round((exp(-(greatest(lo, g.k * 0.5) - lo) / scale) - exp(-(greatest(lo, g.k * 0.5 + 0.5) - lo) / scale)) / 0.5, 9) AS number_fit_density FROM g CROSS JOIN m LEFT JOIN b ON b.k = g.k""",
    "crystallite_sizes_moments": f"""WITH {_SIZES}, r AS (SELECT z, rank() OVER (ORDER BY z) - 1 AS below, count(*) OVER (ORDER BY z RANGE UNBOUNDED PRECEDING) AS upto FROM s),
      dev AS (SELECT max(greatest(abs(1 - exp(-(z - lo) / scale) - upto / n), abs(1 - exp(-(z - lo) / scale) - below / n))) AS d FROM r CROSS JOIN m)
      SELECT n AS count, CASE WHEN d > 0.2 THEN 'review' ELSE 'pass' END AS fit_status, round((SELECT avg(z) FROM s), 7) AS "number_mean_A", round((SELECT median(z) FROM s), 7) AS "number_median_A", round((SELECT sum(z * power(z, 2.5)) / sum(power(z, 2.5)) FROM s), 7) AS "weighted_mean_A",
        CAST((SELECT arg_max(k, w) FROM b) * 0.5 + 0.25 AS DOUBLE) AS "weighted_empirical_mode_A", round(scale, 7) AS "exponential_scale_A", round(greatest(lo, 2.5 * scale), 7) AS "weighted_fit_mode_A", round(d, 7) AS exponential_cdf_max_deviation,
        round((SELECT sum(CASE WHEN z < 12 THEN power(z, 2.5) ELSE 0 END) / sum(power(z, 2.5)) FROM s), 7) AS weighted_fraction_below_diffraction_size FROM m CROSS JOIN dev""",
    "graphene_calibration_fine": _calibration_sql(0.00093),
}
