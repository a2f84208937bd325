"""Registered queries over the driver's tables, and their DuckDB SQL.

The trajectory is the projection of the embeddings table: 21 frames, a cube of 20 angstrom.  Floats
are rounded in both engines, as their sums depend on the order of addition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserspark.functions.bins import bin_edges
from tesserspark.operators import angles, carbon, clustering, coordination, diffraction, rad, rdf, scattering
from tesserspark.operators.tables import Table
from tesserspark.plans.neighbors import neighbor_pairs
from tesserspark.plans.staging import materialize
from tesserspark.sources.trajectory import project_embeddings

ELEMENTS = {"A": "O", "B": "Li", "C": "F"}
SIDE = 20.0


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _long(t: Table, places: int = 9) -> DataFrame:
    return t.long.select(t.axis, "label", F.round("value", places).alias("value"))


def atoms_projection(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(project_embeddings(spark, d).atoms)


def species_counts(spark, d):
    return project_embeddings(spark, d).atoms.groupBy("frame", "species").agg(F.count(F.lit(1)).alias("n"))


def frame_cells(spark, d):
    return _rounded(project_embeddings(spark, d).frames.select("frame", "source_frame", "volume", "safe_radius"), 4)


def min_image_pairs(spark, d):
    near = neighbor_pairs(project_embeddings(spark, d), 4.0, half=True)
    return near.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.sqrt("d2")), 5).alias("total"))


def rdf_counts(spark, d):
    t = project_embeddings(spark, d)
    return rdf.pair_histogram(t, rdf.normalize_pairs(t, None), bin_edges(0.0, 8.0, None, 0.1)).withColumn("n", F.col("n").cast("long"))


def rdf_partial(spark, d):
    return _rounded(rdf.compute_rdfs(project_embeddings(spark, d), step=0.1, r_range=(0.0, 8.0)).wide)


def rdf_directed_pairs(spark, d):
    return _rounded(rdf.compute_rdfs(project_embeddings(spark, d), [("B", "A"), ("A", "B"), ("C", "C")], bins=50, r_range=(1.0, 6.0)).wide)


def spectral_coefficients(spark, d):
    t = rdf.compute_spectral_rdfs(project_embeddings(spark, d), modes=12, step=0.5, r_range=(1.0, 5.0))
    rows = [(k, m, float(v)) for k, c in t.attrs["spectral"]["coefficients"].items() for m, v in enumerate(c)]
    return _rounded(spark.createDataFrame(rows, "label string, mode int, value double"), 7)


def spectral_rdf(spark, d):
    return _long(rdf.compute_spectral_rdfs(project_embeddings(spark, d), modes=12, step=0.5, r_range=(1.0, 5.0)), 7)


def system_metadata(spark, d):
    t = project_embeddings(spark, d)
    m = rdf.system_metadata(t, rdf.normalize_pairs(t, None))
    rows = [(s, n, m["atomic_fractions"][s], m["number_density"]) for s, n in m["atom_counts"].items()]
    return _rounded(spark.createDataFrame(rows, "species string, n long, fraction double, number_density double"))


COORDINATION = [("A", "B", 3.0), ("B", "B", 1.0, 3.5), ("A", "C", 0.5, 2.5, "narrow")]


def coordination_distribution(spark, d):
    return _long(coordination.compute_coordination(project_embeddings(spark, d), COORDINATION, max_coordination=6))


def coordination_summary(spark, d):
    return _rounded(coordination.summarize_coordination(coordination.compute_coordination(project_embeddings(spark, d), COORDINATION, max_coordination=6)), 7)


ANGLES = [("A", "B", "A", 3.0), ("A", "B", "A", 3.0, 2.5, "unequal"), ("A", "B", "C", 3.0, 2.8)]


def bond_angles(spark, d):
    return _long(angles.compute_bond_angles(project_embeddings(spark, d), ANGLES, bins=36))


def rad_contacts(spark, d):
    found = rad.with_mutual(rad.shells(project_embeddings(spark, d)))
    return found.select("frame", "i", "si", "j", "sj", F.round(F.sqrt("d2"), 9).alias("distance"), "is_mutual")


def rad_coordination(spark, d):
    return _long(rad.compute_rad_coordination(project_embeddings(spark, d), [("A", "B"), ("A", "A"), ("C", "A")], bond_mode="mutual"))


def _environments(spark, d):
    return rad.compute_rad_environments(project_embeddings(spark, d), ["A", "B"], neighbor_species=["C", "A"])


def rad_environments(spark, d):
    return _rounded(_environments(spark, d).environments)


def speciation_distribution(spark, d):
    return _rounded(_environments(spark, d).speciation_distribution())


def occupancy(spark, d):
    shares = _environments(spark, d).occupancy(assume_stable_atom_identity=True, ordered=False)
    return shares.withColumn("occupancy", F.when(F.col("observations") > 0, F.round("occupancy", 9)).otherwise(0.0))  # most are zero, and rounding is dear


def lifetimes(spark, d):
    return _environments(spark, d).lifetimes(assume_stable_atom_identity=True)


def distance_clusters(spark, d):
    return _long(clustering.compute_by_distance(project_embeddings(spark, d), "A", 1.8).cluster_distribution)


def distance_clusters_counted(spark, d):
    return _long(clustering.compute_by_distance(project_embeddings(spark, d), ("A", "B"), 1.8, count_species="A").cluster_distribution)


def _shared(spark, d):
    return clustering.compute_by_shared_neighbors(project_embeddings(spark, d), "A", "B", 2.0)


def shared_neighbor_sharing(spark, d):
    return _rounded(_shared(spark, d).sharing_distribution)


def shared_neighbor_clusters(spark, d):
    return _long(_shared(spark, d).cluster_distribution)


def percolation_frame_summary(spark, d):
    return _rounded(_shared(spark, d).frame_summary)


def percolation_summary(spark, d):
    return _rounded(_shared(spark, d).percolation_summary)


def percolation_clusters(spark, d):
    return _long(_shared(spark, d).percolation_cluster_distribution)


def _scattering(spark, d, convention="faber-ziman", probes=("neutron", "xray")):
    t = rdf.compute_rdfs(project_embeddings(spark, d), bins=100, r_range=(0.0, 8.0))
    return scattering.compute_scattering(Table(materialize(t.long, "rdf"), t.axis, t.labels, t.attrs), elements=ELEMENTS, convention=convention, probes=probes, q_range=(0.5, 10.0))


def partial_structure_factors(spark, d):
    return _long(_scattering(spark, d, probes=("neutron",)).partial_structure_factors, 6)


def partial_structure_factors_al(spark, d):
    return _long(_scattering(spark, d, "ashcroft-langreth", ("neutron",)).partial_structure_factors, 6)


def scattering_weights(spark, d):
    return _long(_scattering(spark, d, probes=("xray",)).xray.weights, 7)


def scattering_neutron(spark, d):
    return _long(_scattering(spark, d, probes=("neutron",)).neutron.structure_factor, 6)


def scattering_xray(spark, d):
    return _long(_scattering(spark, d, probes=("xray",)).xray.weighted_rdf, 6)


def shared_parts_network(spark, d):
    """Suppliers linked by the parts that both supplied, at the volume of lineitem."""
    bonds = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("g")).distinct()
    other = bonds.select(F.col("c").alias("c2"), F.col("g").alias("g2"))
    both = bonds.join(other, (F.col("g") == F.col("g2")) & (F.col("c") < F.col("c2")))
    linked = both.groupBy("c", "c2").agg(F.count(F.lit(1)).alias("shared"))
    return linked.groupBy("shared").agg(F.count(F.lit(1)).alias("links")).select("shared", "links", clustering.sharing_type(F.col("shared")).alias("sharing_type"))


def event_runs(spark, d):
    """Runs of consecutive days on which a user had an event of a type."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day")).distinct()
    rows = e.select("user_id", "event_type", F.col("day").alias("position"), F.col("day").alias("frame"), F.col("day").alias("source_frame"))
    return rad.contact_runs(rows, ["user_id", "event_type"]).select("user_id", "event_type", "start_frame", "end_frame", "lifetime_samples")


def bessel_transform(spark, d):
    """Transform of h(r) = g(r) - 1 of every pair, from the histogram."""
    from tesserspark.functions import transforms

    t = rdf.compute_rdfs(project_embeddings(spark, d), bins=100, r_range=(0.0, 8.0))
    r = np.linspace(0.04, 7.96, 100)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(transforms.quadrature_weights(r))], "place int, weight double")
    curves = t.long.select("r", "label", (F.col("value") - 1).alias("value"), F.floor(F.col("r") / 0.08).cast("int").alias("p")).join(F.broadcast(weights), F.col("p") == F.col("place"))
    return _rounded(transforms.bessel_transform(curves, spark.range(1, 21).select(F.col("id").cast("double").alias("y")), "r", "y"), 5)


def debye_histogram(spark, d):
    """Open-boundary pair distances of each frame."""
    t = project_embeddings(spark, d)
    return diffraction.debye_histogram(t.atoms, 0.5, "frame")


def debye_pattern(spark, d):
    t = project_embeddings(spark, d)
    return _rounded(diffraction.debye_patterns(t.atoms, [0.5, 1.0, 2.0, 4.0], 0.05, "frame"), 6).withColumn("I_per_fragment", F.round("I_per_fragment", 3))


def _edges(spark, d, cutoff: float = 1.8):
    near = neighbor_pairs(project_embeddings(spark, d), cutoff)
    return near.select("frame", F.col("i").alias("src"), F.col("j").alias("dst"))


def ring_counts(spark, d):
    return carbon.trajectory_ring_counts(project_embeddings(spark, d), 1.8, 8).select("frame", F.col("ring_size").cast("long").alias("ring_size"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        atoms_projection, species_counts, frame_cells, min_image_pairs, rdf_counts, rdf_partial, rdf_directed_pairs, spectral_coefficients, spectral_rdf, system_metadata,
        coordination_distribution, coordination_summary, bond_angles, rad_contacts, rad_coordination, rad_environments, speciation_distribution, occupancy, lifetimes,
        distance_clusters, distance_clusters_counted, shared_neighbor_sharing, shared_neighbor_clusters, percolation_frame_summary, percolation_summary, percolation_clusters,
        partial_structure_factors, partial_structure_factors_al, scattering_weights, scattering_neutron, scattering_xray, bessel_transform, debye_histogram, debye_pattern, ring_counts,
        shared_parts_network, event_runs,
    )
}

# ---------------------------------------------------------------------------------------------- SQL

_ATOMS = """
atoms AS (
  SELECT CAST(f AS BIGINT) AS frame, CAST(vec_id AS BIGINT) AS atom, chr(65 + CAST(label % 3 AS INTEGER)) AS species,
    20.0::DOUBLE * (97 * e0 - floor(97 * e0)) AS x, 20.0::DOUBLE * (97 * e1 - floor(97 * e1)) AS y, 20.0::DOUBLE * (97 * e2 - floor(97 * e2)) AS z
  FROM (SELECT vec_id, label, f, CAST(embedding[3 * f + 1] AS DOUBLE) AS e0, CAST(embedding[3 * f + 2] AS DOUBLE) AS e1, CAST(embedding[3 * f + 3] AS DOUBLE) AS e2
        FROM embeddings, range(21) t(f)))"""


def _pairs(reach: float, directed: bool = True) -> str:
    """Pairs within reach, i's displacement to the nearest image of j; every pair from both ends if directed."""
    g = {k: f"b.{k} * 0.05::DOUBLE - a.{k} * 0.05::DOUBLE" for k in "xyz"}
    wrapped = ", ".join(f"20.0::DOUBLE * (({v}) - floor(({v}) + 0.5::DOUBLE)) AS d{k}" for k, v in g.items())
    return f"""{_ATOMS},
pairs AS (
  SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM (
    SELECT a.frame, a.atom AS i, a.species AS si, b.atom AS j, b.species AS sj, {wrapped}
    FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom {'<>' if directed else '<'} b.atom)
  WHERE dx * dx + dy * dy + dz * dz < {reach!r}::DOUBLE * {reach!r}::DOUBLE)"""


def _bin(value: str, edges: np.ndarray) -> str:
    """Place among exact edges, the last bin closed."""
    listed = "[" + ", ".join(f"{float(e)!r}::DOUBLE" for e in edges) + "]"
    return f"CASE WHEN {value} >= {float(edges[0])!r} AND {value} <= {float(edges[-1])!r} THEN least(len(list_filter({listed}, lambda e: e <= {value})) - 1, {len(edges) - 2}) END"


def _grid(edges: np.ndarray, axis: str = "r") -> str:
    rows = ", ".join(f"({k}, {float(0.5 * (a + b))!r}::DOUBLE, {float(4.0 * np.pi / 3.0 * (b**3 - a**3))!r}::DOUBLE)" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    return f"grid(place, {axis}, shell) AS (VALUES {rows})"


_R8 = bin_edges(0.0, 8.0, None, 0.1)
_SCALES = """
scales AS (
  SELECT l.a, l.b, sum(x.n * (y.n - CASE WHEN l.a = l.b THEN 1 ELSE 0 END) / 8000.0::DOUBLE) AS scale
  FROM (SELECT DISTINCT x.species AS a, y.species AS b FROM atoms x, atoms y WHERE x.frame = 0 AND y.frame = 0) l
  JOIN (SELECT frame, species, count(*) AS n FROM atoms GROUP BY ALL) x ON x.species = l.a
  JOIN (SELECT frame, species, count(*) AS n FROM atoms GROUP BY ALL) y ON y.species = l.b AND y.frame = x.frame
  GROUP BY l.a, l.b)"""


def _rdf_cte(edges: np.ndarray) -> str:
    return f"""{_pairs(float(np.nextafter(edges[-1], np.inf)))}, {_grid(edges)}, {_SCALES},
counts AS (SELECT si, sj, place, count(*) AS n FROM (SELECT si, sj, {_bin('sqrt(d2)', edges)} AS place FROM pairs) WHERE place IS NOT NULL GROUP BY ALL),
g AS (
  SELECT r, a || '-' || b AS label, coalesce(n, 0) / (scale * shell) AS value
  FROM grid CROSS JOIN scales LEFT JOIN counts ON counts.place = grid.place AND si = a AND sj = b)"""


def _wide(labels: list[str], axis: str, source: str) -> str:
    return f"SELECT round({axis}, 9) AS {axis}, " + ", ".join(f"round(max(CASE WHEN label = '{x}' THEN value END), 9) AS \"{x}\"" for x in labels) + f" FROM {source} GROUP BY {axis}"


def _coordination_sql() -> str:
    defs = "(VALUES ('A-B', 'A', 'B', 0.0::DOUBLE, 3.0::DOUBLE), ('B-B', 'B', 'B', 1.0, 3.5), ('narrow', 'A', 'C', 0.5, 2.5)) d(label, c, n, lo, hi)"
    return f"""WITH {_pairs(3.5)},
samples AS (
  SELECT label, frame, atom, (SELECT count(*) FROM pairs p WHERE p.frame = a.frame AND p.i = a.atom AND p.sj = d.n AND p.d2 >= lo * lo AND p.d2 < hi * hi) AS k
  FROM atoms a JOIN {defs} ON a.species = d.c),
shares AS (SELECT label, k, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share FROM samples GROUP BY label, k),
dist AS (
  SELECT CAST(c AS BIGINT) AS coordination, label, coalesce(share, 0) AS value
  FROM range(7) t(c) CROSS JOIN (SELECT DISTINCT label FROM samples) LEFT JOIN shares USING (label) WHERE FALSE
  UNION ALL
  SELECT CAST(t.c AS BIGINT), l.label, coalesce(s.share, 0) FROM range(7) t(c) CROSS JOIN (SELECT DISTINCT label FROM samples) l LEFT JOIN shares s ON s.label = l.label AND s.k = t.c)"""


def _angle_sql() -> str:
    edges = bin_edges(0.0, 180.0, 36, None)
    rows = ", ".join(f"({k}, {float(0.5 * (a + b))!r}::DOUBLE)" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    return f"""WITH {_pairs(3.0)},
defs(label, l, c, r, lc, rc, kind) AS (VALUES ('A-B-A', 'A', 'B', 'A', 3.0::DOUBLE, 3.0::DOUBLE, 'same'), ('unequal', 'A', 'B', 'A', 3.0, 2.5, 'ordered'), ('A-B-C', 'A', 'B', 'C', 3.0, 2.8, 'mixed')),
bonds AS (SELECT frame, i, si, j, sj, d2, dx / sqrt(d2) AS ux, dy / sqrt(d2) AS uy, dz / sqrt(d2) AS uz FROM pairs WHERE d2 > 0),
found AS (
  SELECT label, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, p.ux * q.ux + p.uy * q.uy + p.uz * q.uz)))) AS angle
  FROM defs JOIN bonds p ON p.si = c AND p.sj = l AND p.d2 < lc * lc JOIN bonds q ON q.frame = p.frame AND q.i = p.i AND q.sj = r AND q.d2 < rc * rc
  WHERE (kind = 'same' AND p.j < q.j) OR (kind = 'ordered' AND p.j <> q.j) OR kind = 'mixed'),
counted AS (SELECT label, place, count(*) AS n FROM (SELECT label, {_bin('angle', edges)} AS place FROM found) WHERE place IS NOT NULL GROUP BY ALL),
grid(place, angle) AS (VALUES {rows}), totals AS (SELECT label, sum(n) AS total FROM counted GROUP BY label)
SELECT angle, t.label, round(coalesce(n, 0) / (total * 5.0), 9) AS value FROM grid CROSS JOIN totals t LEFT JOIN counted c ON c.label = t.label AND c.place = grid.place"""


#: Shells in SQL, from all atoms within 6 angstrom; a center whose shell does not end there keeps them all.
_RAD = f"""{_pairs(6.0)},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY d2, j) AS rank FROM pairs WHERE d2 > 1e-16)),
ends AS (
  SELECT f.frame, f.i, min(f.rank) AS e FROM ranked f JOIN ranked k ON k.frame = f.frame AND k.i = f.i AND k.rank < f.rank
  WHERE 1.0::DOUBLE / f.d2 <= (f.dx * k.dx + f.dy * k.dy + f.dz * k.dz) / (sqrt(f.d2) * sqrt(k.d2)) / k.d2 GROUP BY f.frame, f.i),
shell AS (SELECT r.frame, r.i, si, j, sj, d2 FROM ranked r LEFT JOIN ends ON ends.frame = r.frame AND ends.i = r.i WHERE e IS NULL OR rank < e),
mutual AS (SELECT s.*, t.i IS NOT NULL AS is_mutual FROM shell s LEFT JOIN shell t ON t.frame = s.frame AND t.i = s.j AND t.j = s.i)"""

_RAD_ENV = f"""{_RAD},
env AS (
  SELECT a.frame, a.frame AS source_frame, a.atom AS center_index, a.species AS center_species, n.s AS neighbor_species, count(m.j) AS coordination,
    round(avg(sqrt(d2)), 9) AS mean_distance, round(min(sqrt(d2)), 9) AS min_distance, round(max(sqrt(d2)), 9) AS max_distance
  FROM atoms a CROSS JOIN (VALUES ('C'), ('A')) n(s) LEFT JOIN shell m ON m.frame = a.frame AND m.i = a.atom AND m.sj = n.s
  WHERE a.species IN ('A', 'B') GROUP BY a.frame, a.atom, a.species, n.s),
contacts AS (SELECT frame, i AS center_index, si AS center_species, j AS neighbor_index, sj AS neighbor_species FROM shell WHERE si IN ('A', 'B') AND sj IN ('C', 'A'))"""


def _cluster_sql(counted: bool) -> str:
    ends = "((si = 'A' AND sj = 'B') OR (si = 'B' AND sj = 'A'))" if counted else "si = 'A' AND sj = 'A'"
    nodes = "species IN ('A', 'B')" if counted else "species = 'A'"
    size = "count_if(species = 'A')" if counted else "count(*)"
    return f"""WITH RECURSIVE {_pairs(1.8)},
links AS MATERIALIZED (SELECT frame, i, j FROM pairs WHERE {ends}),
reach AS (
  SELECT frame, atom AS node, atom AS other FROM atoms WHERE {nodes}
  UNION SELECT reach.frame, reach.node, links.j FROM reach JOIN links ON links.frame = reach.frame AND links.i = reach.other),
comp AS (SELECT frame, node, min(other) AS c FROM reach GROUP BY frame, node),
sizes AS (SELECT comp.frame AS frame, c, {size} AS size FROM comp JOIN atoms ON atoms.frame = comp.frame AND atom = node GROUP BY comp.frame, c),
counted AS (SELECT size, {'sum(size)' if counted else 'count(*)'} AS n FROM (SELECT size FROM sizes WHERE size > 1) GROUP BY size)
SELECT CAST(s AS BIGINT) AS cluster_size, 'probability' AS label, round(coalesce(n, 0) / (SELECT sum(n) FROM counted), 9) AS value
FROM range(1, (SELECT CAST(max(size) AS BIGINT) FROM counted) + 1) t(s) LEFT JOIN counted ON size = s"""


_SHARED = f"""{_pairs(2.0)},
bonds AS (SELECT frame, i AS c, j AS g FROM pairs WHERE si = 'A' AND sj = 'B'),
links AS (SELECT a.frame, a.c AS l, b.c AS r, count(*) AS shared FROM bonds a JOIN bonds b ON a.frame = b.frame AND a.g = b.g AND a.c < b.c GROUP BY ALL)"""


def _scattering_cte(convention: str) -> str:
    edges = bin_edges(0.0, 8.0, 100, None)
    r = 0.5 * (edges[:-1] + edges[1:])
    q = scattering.q_points(scattering.even_grid(r), (0.5, 10.0), None)
    points = ", ".join(f"({float(x)!r}::DOUBLE)" for x in q)
    from tesserspark.functions.transforms import quadrature_weights

    weights = ", ".join(f"({k}, {float(w)!r}::DOUBLE)" for k, w in enumerate(quadrature_weights(scattering.even_grid(r))))
    scale, base = ("1.0", "1.0") if convention == "faber-ziman" else ("sqrt(ca.c * cb.c)", "CASE WHEN a = b THEN 1.0 ELSE 0.0 END")
    return f"""{_rdf_cte(edges)}, qs(q) AS (VALUES {points}), w(place, w) AS (VALUES {weights}),
conc AS (SELECT species, count(*) / sum(count(*)) OVER () AS c FROM atoms WHERE frame = 0 GROUP BY species),
density AS (SELECT count(*) / 8000.0::DOUBLE AS rho FROM atoms WHERE frame = 0),
part AS (
  SELECT q, label, a, b, {base} AS base, {base} + {scale} * 4 * pi() * rho * t AS value
  FROM (SELECT q, label, left(label, 1) AS a, right(label, 1) AS b, sum(w * r * r * (value - 1) * CASE WHEN q * r = 0 THEN 1 ELSE sin(q * r) / (q * r) END) AS t
        FROM g JOIN grid USING (r) JOIN w USING (place) CROSS JOIN qs WHERE left(label, 1) <= right(label, 1) GROUP BY q, label)
  CROSS JOIN density JOIN conc ca ON ca.species = a JOIN conc cb ON cb.species = b)"""


def _factor_cte(probe: str) -> str:
    from tesserspark.functions import constants

    if probe == "neutron":
        rows = ", ".join(f"('{s}', {constants.neutron_b(e)!r}::DOUBLE)" for s, e in ELEMENTS.items())
        return f"factor AS (SELECT q, s AS species, f FROM qs CROSS JOIN (VALUES {rows}) t(s, f))"
    parts = " UNION ALL ".join(
        f"SELECT q, '{s}' AS species, " + " + ".join(f"{x!r} * exp(-{y!r} * power(q / (4 * pi()), 2))" for x, y in zip(*constants.xray_terms(e)[:2])) + f" + {constants.xray_terms(e)[2]!r} AS f FROM qs" for s, e in ELEMENTS.items()
    )
    return f"factor AS ({parts})"


def _weights_cte(probe: str) -> str:
    return f"""{_factor_cte(probe)},
norm AS (SELECT q, power(sum(c * f), 2) AS n FROM factor JOIN conc USING (species) GROUP BY q),
weight AS (
  SELECT x.q, x.species || '-' || y.species AS label, CASE WHEN x.species = y.species THEN 1.0 ELSE 2.0 END * cx.c * cy.c * x.f * y.f / n AS w
  FROM factor x JOIN factor y ON y.q = x.q AND x.species <= y.species JOIN norm ON norm.q = x.q JOIN conc cx ON cx.species = x.species JOIN conc cy ON cy.species = y.species)"""


_ALL_PAIRS = ["A-A", "A-B", "A-C", "B-B", "B-C", "C-C"]
_DIRECTED = bin_edges(1.0, 6.0, 50, None)
_SPECTRAL = f"""{_pairs(5.0)}, {_SCALES},
sums AS (
  SELECT a || '-' || b AS label, a, b, mode, s * CASE WHEN mode = 0 THEN 1 / sqrt(4.0::DOUBLE) ELSE sqrt(2 / 4.0::DOUBLE) END AS total
  FROM (SELECT si AS a, sj AS b, m AS mode, sum(1 / (4 * pi() * d2) * cos(m * (pi() * (sqrt(d2) - 1.0) / 4.0))) AS s
        FROM pairs CROSS JOIN range(13) t(m) WHERE sqrt(d2) >= 1.0 AND si <= sj GROUP BY si, sj, m)),
coef AS (SELECT label, mode, total / scale AS value FROM sums JOIN scales USING (a, b))"""

ORACLES = {
    "atoms_projection": f"WITH {_ATOMS} SELECT frame, atom, species, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM atoms",
    "species_counts": f"WITH {_ATOMS} SELECT frame, species, count(*) AS n FROM atoms GROUP BY ALL",
    "frame_cells": "SELECT CAST(f AS BIGINT) AS frame, CAST(f AS BIGINT) AS source_frame, 8000.0::DOUBLE AS volume, 10.0::DOUBLE AS safe_radius FROM range(21) t(f)",
    "min_image_pairs": f"WITH {_pairs(4.0, False)} SELECT frame, count(*) AS n, round(sum(sqrt(d2)), 5) AS total FROM pairs GROUP BY frame",
    "rdf_counts": f"WITH {_pairs(float(np.nextafter(8.0, 9.0)))} SELECT si AS a, sj AS b, CAST(place AS INTEGER) AS place, count(*) AS n FROM (SELECT si, sj, {_bin('sqrt(d2)', _R8)} AS place FROM pairs WHERE si <= sj) WHERE place IS NOT NULL GROUP BY ALL",
    "rdf_partial": f"WITH {_rdf_cte(_R8)} {_wide(_ALL_PAIRS, 'r', 'g')}",
    "rdf_directed_pairs": f"WITH {_rdf_cte(_DIRECTED)} {_wide(['B-A', 'A-B', 'C-C'], 'r', 'g')}",
    "spectral_coefficients": f"WITH {_SPECTRAL} SELECT label, CAST(mode AS INTEGER) AS mode, round(value, 7) AS value FROM coef",
    "spectral_rdf": f"WITH {_SPECTRAL} SELECT 1.0::DOUBLE + 0.5::DOUBLE * k AS r, label, round(sum(value * CASE WHEN mode = 0 THEN 1 / sqrt(4.0::DOUBLE) ELSE sqrt(2 / 4.0::DOUBLE) END * cos(pi() * (0.5::DOUBLE * k) * mode / 4.0)), 7) AS value FROM coef CROSS JOIN (SELECT CAST(k AS DOUBLE) AS k FROM range(9) t(k)) GROUP BY k, label",
    "system_metadata": f"WITH {_ATOMS} SELECT species, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS fraction, round(CAST(sum(count(*)) OVER () AS DOUBLE) / 8000.0, 9) AS number_density FROM atoms WHERE frame = 0 GROUP BY species",
    "coordination_distribution": f"{_coordination_sql()} SELECT coordination, label, round(CAST(value AS DOUBLE), 9) AS value FROM dist",
    "coordination_summary": f"""{_coordination_sql()},
      m AS (SELECT label, sum(value) AS p, sum(value * coordination) AS f, sum(value * coordination * coordination) AS s FROM dist GROUP BY label)
      SELECT label AS pair, round(f / p, 7) AS mean, round(s / p - (f / p) * (f / p), 7) AS variance, round(sqrt(s / p - (f / p) * (f / p)), 7) AS sd, round(CAST(p AS DOUBLE), 7) AS represented_probability,
        round(CAST(coalesce((SELECT sum(share) FROM shares x WHERE x.label = m.label AND k > 6), 0) AS DOUBLE), 7) AS overflow_probability FROM m""",
    "bond_angles": _angle_sql(),
    "rad_contacts": f"WITH {_RAD} SELECT frame, i, si, j, sj, round(sqrt(d2), 9) AS distance, is_mutual FROM mutual",
    "rad_coordination": f"""WITH {_RAD}, defs(label, c, n) AS (VALUES ('A-B', 'A', 'B'), ('A-A', 'A', 'A'), ('C-A', 'C', 'A')),
      samples AS (SELECT label, a.frame, a.atom, count(m.j) AS k FROM atoms a JOIN defs ON a.species = c LEFT JOIN mutual m ON m.frame = a.frame AND m.i = a.atom AND m.sj = n AND m.is_mutual GROUP BY ALL),
      shares AS (SELECT label, k, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share FROM samples GROUP BY label, k)
      SELECT CAST(t.c AS BIGINT) AS coordination, d.label, round(CAST(coalesce(share, 0) AS DOUBLE), 9) AS value FROM range((SELECT max(k) FROM samples) + 1) t(c) CROSS JOIN defs d LEFT JOIN shares s ON s.label = d.label AND s.k = t.c""",
    "rad_environments": f"WITH {_RAD_ENV} SELECT * FROM env",
    "speciation_distribution": f"""WITH {_RAD_ENV},
      spec AS (SELECT frame, center_index, center_species, center_species || 'C' || max(CASE WHEN neighbor_species = 'C' THEN coordination END) || 'A' || max(CASE WHEN neighbor_species = 'A' THEN coordination END) AS label FROM env GROUP BY frame, center_index, center_species)
      SELECT center_species, label, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY center_species), 9) AS probability FROM spec GROUP BY center_species, label""",
    "occupancy": f"""WITH {_RAD_ENV}, first AS (SELECT atom, species FROM atoms WHERE frame = 0)
      SELECT c.atom AS center_index, c.species AS center_species, n.atom AS neighbor_index, n.species AS neighbor_species, count(DISTINCT k.frame) AS observations, round(count(DISTINCT k.frame) / 21, 9) AS occupancy
      FROM first c JOIN first n ON c.atom <> n.atom AND c.species IN ('A', 'B') AND n.species IN ('C', 'A') LEFT JOIN contacts k ON k.center_index = c.atom AND k.neighbor_index = n.atom GROUP BY ALL""",
    "lifetimes": f"""WITH {_RAD_ENV}, runs AS (SELECT *, frame - row_number() OVER (PARTITION BY center_index, neighbor_index ORDER BY frame) AS island FROM contacts)
      SELECT center_index, center_species, neighbor_index, neighbor_species, min(frame) AS start_frame, max(frame) AS end_frame, min(frame) AS start_source_frame, max(frame) AS end_source_frame, count(*) AS lifetime_samples,
        max(frame) - min(frame) AS logical_frame_span, max(frame) - min(frame) AS source_frame_span FROM runs GROUP BY center_index, center_species, neighbor_index, neighbor_species, island""",
    "distance_clusters": _cluster_sql(False),
    "distance_clusters_counted": _cluster_sql(True),
    "shared_neighbor_sharing": f"""WITH {_SHARED} SELECT shared AS shared_neighbors, round(count(*) / sum(count(*)) OVER (), 9) AS probability,
      CASE WHEN shared = 1 THEN 'corner' WHEN shared = 2 THEN 'edge' ELSE 'face' END AS sharing_type FROM links GROUP BY shared""",
    "partial_structure_factors": f'WITH {_scattering_cte("faber-ziman")} SELECT q AS "Q", label, round(value, 6) AS value FROM part',
    "partial_structure_factors_al": f'WITH {_scattering_cte("ashcroft-langreth")} SELECT q AS "Q", label, round(value, 6) AS value FROM part',
    "scattering_weights": f'WITH {_scattering_cte("faber-ziman")}, {_weights_cte("xray")} SELECT q AS "Q", label, round(w, 7) AS value FROM weight',
    "scattering_neutron": f"""WITH {_scattering_cte("faber-ziman")}, {_weights_cte("neutron")}, c AS (SELECT part.q, part.label, (value - base) * w AS v FROM part JOIN weight ON weight.q = part.q AND weight.label = part.label)
      SELECT q AS "Q", label, round(v, 6) AS value FROM c UNION ALL SELECT q, 'Total', round(1 + sum(v), 6) FROM c GROUP BY q""",
    "bessel_transform": f"""WITH {_rdf_cte(bin_edges(0.0, 8.0, 100, None))}, y AS (SELECT CAST(k AS DOUBLE) AS y FROM range(1, 21) t(k))
      SELECT y, label, round(sum(CASE WHEN place IN (0, 99) THEN 0.04 ELSE 0.08 END::DOUBLE * r * r * (value - 1) * sin(r * y) / (r * y)), 5) AS value FROM g JOIN grid USING (r) CROSS JOIN y WHERE left(label, 1) <= right(label, 1) GROUP BY y, label""",
    "debye_histogram": f"""WITH {_ATOMS} SELECT a.frame, CAST(floor(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 0.5) AS BIGINT) AS place, count(*) AS n
      FROM atoms a JOIN atoms b ON a.frame = b.frame AND a.atom < b.atom GROUP BY ALL""",
    "shared_parts_network": """WITH b AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS g FROM lineitem), l AS (SELECT x.c, y.c AS c2, count(*) AS shared FROM b x JOIN b y ON x.g = y.g AND x.c < y.c GROUP BY ALL)
      SELECT shared, count(*) AS links, CASE WHEN shared = 1 THEN 'corner' WHEN shared = 2 THEN 'edge' ELSE 'face' END AS sharing_type FROM l GROUP BY shared""",
    "event_runs": """WITH e AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
      r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id, event_type ORDER BY day) AS island FROM e)
      SELECT user_id, event_type, CAST(min(day) AS INTEGER) AS start_frame, CAST(max(day) AS INTEGER) AS end_frame, count(*) AS lifetime_samples FROM r GROUP BY user_id, event_type, island""",
}
