import math

import numpy as np
import pytest

from tesserspark.operators import angles, carbon, clustering, coordination, rad, rdf, scattering
from tesserspark.operators.cache import AnalysisCache, CacheCorruptionError, CacheMissError
from tesserspark.operators.tables import Table
from tesserspark.functions.transforms import quadrature_weights, spherical_bessel_transform
from tesserspark.plans.neighbors import neighbor_pairs
from tesserspark.sources import xyz
from tesserspark.sources.trajectory import Trajectory


def make(spark, positions, species, cell=(12.0, 12.0, 12.0, 90.0, 90.0, 90.0)):
    """positions: frames x atoms x 3."""
    rows = [(f, a, species[a], *map(float, p)) for f, frame in enumerate(positions) for a, p in enumerate(frame)]
    atoms = spark.createDataFrame(rows, "frame long, atom long, species string, x double, y double, z double")
    frames = spark.createDataFrame([(f, *map(float, cell)) for f in range(len(positions))], "frame long, a double, b double, c double, alpha double, beta double, gamma double")
    return Trajectory.from_dataframe(atoms, frames)


def images(x, cell):
    """Nearest-image displacements of all pairs, over 27 images."""
    h = np.array(xyz.box_matrix(cell)).reshape(3, 3)
    d = x[None] - x[:, None]
    best = None
    for s in np.ndindex(3, 3, 3):
        e = d + (np.array(s) - 1) @ h
        n = (e**2).sum(-1)
        best = (e, n) if best is None else (np.where((n < best[1])[..., None], e, best[0]), np.minimum(n, best[1]))
    return best


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(1423)
    out = {}
    for name, cell in (("cube", (12, 12, 12, 90, 90, 90)), ("skew", (12, 12, 12, 73, 82, 78))):
        h = np.array(xyz.box_matrix(cell)).reshape(3, 3)
        x = rng.random((45, 3)) @ h
        x[2] = x[40]  # coincident atoms are pairs
        out[name] = (make(spark, [x, x + 0.4], ["A"] * 30 + ["B"] * 15, cell), x, cell)
    return out


@pytest.mark.parametrize("name", ["cube", "skew"])
def test_histogram_equals_all_pairs(dense, name):
    t, x, cell = dense[name]
    r = rdf.compute_rdfs(t, [("A", "A"), ("A", "B"), ("B", "A")], bins=8, r_range=(0.0, 4.0)).toPandas()
    _, d2 = images(x, cell)
    a, b = np.arange(30), np.arange(30, 45)
    edges = np.linspace(0, 4, 9)
    h = np.array(xyz.box_matrix(cell)).reshape(3, 3)
    shell = 4 * np.pi / 3 * np.diff(edges**3)
    for label, i, j, own in (("A-A", a, a, True), ("A-B", a, b, False), ("B-A", b, a, False)):
        d = np.sqrt(d2[np.ix_(i, j)])
        d = d[~np.eye(len(i), dtype=bool)] if own else d.ravel()
        want = 2 * np.histogram(d, edges)[0] / (2 * len(i) * (len(j) - own) / abs(np.linalg.det(h)) * shell)
        assert np.allclose(r[label], want, rtol=1e-10, atol=1e-12), label


def test_rdf_validation(dense):
    t, *_ = dense["cube"]
    with pytest.raises(ValueError, match="safe periodic radius"):
        rdf.compute_rdfs(t, r_range=(0, 7.0))
    with pytest.raises(ValueError, match="unique"):
        rdf.compute_rdfs(t, [("A", "B"), ("A", "B")])
    with pytest.raises(ValueError, match="either bins or step"):
        rdf.compute_rdfs(t, bins=3, step=0.1)


def test_spectral_coefficients_equal_direct_sums(dense):
    t, x, cell = dense["skew"]
    s = rdf.compute_spectral_rdfs(t, [("A", "B")], modes=30, step=0.5, r_range=(1.0, 4.0))
    _, d2 = images(x, cell)
    r = np.sqrt(d2[:30, 30:].ravel())
    r = r[(r >= 1) & (r < 4)]
    w = 1 / (4 * np.pi * r**2)
    scale = 30 * 15 / abs(np.linalg.det(np.array(xyz.box_matrix(cell)).reshape(3, 3)))
    want = [(np.sqrt((1 if m == 0 else 2) / 3) * w * np.cos(m * np.pi * (r - 1) / 3)).sum() / scale for m in range(31)]
    assert np.allclose(s.attrs["spectral"]["coefficients"]["A-B"], want, rtol=1e-9, atol=1e-12)
    auto = rdf.compute_spectral_rdfs(t, [("A", "B")], modes="auto", step=0.5, r_range=(1.0, 4.0), auto_pilot_frames=1, auto_min_modes=3, auto_max_modes=12)
    k = auto.attrs["spectral"]["selected_modes"]["A-B"]
    fixed = rdf.compute_spectral_rdfs(t, [("A", "B")], modes=k, step=0.5, r_range=(1.0, 4.0))
    assert np.allclose(auto.attrs["spectral"]["coefficients"]["A-B"], fixed.attrs["spectral"]["coefficients"]["A-B"], atol=2e-13)


def test_coordination_keeps_centers_without_neighbors(spark):
    t = make(spark, [[(0, 0, 0), (5, 5, 5), (1, 0, 0), (0, 1, 0)]], ["A", "A", "B", "B"])
    c = coordination.compute_coordination(t, [("A", "B", 2.0)])
    assert c.toPandas()["A-B"].tolist() == [0.5, 0.0, 0.5]
    one = coordination.compute_coordination(t, [("A", "B", 2.0)], max_coordination=1)
    assert one.attrs["overflow_probability"] == {"A-B": 0.5}
    assert coordination.summarize_coordination(c).first()["mean"] == 1.0


def test_angles(spark):
    t = make(spark, [[(6, 6, 6), (7, 6, 6), (5, 6, 6), (6, 7, 6)]], ["O", "H", "H", "H"])
    a = angles.compute_bond_angles(t, [("H", "O", "H", 1.5)], bins=4)
    assert a.attrs["sample_counts"] == {"H-O-H": 3}
    assert np.allclose(a.toPandas()["H-O-H"], [0, 0, 2 / 3 / 45, 1 / 3 / 45])  # the straight angle is in the last bin


def test_rad_equals_the_sequential_walk(spark):
    rng = np.random.default_rng(4)
    x = rng.random((1, 60, 3)) * 12
    t = make(spark, x, ["A"] * 30 + ["B"] * 30)
    d, n2 = images(x[0], (12, 12, 12, 90, 90, 90))
    every = [rad.shells(t, nearest=n).toPandas().groupby("i").j.apply(set) for n in (8, 2, 32)]
    found = every[0]
    assert all((f == found).all() for f in every[1:])
    for c in range(60):
        shell = []
        for j in sorted((j for j in range(60) if j != c), key=lambda j: (n2[c, j], j)):
            if any(1 / n2[c, j] <= d[c, j] @ d[c, k] / math.sqrt(n2[c, j] * n2[c, k]) / n2[c, k] for k in shell):
                break
            shell.append(j)
        assert found[c] == set(shell)


def test_rad_of_atoms_far_from_all_others(spark):
    t = make(spark, [[(1, 1, 1), (1.5, 1, 1), (2.5, 1, 1), (11, 11, 11)], [(1, 1, 1), (1, 1, 1), (9, 9, 9), (4, 1, 1)]], ["A"] * 4)
    got = rad.shells(t, nearest=1).toPandas().groupby(["frame", "i"]).j.apply(set)
    assert got[0, 0] == {1} and 0 not in got.get((1, 1), set()) and len(got) == 8  # coincident atoms are no neighbors


def test_many_cells_an_axis(spark):
    """Cells are as small as the cutoff asks for in a box of any size."""
    side, n = 5_000.0, 400
    x = np.random.default_rng(0).random((n, 3)) * side
    x[1::2] = x[::2] + [0.5, 0, 0]
    t = make(spark, [x], ["A"] * n, (side, side, side, 90, 90, 90))
    assert neighbor_pairs(t, 1.0, half=True).count() == n // 2


def test_environments_and_lifetimes(spark):
    near, far = [(1, 1, 1), (2, 1, 1), (7, 7, 7)], [(1, 1, 1), (6, 1, 1), (1.5, 1, 1)]
    t = make(spark, [near, near, far, near], ["A", "B", "C"])
    e = rad.compute_rad_environments(t, "A", neighbor_species="B", frames=[0, 1, 3])
    runs = e.lifetimes(assume_stable_atom_identity=True).toPandas()
    assert runs.lifetime_samples.tolist() == [3] and runs.logical_frame_span.tolist() == [3]  # selection order decides, not frame numbers
    with pytest.raises(ValueError):
        e.occupancy()
    assert e.occupancy(assume_stable_atom_identity=True).first()["occupancy"] == 1.0
    with pytest.raises(ValueError, match="directed"):
        rad.compute_rad_environments(t, "A", bond_mode="mutual").contacts_between()


def test_clusters_wrap_and_agree(spark):
    chain = [(k * 2.0, 0, 0) for k in range(6)]
    t = make(spark, [[*chain, *[(k * 2.0 + 1, 0, 0) for k in range(6)]]], ["A"] * 6 + ["B"] * 6)
    s = clustering.compute_by_shared_neighbors(t, "A", "B", 1.2)
    row = s.frame_summary.first()
    assert row["wrap_x"] and not row["wrap_y"] and row["percolation_strength"] == 1.0 and row["corner_links"] == 6
    by = clustering.compute_by_distance(t, ("A", "B"), 1.2, count_species="A").cluster_distribution.toPandas()
    assert np.allclose(by.probability, s.cluster_distribution.toPandas().connected)
    assert clustering.compute_by_distance(t, "A", 2.5).cluster_distribution.toPandas().probability.tolist()[-1] == 1.0


def test_partitions_do_not_matter(spark, dense):
    t, *_ = dense["skew"]
    want = neighbor_pairs(t, 3.0).count()
    for n in (1, 7):
        assert neighbor_pairs(Trajectory(t.frames, t.atoms.repartition(n), None), 3.0).count() == want


def test_tasks_of_the_join_grow_with_its_pairs(spark, monkeypatch):
    from tesserspark.plans import neighbors

    t = make(spark, [np.random.default_rng(3).random((200, 3)) * 12] * 2, ["A"] * 200)
    least = neighbors.join_partitions(t, 2.0)
    want = neighbor_pairs(t, 2.0).count()
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 500)
    assert neighbors.join_partitions(t, 2.0) == math.ceil(2 * 200 * 27 * 8 * 200 / 12**3 / 500) > least and neighbor_pairs(t, 2.0).count() == want
    assert neighbors.join_partitions(t, 50.0) == 2 * 200 * 200 / 500  # no more than all atoms of a frame are around one


def test_transform_and_scattering(spark):
    x = np.linspace(0, 10, 2001)
    assert np.allclose(spherical_bessel_transform(x, np.exp(-x * x), np.linspace(0, 5, 11)), np.sqrt(np.pi) / 4 * np.exp(-np.linspace(0, 5, 11) ** 2 / 4), atol=2e-10)
    assert abs(quadrature_weights(np.linspace(0, 1, 7), "simpson") @ np.linspace(0, 1, 7) ** 3 - 0.25) < 1e-12
    r = np.arange(1, 41) * 0.2
    rows = [(float(v), p, 1.0) for v in r for p in ("Be-Be", "Be-F", "F-F")]
    ideal = Table(spark.createDataFrame(rows, "r double, label string, value double"), "r", ("Be-Be", "Be-F", "F-F"), {"system": {"atom_counts": {"Be": 10, "F": 20}, "number_density": 0.1}})
    for convention in scattering.CONVENTIONS:
        out = scattering.compute_scattering(ideal, convention=convention, q_range=(0.5, 6))
        assert np.allclose(out.neutron.structure_factor.toPandas()["Total"], 1) and np.allclose(out.xray.structure_factor.toPandas()["Total"], 1)
    weights = scattering.compute_scattering_weights(scattering.ScatteringComposition.from_formula("BeF2"), [("Be", "Be"), ("Be", "F"), ("F", "F")], [0.0, 1.0, 2.0], probe="xray", spark=spark).toPandas()
    assert np.allclose(weights[["Be-Be", "Be-F", "F-F"]].sum(axis=1), 1)
    with pytest.raises(ValueError, match="no neutron"):
        scattering.ScatteringComposition.from_formula("Xx2").neutron_scattering_lengths()


def test_xyz_roundtrip_and_selection(spark, tmp_path):
    path = tmp_path / "t.xyz"
    frames = []
    for k in range(5):
        order = ["A", "B", "A"] if k != 1 else ["B", "A", "A"]
        frames.append(f'3\nLattice="10 0 0 0 10 0 0 0 10" Origin="-1 0 0" Properties=pos:R:3:species:S:1:id:I:1\n' + "".join(f"{k + i}.0 0 0 {s} {i}\n" for i, s in enumerate(order)))
    path.write_text("".join(frames))
    t = xyz.load_trajectory(path, frames=[3, 1], shift_by_origin=True, normalize_species_order=False, spark=spark)
    assert t.frame_index == [(0, 3), (1, 1)] and t.n_atoms == 3
    assert [r["x"] for r in t.atoms.where("frame = 0").orderBy("atom").collect()] == [4.0, 5.0, 6.0]
    assert xyz.xyz_has_variable_species_order(path, spark=spark)
    out = xyz.normalize_xyz_species_order(path, tmp_path / "n.parquet", spark=spark)
    back = xyz.load_trajectory(out, format="parquet", spark=spark)
    assert [r["species"] for r in back.atoms.where("frame = 1").orderBy("atom").collect()] == ["A", "A", "B"]
    path.write_text("".join(frames)[:-12])
    with pytest.raises(ValueError, match="incomplete"):
        xyz.load_trajectory(path, spark=spark)


def honeycomb(n):
    """A periodic sheet of n x n cells: positions, cell, adjacency."""
    a, sites = 1.42 * math.sqrt(3), {}
    for i in range(n):
        for j in range(n):
            for b in (0, 1):
                sites[i, j, b] = len(sites)
    x = np.array([((i + j / 2) * a + a / 2, (j * math.sqrt(3) / 2) * a + (0.71 if b == 0 else -0.71) + a, 5.0) for i, j, b in sites])
    cell = np.array([[n * a, 0, 0], [n * a / 2, n * a * math.sqrt(3) / 2, 0], [0, 0, 20.0]])
    near = [[] for _ in sites]
    for (i, j, b), k in sites.items():
        if b == 0:
            for di, dj in ((0, 0), (0, 1), (-1, 1)):
                m = sites[(i + di) % n, (j + dj) % n, 1]
                near[k].append(m)
                near[m].append(k)
    return x, cell, near


def test_periodic_sheet_is_one_domain_without_a_size():
    x, cell, near = honeycomb(5)
    r = carbon.analyze_graphenic_structure(x, cell, near)
    assert r["ring_counts"] == {6: 25}
    first = r["crystallites"][0]
    assert first["ring_count"] == 25 and first["wrap_a"] and first["wrap_b"] and not first["wrap_c"] and first["sqrt_area_size_A"] is None and first["normal_nematic_order"] > 0.999
    assert abs(first["area_A2"] - 25 * 1.42**2 * 1.5 * math.sqrt(3)) < 1e-6
    with pytest.raises(carbon.GraphenicAnalysisError):
        carbon.shortest_path_ring_cycles(near, max_search_states=10)


def test_a_chain_of_rings_is_cut_at_its_inner_rings():
    x, cell, near = honeycomb(8)
    rings = [r for r in carbon.shortest_path_ring_cycles(near)]
    centre = rings[20]
    patch = [r for r in rings if len(set(r) & set(centre)) >= 2]
    r = carbon.analyze_graphenic_structure(x, cell, near, ring_cycles=patch)
    one = r["crystallites"][0]
    assert len(patch) == 7 and one["ring_count"] == 7 and one["atom_count"] == 24 and not one["periodic"]
    assert abs(one["area_A2"] - 7 * 1.42**2 * 1.5 * math.sqrt(3)) < 1e-6 and one["thickness_A"] < 1e-9
    # without its centre the ring of six has only rings that join two others: none is left
    assert carbon.analyze_graphenic_structure(x, cell, near, ring_cycles=[p for p in patch if p != centre])["crystallites"] == []


def test_minimum_image_with_partial_periodicity():
    cell = np.array([[10.0, 0, 0], [9.0, 2.0, 0], [0, 0, 10.0]])
    rng = np.random.default_rng(0)
    d = rng.uniform(-30, 30, (200, 3))
    got = carbon.minimum_image_displacements(d, cell, pbc=(True, True, False))
    shifts = np.array([(i, j, 0) for i in range(-25, 26) for j in range(-25, 26)]) @ cell
    want = ((d[:, None] + shifts) ** 2).sum(-1).min(1)
    assert np.allclose((got**2).sum(1), want) and np.allclose(got[:, 2], d[:, 2])


def test_cache(spark, tmp_path, dense):
    t, *_ = dense["cube"]
    calls = []

    def analysis(trajectory, cutoff, ncore=1):
        calls.append(cutoff)
        return coordination.compute_coordination(trajectory, [("A", "B", cutoff)])

    cache = AnalysisCache(tmp_path)
    with pytest.raises(CacheMissError):
        cache.get_or_compute(analysis, t, 2.0, cache_mode="read_only", cache_source_id="x")
    a = cache.get_or_compute(analysis, t, 2.0, cache_source_id="x")
    b = cache.get_or_compute(analysis, t, 2.0, ncore=5, cache_source_id="x")
    assert calls == [2.0] and a.toPandas().equals(b.toPandas()) and a.attrs == b.attrs
    part = next(p for p in tmp_path.rglob("*.parquet") if p.is_file())
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(CacheCorruptionError):
        cache.get_or_compute(analysis, t, 2.0, cache_source_id="x")


def test_streaming_histogram(spark, tmp_path, dense):
    from tesserspark.streaming import rdf as stream

    t, *_ = dense["cube"]
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    edges, pairs = np.linspace(0, 4, 9), [("A", "B")]
    rows = lambda df: sorted(map(tuple, df.select("a", "b", "place", "n").collect()))

    def advance():
        q = stream.running_histogram(stream.read_frames(spark, source, 1), 12.0, t.n_atoms, pairs, edges, folder)
        q.processAllAvailable()
        q.stop()

    # the first frame comes in two batches, the second in one, and the query is started again in between
    t.atoms.where("frame = 0 and atom < 20").coalesce(1).write.mode("append").parquet(source)
    advance()
    assert rows(stream.counted(spark, folder)) == []
    t.atoms.where("frame = 0 and atom >= 15").coalesce(1).write.mode("append").parquet(source)  # some atoms come twice
    t.atoms.where("frame = 1").coalesce(1).write.mode("append").parquet(source)
    advance()
    want = rows(rdf.pair_histogram(t, pairs, edges))
    assert rows(stream.counted(spark, folder)) == want
    # a batch that runs again counts once
    other = str(tmp_path / "other")
    for number, part in ((0, "frame = 0 and atom < 20"), (1, "frame = 0 and atom >= 20 or frame = 1 and atom < 5"), (1, "frame = 0 and atom >= 20 or frame = 1 and atom < 5"), (2, "frame = 1 and atom >= 5"), (2, "frame = 1 and atom >= 5")):
        stream.add_batch(t.atoms.where(part), number, 12.0, t.n_atoms, pairs, edges, other)
    assert rows(stream.counted(spark, other)) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 80
    assert set(e.oracle_sql()) <= set(e.queries())
