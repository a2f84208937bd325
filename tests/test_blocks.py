"""Operators whose pairs are worked on in blocks of a frame: equal to brute force whatever the blocks, and no plan has a row a pair."""

import numpy as np
import pyarrow as pa
import pytest

from tesserspark.operators import angles, carbon, clustering, diffraction, graph, rad, rdf
from tesserspark.plans import blocks, extra, neighbors, registry
from tesserspark.sources import xyz
from tests.conftest import SF
from tests.test_trajectory_queries import images, make

CELLS = {"cube": (12, 12, 12, 90, 90, 90), "skew": (12, 13, 12, 73, 82, 78)}


def crowd(spark, cell, n=400, seed=5):
    h = np.array(xyz.box_matrix(cell)).reshape(3, 3)
    x = (np.random.default_rng(seed).random((n, 3)) * 1.5 - 0.2) @ h  # some atoms lie outside of the cell
    x[3] = x[n - 1]  # coincident atoms are pairs
    return make(spark, [x, x[::-1] + 0.3], ["AABC"[k % 4] for k in range(n)], cell), x, h


def test_blocks_are_dealt_finely(spark, monkeypatch):
    """Where the pairs are many, a task has a block or so, not a share of all blocks."""
    monkeypatch.setattr(blocks, "BLOCK_ATOMS", 30)
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 100)
    t, _, _ = crowd(spark, CELLS["cube"])
    counted = blocks.by_blocks(t, 4.0, ["A", "B", "C"], lambda block, frame: None, "n long", half=True)
    assert counted.rdd.getNumPartitions() == 27  # by volume, two frames of 13.3


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[(30, "cube"), (4000, "cube"), (30, "skew")])
def crowded(request, spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ATOMS", request.param[0])
    return crowd(spark, CELLS[request.param[1]]), CELLS[request.param[1]]


def test_histogram_by_blocks(crowded):
    (t, x, h), cell = crowded
    edges = np.linspace(0.0, 4.0, 21)
    counted = rdf.pair_histogram(t, [("A", "A"), ("A", "B"), ("C", "C")], edges)
    assert "Join" not in plan(counted).split("FlatMapCoGroups")[0]  # pairs are not joined
    got = {(r.a, r.b, r.place): r.n for r in counted.collect()}
    want = {}
    for s in (x, x[::-1] + 0.3):
        d = np.sqrt(images(s, cell)[1])
        kind = np.array(["AABC"[k % 4] for k in range(len(s))])
        for a, b in (("A", "A"), ("A", "B"), ("A", "C"), ("B", "B"), ("B", "C"), ("C", "C")):
            v = d[np.ix_(kind == a, kind == b)]
            v = v[~np.eye(len(v), dtype=bool)] if a == b else v.ravel()
            for k, n in enumerate(np.histogram(v, edges)[0]):
                want[a, b, k] = want.get((a, b, k), 0) + n
    assert got == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("edges", [np.linspace(0, 4, 2), np.linspace(0, 4, 41), 0.25 * np.arange(17), np.linspace(0.3, 3.7, 18), np.linspace(3.9, 4, 3), np.array([0, 0.5, 0.6, 2.5, 4]), np.linspace(0, 4, 301), np.linspace(0, 4, 40_001)])
def test_counts_of_any_edges(edges):
    """Counts are those of the exact distances, on edges too, whatever precision and whatever number of bins."""
    rng, side, reach = np.random.default_rng(6), 12.0, np.nextafter(4.0, 5.0)
    f = np.concatenate([rng.random((2_000, 3)), rng.integers(0, 48, (400, 3)) / 48])  # a lattice has distances on edges
    kind = np.arange(len(f)) % 3
    head = dict(zip(blocks.cells.H, (side, 0, 0, 0, side, 0, 0, 0, side))) | {"n_atoms": len(f), "volume": side**3} | {f"{x}{k}": v for k in (1, 2, 3) for x, v in (("w", side), ("n", 1), ("b", 0))}
    block = blocks.Block(head, pa.table({"atom": np.arange(len(f)), "kind": kind} | {f"f{k + 1}": f[:, k] for k in range(3)}), reach, True)
    got = rdf._counted(block, 3, edges)
    g = f[None] - f[:, None]
    x = side * (g - np.floor(g + 0.5))
    d = np.sqrt(x[..., 0] * x[..., 0] + x[..., 1] * x[..., 1] + x[..., 2] * x[..., 2])
    a, b = np.triu_indices(len(f), 1)
    want = np.zeros((3, 3, len(edges) - 1), int)
    place = blocks.place_of(d[a, b], edges)
    np.add.at(want, (np.minimum(kind[a], kind[b])[place >= 0], np.maximum(kind[a], kind[b])[place >= 0], place[place >= 0]), 1)
    for k, m in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        assert np.array_equal(got[k, m] + (got[m, k] if k < m else 0), want[k, m])


def test_atoms_are_packed_before_they_are_shuffled(crowded):
    """Rows to the blocks are a batch's atoms of a block, so far fewer than atoms times blocks; all atoms come to blocks."""
    (t, x, h), cell = crowded
    dealt = blocks.by_blocks(t, 4.0, ["A", "B", "C"], lambda block, frame: {"n": [len(block.own())], "m": [len(block.atom)]}, "n long, m long")
    shown = plan(dealt)
    assert "MapInArrow" in shown and "Generate" not in shown.split("MapInArrow")[-1].split("Exchange")[0]
    assert sum(r.n for r in dealt.collect()) == 2 * len(x)


def test_only_pairs_asked_for_are_counted(crowded):
    """The rest of the species' pairs takes no time, and what is asked for is the same, in whatever order."""
    (t, x, h), cell = crowded
    edges, asked = np.linspace(0.5, 4.0, 15), [("B", "A"), ("A", "B"), ("C", "C")]
    every, few = ({(r.a, r.b, r.place): r.n for r in rdf.pair_histogram(t, asked, edges, only=only).collect()} for only in (False, True))
    assert few == {k: n for k, n in every.items() if k[:2] in {("A", "B"), ("C", "C")}} and len(few) < len(every)


@pytest.mark.parametrize("high", [4.0, 0.4, 11.9])
def test_many_atoms_and_kinds_are_counted_exactly(monkeypatch, high):
    """Numbers of two places are counted as often as they are full; distances near edges and of no length are told by themselves."""
    monkeypatch.setattr(rdf, "AT_ONCE", 1 << 9)
    monkeypatch.setattr(rdf, "TO_COUNT", 1 << 10)
    rng, side = np.random.default_rng(9), 24.0
    f = rng.random((3_000, 3))
    f[:300] = np.round(f[:300] * 48) / 48
    f[5] = f[6] = f[7]
    kind = np.sort(rng.integers(0, 5, len(f)))[::-1].copy()
    head = dict(zip(blocks.cells.H, (side, 0, 0, 0, side, 0, 0, 0, side))) | {"n_atoms": len(f), "volume": side**3} | {f"{x}{k}": v for k in (1, 2, 3) for x, v in (("w", side), ("n", 1), ("b", 0))}
    edges = np.linspace(0, high, 41)
    block = blocks.Block(head, pa.table({"atom": np.arange(len(f)), "kind": kind} | {f"f{k + 1}": f[:, k] for k in range(3)}), np.nextafter(high, 99), True)
    got = rdf._counted(block, 5, edges)
    g = f[None] - f[:, None]
    x = side * (g - np.floor(g + 0.5))
    d = np.sqrt(x[..., 0] * x[..., 0] + x[..., 1] * x[..., 1] + x[..., 2] * x[..., 2])
    a, b = np.triu_indices(len(f), 1)
    place = blocks.place_of(d[a, b], edges)
    inside = place >= 0
    want = np.bincount((np.minimum(kind[a], kind[b]) * 5 + np.maximum(kind[a], kind[b]))[inside] * 40 + place[inside], minlength=1000).reshape(5, 5, 40)
    both = got + got.transpose(1, 0, 2)
    both[np.arange(5), np.arange(5)] //= 2
    assert np.array_equal(np.triu(both.transpose(2, 0, 1)).transpose(1, 2, 0), want)


def test_forest_keeps_what_connects_and_winds():
    """Random lattices of edges: components and winding equal those of a plain walk, also by the kept edges alone."""
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (12, 9), (60, 70), (60, 200)):
        left, right = rng.integers(0, n, m), rng.integers(0, n, m)
        place = rng.integers(-1, 2, (n, 3))
        shifts = place[right] - place[left] + (rng.random((m, 3)) < 0.03)
        forest = graph.Forest(n)
        for at in range(0, m, 7):
            forest.add(left[at : at + 7], right[at : at + 7], shifts[at : at + 7])
        parts = [np.concatenate(x) for x in zip(*forest.kept)] if forest.kept else [left, right, shifts]
        assert len(parts[0]) <= n - 1 + 3 * n
        label, offset, winds = np.full(n, -1), np.zeros((n, 3), int), {}
        for s in range(n):
            stack = [s] if label[s] < 0 else []
            if stack:
                label[s], winds[s] = s, np.zeros(3, bool)
            while stack:
                v = stack.pop()
                for a, b, t in [*zip(left, right, shifts), *zip(right, left, -shifts)]:
                    if a == v and label[b] < 0:
                        label[b], offset[b] = s, offset[v] + t
                        stack.append(b)
        for a, b, t in zip(left, right, shifts):
            winds[label[a]] |= offset[a] + t != offset[b]
        want = [winds[x].tolist() for x in label]
        for edges in ((left, right, shifts), parts):
            got, wraps = graph.labelled_components(np.arange(n), *edges)
            assert got.tolist() == label.tolist() and wraps.tolist() == want
        assert forest.root.tolist() == label.tolist() and forest.wound[forest.root].tolist() == want


def test_cluster_links_by_blocks(crowded):
    (t, x, h), cell = crowded
    asked = [clustering.CutoffClusterDefinition("A", "A", 1.3), clustering.CutoffClusterDefinition("A", "B", 1.4, 0.3)]
    links = clustering._bonds(t, asked, ["A", "B"]).toPandas()
    kind = np.array(["AABC"[k % 4] for k in range(len(x))])
    for frame, s in enumerate((x, x[::-1] + 0.3)):
        f = s @ np.linalg.inv(h)
        turn = -np.floor(f[None] - f[:, None] + 0.5).astype(int)
        d2 = (((f[None] - f[:, None] + turn) @ h) ** 2).sum(-1)
        for d in asked:
            i, j = np.nonzero((kind[:, None] == d.first) & (kind[None] == d.second) & (d2 >= d.r_min**2) & (d2 < d.r_max**2) & ~np.eye(len(x), dtype=bool))
            got = links[(links.frame == frame) & (links.label == d.name)]
            both = [graph.labelled_components(np.arange(len(x)), *e) for e in ((i, j, turn[i, j]), (got.left.to_numpy(), got.right.to_numpy(), got[["tx", "ty", "tz"]].to_numpy()))]
            assert both[0][0].tolist() == both[1][0].tolist() and both[0][1].tolist() == both[1][1].tolist()


def test_shared_links_by_blocks(crowded):
    (t, x, h), cell = crowded
    told = clustering.shared_links(t, "A", "B", 1.9, 2).toPandas()
    kind = np.array(["AABC"[k % 4] for k in range(len(x))])
    a, b = np.flatnonzero(kind == "A"), np.flatnonzero(kind == "B")
    for frame, s in enumerate((x, x[::-1] + 0.3)):
        f = s @ np.linalg.inv(h)
        step = f[b][None] - f[a][:, None]
        turn = -np.floor(step + 0.5).astype(int)
        near = (((step + turn) @ h) ** 2).sum(-1) < 1.9**2
        shared = np.triu(near.astype(int) @ near.T.astype(int), 1)
        got = told[told.frame == frame]
        rows = got[got.label == "shared"].groupby("left")["right"].sum()
        values, n = np.unique(shared[shared > 0], return_counts=True)
        assert rows.to_dict() == dict(zip(values, n))
        wanted = {"corner": shared == 1, "edge": shared == 2, "face": shared > 2, "strong": shared > 1}
        for label, links in wanted.items():
            i, j, g = np.nonzero(links[:, :, None] & near[:, None] & near[None])
            shift = turn[i, g] - turn[j, g] if label == "strong" else np.zeros((len(i), 3), int)
            kept = got[got.label == label]
            both = [graph.labelled_components(a, *e) for e in ((a[i], a[j], shift), (kept.left.to_numpy(), kept.right.to_numpy(), kept[["tx", "ty", "tz"]].to_numpy()))]
            assert both[0][0].tolist() == both[1][0].tolist() and both[0][1].tolist() == both[1][1].tolist(), label


def test_debye_pairs_are_counted_in_groups(spark):
    x = np.random.default_rng(3).random((200, 3)) * 5
    atoms = spark.createDataFrame([(7, k, *map(float, v)) for k, v in enumerate(x)], "frame long, atom long, x double, y double, z double")
    counted = diffraction.debye_histogram(atoms, 0.3, "frame", block=60)
    assert plan(counted).count("SortMergeJoin") + plan(counted).count("BroadcastHashJoin") <= 2  # only with the number of blocks, on both sides
    i, j = np.triu_indices(200, 1)
    places, n = np.unique(np.floor(np.linalg.norm(x[i] - x[j], axis=1) / 0.3), return_counts=True)
    assert {(r.frame, r.place): r.n for r in counted.collect()} == {(7, int(p)): c for p, c in zip(places, n)}


def test_rings_of_a_dense_graph(spark):
    """Beyond the states of a search from every edge; all edges but one chain's are in triangles."""
    near = np.triu(np.random.default_rng(2).random((250, 250)) < 0.3, 1)
    links = [(int(a), int(b)) for a, b in np.argwhere(near)] + [(0, 300), (300, 301), (301, 302), (302, 0)]
    edges = spark.createDataFrame([(4, a, b) for u, v in links for a, b in ((u, v), (v, u))], "frame long, src long, dst long")
    rings = [r.ring for r in carbon.frame_rings(edges).collect()]
    full = (near | near.T).astype(int)
    assert len(set(map(tuple, rings))) == len(rings) == np.trace(full @ full @ full) // 6 + 1
    assert [r for r in rings if len(r) > 3] == [[0, 300, 301, 302]]


@pytest.mark.parametrize("most", [8, 5])
def test_ring_counts_by_blocks(crowded, most):
    (t, _, _), _ = crowded
    counted = carbon.trajectory_ring_counts(t, 1.3, most)
    shape = plan(counted)
    assert "FlatMapGroupsInArrow" in shape and "explode(" not in shape.split("FlatMapGroupsInArrow")[0]
    links = neighbors.neighbor_pairs(t, 1.3).select("frame", "i", "j").withColumnsRenamed({"i": "src", "j": "dst"})
    want = sorted(tuple(r) for r in carbon.ring_counts(carbon.frame_rings(links, most)).collect())
    assert sorted(tuple(r) for r in counted.collect()) == want and any(size > 3 for _, size, _ in want)


def test_ring_counts_need_no_links_and_no_triangles_as_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "neighbor_pairs", None)
    monkeypatch.setattr(registry, "neighbor_pairs", None)  # links of the registered query were pairs in the shuffle
    monkeypatch.setattr(carbon, "neighbor_pairs", None, raising=False)
    monkeypatch.setattr(carbon, "frame_rings", None)
    assert registry.QUERIES["ring_counts"](spark, SF).where("ring_size = 3").agg({"n": "sum"}).first()[0] == 2038


def test_rings_by_blocks(crowded):
    (t, _, _), _ = crowded
    links = neighbors.neighbor_pairs(t, 1.3).select("frame", "i", "j").withColumnsRenamed({"i": "src", "j": "dst"})
    want = sorted((r.frame, r.ring) for r in carbon.frame_rings(links).collect())
    assert sorted((r.frame, r.ring) for r in carbon.trajectory_rings(t, 1.3).collect()) == want and any(len(r) > 5 for _, r in want)


def test_rings_come_from_blocks_without_links(spark, monkeypatch):
    for module in (neighbors, registry, carbon):
        monkeypatch.setattr(module, "neighbor_pairs", None, raising=False)
    monkeypatch.setattr(carbon, "frame_rings", None)
    assert extra.QUERIES["rings"](spark, SF).distinct().count() == 2101


def test_ring_counts_of_rings_around_the_cell(spark):
    """Three atoms in a row that close around the cell: blocks would miss them."""
    x = np.array([[0.5, 1, 1], [2.5, 1, 1], [4.5, 1, 1]])
    t = make(spark, [x], ["A"] * 3, (6, 6, 6, 90, 90, 90))
    assert [tuple(r) for r in carbon.trajectory_ring_counts(t, 2.5, 8).collect()] == [(0, 3, 1)]


def test_angles_by_blocks(crowded):
    (t, x, h), cell = crowded
    asked = angles.normalize_definitions(t, [("A", "B", "A", 1.9), ("A", "B", "A", 1.9, 1.5, "unequal"), ("A", "B", "C", 1.9, 1.7)])
    edges = np.linspace(0.0, 180.0, 37)
    counted = angles.angle_counts(t, asked, edges)
    assert "Join" not in plan(counted).split("FlatMapCoGroups")[0]  # bonds do not meet in a join
    rows = [r for r in angles.angles(t, asked).select("label", "angle").collect() if r.angle is not None]
    want = {(d.name, k): int(n) for d in asked for k, n in enumerate(np.histogram([r.angle for r in rows if r.label == d.name], edges)[0]) if n}
    assert {(r.label, r.p): r.n for r in counted.collect()} == want


def test_occupancy_neither_joins_nor_sorts_pairs(spark, monkeypatch):
    """A row for every pair of eligible atoms, in order; shells come from blocks, and only those without an end from the pair join."""
    real = rad.neighbor_pairs

    def only_rest(*args, only=None, **more):
        assert only is not None
        return real(*args, only=only, **more)

    monkeypatch.setattr(rad, "neighbor_pairs", only_rest)
    monkeypatch.setattr(blocks, "BLOCK_ATOMS", 30)
    t, _, _ = crowd(spark, CELLS["skew"], n=120)
    e = rad.compute_rad_environments(t, ["A", "B"], neighbor_species=["C", "A"])
    got = e.occupancy(assume_stable_atom_identity=True)
    assert not [x for x in plan(got).splitlines() if "rangepartitioning" in x and "neighbor_index" in x]
    kind = {a: "AABC"[a % 4] for a in range(120)}
    seen = {}
    for r in e.contacts.collect():
        seen[r.center_index, r.neighbor_index] = seen.get((r.center_index, r.neighbor_index), 0) + 1
    want = [(a, kind[a], b, kind[b], seen.get((a, b), 0), seen.get((a, b), 0) / 2) for a in range(120) for b in range(120) if a != b and kind[a] in "AB" and kind[b] in "CA"]
    assert [tuple(r) for r in got.collect()] == want and seen
    assert e.occupancy("B", "C", bond_mode="mutual", assume_stable_atom_identity=True).count() == 900


def test_occupancy_in_teams(spark, monkeypatch):
    monkeypatch.setattr(rad, "TEAM_BITS", 4)  # the last of six teams has ten centers
    t, _, _ = crowd(spark, CELLS["skew"], n=120)
    e = rad.compute_rad_environments(t, ["A", "B"], neighbor_species=["C", "A"])
    got = [tuple(r) for r in e.occupancy(assume_stable_atom_identity=True, ordered=False).collect()]
    want = [tuple(r) for r in e.occupancy(assume_stable_atom_identity=True).collect()]
    assert sorted(got) == want and got != want and any(r[4] for r in want)


def test_occupancy_takes_little_room(spark, tmp_path):
    """A row for every pair, most of them alike: as files they must not grow by bytes a row."""
    registry.QUERIES["occupancy"](spark, SF).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows == 123_691 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1.5 * rows
