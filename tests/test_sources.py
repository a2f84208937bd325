"""Files, selections and cells."""

import sys
import types

import numpy as np
import pytest

from tesserspark.sources import universe, xyz
from tesserspark.sources.trajectory import Trajectory


def xyz_text(frames, order=None, lattice='Lattice="10 0 0 0 10 0 0 0 10"', comment=""):
    """frames x atoms x 3 positions; order: species of each frame."""
    out = []
    for k, atoms in enumerate(frames):
        names = order[k] if order else ["A"] * 2 + ["B"] * (len(atoms) - 2)
        out.append(f"{len(atoms)}\n{lattice} {comment}\n" + "".join(f"{s} {p[0]:.6f} {p[1]:.6f} {p[2]:.6f}\n" for s, p in zip(names, atoms)))
    return "".join(out)


@pytest.mark.parametrize("range_bytes", [1 << 20, 97, 10])
def test_frames_are_found_in_any_ranges(spark, tmp_path, range_bytes):
    rng = np.random.default_rng(range_bytes)
    path = tmp_path / "t.xyz"
    frames = [rng.random((n, 3)) * 9 for n in (3, 5, 4, 3, 60)]
    text = xyz_text(frames[:2]) + xyz_text(frames[2:4], lattice="", comment="").replace("\n \n", "\n7\n") + xyz_text(frames[4:])  # comments that look like heads
    path.write_text(text)
    found = xyz.frame_offsets(str(path), spark if range_bytes != 10 else None, range_bytes)
    assert [f.atoms for f in found] == [3, 5, 4, 3, 60] and found[2].comment == "7" and sum(f.size for f in found) == len(text)
    got = xyz.read_atoms(spark, str(path), found, partition_bytes=200).toPandas().sort_values(["frame", "atom"])
    assert np.allclose(got[["x", "y", "z"]], np.concatenate(frames), atol=1e-6)
    path.write_text(text[:-3].rsplit("\n", 1)[0])
    with pytest.raises(ValueError, match="incomplete"):
        xyz.frame_offsets(str(path), None, range_bytes)


def test_data_source_and_odd_lines(spark, tmp_path):
    path = tmp_path / "t.xyz"
    path.write_text('2\nProperties=pos:R:3:species:S:1\n1 2 3 A extra\n4 5 6 B\n2\n\nA 1 2 3\nB 4 5 6')
    spark.dataSource.register(xyz.XYZDataSource)
    rows = spark.read.format("xyz").option("frames", "1,0").load(str(path)).orderBy("frame", "atom").collect()
    assert [(r.frame, r.species, r.x) for r in rows] == [(0, "A", 1.0), (0, "B", 4.0), (1, "A", 1.0), (1, "B", 4.0)]


def test_topology_names_the_atoms_of_the_coordinates(spark, tmp_path):
    (tmp_path / "top.xyz").write_text(xyz_text(np.zeros((1, 3, 3)), [["O", "H", "Li"]]))
    (tmp_path / "c.xyz").write_text(xyz_text(np.arange(18.0).reshape(2, 3, 3), [["X"] * 3] * 2))
    t = xyz.load_trajectory(tmp_path / "top.xyz", tmp_path / "c.xyz", box=(20, 21, 22), spark=spark)
    assert t.species == ("H", "Li", "O") and [r.x for r in t.atoms.where("species = 'Li'").orderBy("frame").collect()] == [6.0, 15.0]
    assert round(t.frames.first()["volume"]) == 20 * 21 * 22  # the box stands above the file's cells
    (tmp_path / "short.xyz").write_text(xyz_text(np.zeros((1, 2, 3)), [["O", "H"]]))
    with pytest.raises(ValueError, match="atoms"):
        xyz.load_trajectory(tmp_path / "short.xyz", tmp_path / "c.xyz", spark=spark)


def test_orders_boxes_and_columns(spark, tmp_path):
    path = tmp_path / "t.xyz"
    path.write_text(xyz_text(np.arange(18.0).reshape(2, 3, 3), [["B", "A", "B"], ["A", "B", "B"]]))
    orders = lambda t: [[r.species for r in t.atoms.where(f"frame = {k}").orderBy("atom").collect()] for k in (0, 1)]
    assert orders(xyz.load_trajectory(path, spark=spark)) == [["B", "B", "A"]] * 2
    assert orders(xyz.load_trajectory(path, normalize_species_order=False, spark=spark)) == [["B", "A", "B"], ["A", "B", "B"]]
    assert xyz.xyz_has_variable_species_order(path, spark=spark) and not xyz.xyz_needs_column_normalization(path, spark)
    out = xyz.normalize_xyz_species_order(path, spark=spark)
    assert xyz.normalize_xyz_species_order(path, spark=spark) == out and not list(tmp_path.glob("*.parquet.*"))
    back = xyz.load_trajectory(out, format="parquet", box=12.0, spark=spark)
    assert orders(back) == [["B", "B", "A"]] * 2 and round(back.frames.first()["volume"]) == 12**3
    back.atoms.withColumnRenamed("species", "elements").write.parquet(str(tmp_path / "e/atoms"))
    back.frames.select("frame", "source_frame", *xyz.H).write.parquet(str(tmp_path / "e/frames"))
    assert xyz.load_trajectory(tmp_path / "e", format="parquet", atom_attribute="elements", spark=spark).species == ("A", "B")
    with pytest.raises(ValueError, match="no column"):
        xyz.load_trajectory(tmp_path / "e", format="parquet", atom_attribute="charges", spark=spark)


@pytest.mark.parametrize(
    "text, want",
    [
        ("name A and index 0:5", [0, 1]), ("name A B", [0, 1, 2, 3]), ("not name A", [2, 3, 4]), ("index 0 3:4 or name B", [0, 2, 3, 4]), ("(name A or name Cl) and not index 1", [0, 4]),
        ("name C*", [4]), ("bynum 1:2", [0, 1]), ("prop x >= 2 and prop abs y < 1.5", [2]), ("all", [0, 1, 2, 3, 4]), ("none", []), ("element A and index 1 or name B", [1, 2, 3]),
    ],
)
def test_selections(spark, text, want):
    rows = [(0, k, s, float(k), float(-k if k > 2 else 1), 0.0) for k, s in enumerate(["A", "A", "B", "B", "Cl"])]
    t = Trajectory.from_dataframe(spark.createDataFrame(rows, "frame long, atom long, species string, x double, y double, z double"), spark.createDataFrame([(0, 9.0, 9.0, 9.0)], "frame long, a double, b double, c double"))
    assert sorted(r.atom for r in t.select_atoms(text).atoms.collect()) == want
    assert sorted(r.atom for r in t.select_atoms("name A", "index 4", where="atom > 0").atoms.collect()) == [1, 4]


@pytest.mark.parametrize("text", ["", "name", "name A and", "(name A", "index x", "A B", "around 3 name A", "prop q > 1", "name A )", "index 0:5; drop"])
def test_selections_that_are_not_understood_raise(text):
    with pytest.raises(ValueError, match="selection"):
        from tesserspark.sources.selections import selected

        selected(text)


def test_long_frame_lists_are_joined(spark):
    n = 1500
    t = Trajectory.from_dataframe(spark.range(n).selectExpr("id AS frame", "0L AS atom", "'A' AS species", "0D AS x", "0D AS y", "0D AS z"), spark.range(n).selectExpr("id AS frame", "9D AS a", "9D AS b", "9D AS c"))
    some = t.select_frames(list(range(1, 1400)))
    assert some.atoms.count() == 1399 and len(some) == 1399
    assert "(" not in some.atoms._jdf.queryExecution().optimizedPlan().toString().split("IN ")[-1][:1]


def test_other_formats_need_their_library(spark, tmp_path):
    with pytest.raises(ValueError, match="MDAnalysis"):
        xyz.load_trajectory(tmp_path / "a.dcd", spark=spark)
    step = types.SimpleNamespace(dimensions=[9, 9, 9, 90, 90, 90])
    u = types.SimpleNamespace(atoms=types.SimpleNamespace(names=["A", "B"], positions=[[1, 2, 3], [4, 5, 6]]), trajectory=[step, step])
    assert universe.labels(u, "auto") == ["A", "B"]
    batch, row = next(universe.read_frames(u, [(0, 1)], "auto"))
    assert row == (0, 1, 9, 9, 9, 90, 90, 90) and batch.column(2).to_pylist() == ["A", "B"] and batch.column(3).to_pylist() == [1.0, 4.0]
    with pytest.raises(ValueError, match="charges"):
        universe.labels(u, "charges")
    assert "MDAnalysis" not in sys.modules
