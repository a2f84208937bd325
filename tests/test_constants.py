"""Sum rules of the published tables."""

import pytest

from tesserspark.functions import constants
from tesserspark.operators.scattering import ScatteringComposition, isotope_number, parse_formula

ORDER = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te".split()


@pytest.mark.parametrize("element, charge", constants.XRAY)
def test_form_factors_begin_with_all_electrons(element, charge):
    assert constants.xray_f0(element, 0.0, charge) == pytest.approx(ORDER.index(element) + 1 - charge, abs=0.04)
    values = [constants.xray_f0(element, q, charge) for q in (0, 1, 3, 6, 10)]
    assert all(a > b > 0 for a, b in zip(values, values[1:]))


def test_masses_grow_with_few_known_exceptions():
    pairs = list(zip(ORDER, ORDER[1:]))
    odd = [(a, b) for a, b in pairs if {a, b} <= set(constants.MASSES) and constants.MASSES[a] >= constants.MASSES[b]]
    assert odd == [("Ar", "K"), ("Co", "Ni")] and set(constants.NEUTRON_B) <= set(constants.MASSES)


def test_composition_of_a_formula():
    assert parse_formula("Ca(NO3)2") == {"Ca": 1.0, "N": 2.0, "O": 6.0}
    assert [isotope_number(x) for x in (7, "7Li", "Li-7", "Li7")] == [7] * 4
    c = ScatteringComposition.from_formula("LiF", isotopes={"Li": {"6Li": 0.25, "7Li": 0.75}})
    assert c.neutron_scattering_lengths()["Li"] == pytest.approx(0.25 * 2.0 - 0.75 * 2.22)
    assert c.number_density(2.0) == pytest.approx(2 * 6.02214076e23 * 2.0 / (6.94 + 18.998403163) / 1e24)
    with pytest.raises(ValueError, match="no neutron"):
        ScatteringComposition.from_formula("Xx2").neutron_scattering_lengths()
