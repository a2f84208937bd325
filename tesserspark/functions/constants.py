"""Published constants of the elements.  An element that is not listed raises; callers may pass tables of their own."""

from __future__ import annotations

import math

AVOGADRO = 6.02214076e23

#: Standard atomic masses (u).
MASSES = {
    "H": 1.008, "He": 4.002602, "Li": 6.94, "Be": 9.0121831, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998403163, "Ne": 20.1797,
    "Na": 22.98976928, "Mg": 24.305, "Al": 26.9815385, "Si": 28.085, "P": 30.973761998, "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.0983, "Ca": 40.078,
    "Sc": 44.955908, "Ti": 47.867, "V": 50.9415, "Cr": 51.9961, "Mn": 54.938044, "Fe": 55.845, "Co": 58.933194, "Ni": 58.6934, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.921595, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.4678, "Sr": 87.62, "Y": 88.90584, "Zr": 91.224,
    "Nb": 92.90637, "Mo": 95.95, "Ru": 101.07, "Rh": 102.90550, "Pd": 106.42, "Ag": 107.8682, "Cd": 112.414, "In": 114.818, "Sn": 118.710, "Sb": 121.760,
    "Te": 127.60, "I": 126.90447, "Xe": 131.293, "Cs": 132.90545196, "Ba": 137.327, "La": 138.90547, "Ce": 140.116, "Pr": 140.90766, "Nd": 144.242, "Sm": 150.36,
    "Eu": 151.964, "Gd": 157.25, "Tb": 158.92535, "Dy": 162.500, "Ho": 164.93033, "Er": 167.259, "Tm": 168.93422, "Yb": 173.045, "Lu": 174.9668, "Hf": 178.49,
    "Ta": 180.94788, "W": 183.84, "Re": 186.207, "Os": 190.23, "Ir": 192.217, "Pt": 195.084, "Au": 196.966569, "Hg": 200.592, "Tl": 204.38, "Pb": 207.2,
    "Bi": 208.98040, "Th": 232.0377, "Pa": 231.03588, "U": 238.02891,
}

#: Bound coherent neutron scattering lengths (fm), natural elements (Sears 1992); real parts.
NEUTRON_B = {
    "H": -3.7390, "He": 3.26, "Li": -1.90, "Be": 7.79, "B": 5.30, "C": 6.6460, "N": 9.36, "O": 5.803, "F": 5.654, "Ne": 4.566,
    "Na": 3.63, "Mg": 5.375, "Al": 3.449, "Si": 4.1491, "P": 5.13, "S": 2.847, "Cl": 9.5770, "Ar": 1.909, "K": 3.67, "Ca": 4.70,
    "Sc": 12.29, "Ti": -3.438, "V": -0.3824, "Cr": 3.635, "Mn": -3.73, "Fe": 9.45, "Co": 2.49, "Ni": 10.3, "Cu": 7.718, "Zn": 5.680,
    "Ga": 7.288, "Ge": 8.185, "As": 6.58, "Se": 7.970, "Br": 6.795, "Kr": 7.81, "Rb": 7.09, "Sr": 7.02, "Y": 7.75, "Zr": 7.16,
    "Nb": 7.054, "Mo": 6.715, "Ru": 7.03, "Rh": 5.88, "Pd": 5.91, "Ag": 5.922, "Cd": 4.87, "In": 4.065, "Sn": 6.225, "Sb": 5.57,
    "Te": 5.80, "I": 5.28, "Xe": 4.92, "Cs": 5.42, "Ba": 5.07, "La": 8.24, "Ce": 4.84, "Pr": 4.58, "Nd": 7.69, "Sm": 0.80,
    "Eu": 7.22, "Gd": 6.5, "Tb": 7.38, "Dy": 16.9, "Ho": 8.01, "Er": 7.79, "Tm": 7.07, "Yb": 12.43, "Lu": 7.21, "Hf": 7.7,
    "Ta": 6.91, "W": 4.86, "Re": 9.2, "Os": 10.7, "Ir": 10.6, "Pt": 9.60, "Au": 7.63, "Hg": 12.692, "Tl": 8.776, "Pb": 9.405,
    "Bi": 8.532, "Th": 10.31, "U": 8.417,
}

#: The same of isotopes.
NEUTRON_B_ISOTOPE = {
    ("H", 1): -3.7406, ("H", 2): 6.671, ("H", 3): 4.792, ("He", 3): 5.74, ("Li", 6): 2.00, ("Li", 7): -2.22, ("B", 10): -0.1, ("B", 11): 6.65, ("C", 12): 6.6511, ("C", 13): 6.19, ("N", 14): 9.37, ("N", 15): 6.44,
    ("O", 16): 5.803, ("O", 17): 5.78, ("O", 18): 5.84, ("Mg", 24): 5.66, ("Mg", 25): 3.62, ("Mg", 26): 4.89, ("Si", 28): 4.107, ("Si", 29): 4.70, ("Si", 30): 4.58, ("Cl", 35): 11.65, ("Cl", 37): 3.08,
    ("K", 39): 3.74, ("K", 41): 2.69, ("Ca", 40): 4.80, ("Ca", 44): 1.42, ("Ti", 46): 4.93, ("Ti", 48): -6.08, ("Fe", 54): 4.2, ("Fe", 56): 9.94, ("Fe", 57): 2.3, ("Ni", 58): 14.4, ("Ni", 60): 2.8, ("Ni", 62): -8.7,
    ("Cu", 63): 6.43, ("Cu", 65): 10.61, ("Zn", 64): 5.22, ("U", 235): 10.47, ("U", 238): 8.402,
}

#: Analytic X-ray form factors by (element, charge): four amplitudes, four exponents, constant (International Tables C, 6.1.1.4).
XRAY = {
    ("H", 0): ((0.489918, 0.262003, 0.196767, 0.049879), (20.6593, 7.74039, 49.5519, 2.20159), 0.001305),
    ("He", 0): ((0.8734, 0.6309, 0.3112, 0.178), (9.1037, 3.3568, 22.9276, 0.9821), 0.0064),
    ("Li", 0): ((1.1282, 0.7508, 0.6175, 0.4653), (3.9546, 1.0524, 85.3905, 168.261), 0.0377),
    ("Li", 1): ((0.6968, 0.7888, 0.3414, 0.1563), (4.6237, 1.9557, 0.6316, 10.0953), 0.0167),
    ("Be", 0): ((1.5919, 1.1278, 0.5391, 0.7029), (43.6427, 1.8623, 103.483, 0.5420), 0.0385),
    ("Be", 2): ((6.2603, 0.8849, 0.7993, 0.1647), (0.0027, 0.8313, 2.2758, 5.1146), -6.1092),
    ("B", 0): ((2.0545, 1.3326, 1.0979, 0.7068), (23.2185, 1.021, 60.3498, 0.1403), -0.19319),
    ("C", 0): ((2.31, 1.02, 1.5886, 0.865), (20.8439, 10.2075, 0.5687, 51.6512), 0.2156),
    ("N", 0): ((12.2126, 3.1322, 2.0125, 1.1663), (0.0057, 9.8933, 28.9975, 0.5826), -11.529),
    ("O", 0): ((3.0485, 2.2868, 1.5463, 0.867), (13.2771, 5.7011, 0.3239, 32.9089), 0.2508),
    ("O", -1): ((4.1916, 1.63969, 1.52673, -20.307), (12.8573, 4.17236, 47.0179, -0.01404), 21.9412),
    ("F", 0): ((3.5392, 2.6412, 1.517, 1.0243), (10.2825, 4.2944, 0.2615, 26.1476), 0.2776),
    ("F", -1): ((3.6322, 3.51057, 1.26064, 0.940706), (5.27756, 14.7353, 0.442258, 47.3437), 0.653396),
    ("Ne", 0): ((3.9553, 3.1125, 1.4546, 1.1251), (8.4042, 3.4262, 0.2306, 21.7184), 0.3515),
    ("Na", 0): ((4.7626, 3.1736, 1.2674, 1.1128), (3.285, 8.8422, 0.3136, 129.424), 0.676),
    ("Na", 1): ((3.2565, 3.9362, 1.3998, 1.0032), (2.6671, 6.1153, 0.2001, 14.039), 0.404),
    ("Mg", 0): ((5.4204, 2.1735, 1.2269, 2.3073), (2.8275, 79.2611, 0.3808, 7.1937), 0.8584),
    ("Mg", 2): ((3.4988, 3.8378, 1.3284, 0.8497), (2.1676, 4.7542, 0.185, 10.1411), 0.4853),
    ("Al", 0): ((6.4202, 1.9002, 1.5936, 1.9646), (3.0387, 0.7426, 31.5472, 85.0886), 1.1151),
    ("Al", 3): ((4.17448, 3.3876, 1.20296, 0.528137), (1.93816, 4.14553, 0.228753, 8.28524), 0.706786),
    ("Si", 0): ((6.2915, 3.0353, 1.9891, 1.541), (2.4386, 32.3337, 0.6785, 81.6937), 1.1407),
    ("P", 0): ((6.4345, 4.1791, 1.78, 1.4908), (1.9067, 27.157, 0.526, 68.1645), 1.1149),
    ("S", 0): ((6.9053, 5.2034, 1.4379, 1.5863), (1.4679, 22.2151, 0.2536, 56.172), 0.8669),
    ("Cl", 0): ((11.4604, 7.1964, 6.2556, 1.6455), (0.0104, 1.1662, 18.5194, 47.7784), -9.5574),
    ("Cl", -1): ((18.2915, 7.2084, 6.5337, 2.3386), (0.0066, 1.1717, 19.5424, 60.4486), -16.378),
    ("Ar", 0): ((7.4845, 6.7723, 0.6539, 1.6442), (0.9072, 14.8407, 43.8983, 33.3929), 1.4445),
    ("K", 0): ((8.2186, 7.4398, 1.0519, 0.8659), (12.7949, 0.7748, 213.187, 41.6841), 1.4228),
    ("K", 1): ((7.9578, 7.4917, 6.359, 1.1915), (12.6331, 0.7674, -0.002, 31.9128), -4.9978),
    ("Ca", 0): ((8.6266, 7.3873, 1.5899, 1.0211), (10.4421, 0.6599, 85.7484, 178.437), 1.3751),
    ("Ca", 2): ((15.6348, 7.9518, 8.4372, 0.8537), (-0.0074, 0.6089, 10.3116, 25.9905), -14.875),
    ("Ti", 0): ((9.7595, 7.3558, 1.6991, 1.9021), (7.8508, 0.5, 35.6338, 116.105), 1.2807),
    ("Fe", 0): ((11.7695, 7.3573, 3.5222, 2.3045), (4.7611, 0.3072, 15.3535, 76.8805), 1.0369),
    ("Ni", 0): ((12.8376, 7.292, 4.4438, 2.38), (3.8785, 0.2565, 12.1763, 66.3421), 1.0341),
    ("Cu", 0): ((13.338, 7.1676, 5.6158, 1.6735), (3.5828, 0.247, 11.3966, 64.8126), 1.191),
    ("Zn", 0): ((14.0743, 7.0318, 5.1652, 2.41), (3.2655, 0.2333, 10.3163, 58.7097), 1.3041),
    ("Ge", 0): ((16.0816, 6.3747, 3.7068, 3.683), (2.8509, 0.2516, 11.4468, 54.7625), 2.1313),
    ("Zr", 0): ((17.8765, 10.948, 5.41732, 3.65721), (1.27618, 11.916, 0.117622, 87.6627), 2.06929),
    ("Te", 0): ((19.9644, 19.0138, 6.14487, 2.5239), (4.81742, 0.420885, 28.5284, 70.8403), 4.352),
}


def _known(table: dict, key, what: str):
    if key not in table:
        raise ValueError(f"no {what} is listed for {key}; pass a table of your own")
    return table[key]


def mass(element: str) -> float:
    return _known(MASSES, element, "atomic mass")


def neutron_b(element: str, isotope: int | None = None) -> float:
    return _known(NEUTRON_B, element, "neutron scattering length") if isotope is None else _known(NEUTRON_B_ISOTOPE, (element, isotope), "neutron scattering length")


def xray_terms(element: str, charge: int = 0) -> tuple:
    return _known(XRAY, (element, charge), "X-ray form factor")


def xray_f0(element: str, q: float, charge: int = 0) -> float:
    a, b, c = xray_terms(element, charge)
    s2 = (q / (4 * math.pi)) ** 2
    return sum(x * math.exp(-y * s2) for x, y in zip(a, b)) + c
