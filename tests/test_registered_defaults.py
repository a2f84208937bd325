"""Registered queries go as far as their operators' defaults."""

import numpy as np

import __spark_entry__
from tesserspark.operators import carbon

SF = "/root/testdata/sf0.001"


def brute_rings(near, most=8):
    """Chordless cycles that are a shortest one through one of their edges, from all simple cycles."""
    cycles = []

    def walk(path):
        for w in near[path[-1]]:
            if w == path[0] and len(path) > 2 and path[1] < path[-1]:
                cycles.append(tuple(path))
            elif w > path[0] and w not in path and len(path) < most:
                walk([*path, w])

    for a in range(len(near)):
        walk([a])
    sides = lambda c: [frozenset(x) for x in zip(c, c[1:] + c[:1])]
    least = {}
    for c in cycles:
        for e in sides(c):
            least[e] = min(least.get(e, 99), len(c))
    chordless = lambda c: sum(b in near[a] for a in c for b in c) == 2 * len(c)
    return {frozenset(sides(c)) for c in cycles if chordless(c) and any(least[e] == len(c) for e in sides(c))}


def test_rings_of_five_to_eight(spark):
    rng = np.random.default_rng(4)
    edges, at = {(int(a), int(b)) for a, b in rng.integers(0, 16, (20, 2)) if a != b}, 16
    for n in (5, 6, 7, 8):
        edges |= {(at + k, at + (k + 1) % n) for k in range(n)}
        at += n
    near = [set() for _ in range(at)]
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    df = spark.createDataFrame([(0, a, b) for a in range(at) for b in near[a]], "frame long, src long, dst long")
    got = [r.ring for r in carbon.frame_rings(df).collect()]
    want = brute_rings(near)
    assert {frozenset(frozenset(x) for x in zip(r, r[1:] + r[:1])) for r in got} == want and len(got) == len(want)
    assert {5, 6, 7, 8} <= {len(r) for r in got}
    known = __spark_entry__.queries()
    counts = {(r.frame, r.ring_size): r.n for r in known["ring_counts"](spark, SF).collect()}
    listed = {}
    for r in known["rings"](spark, SF).collect():
        size = r.ring.count(",") + 1
        listed[r.frame, size] = listed.get((r.frame, size), 0) + 1
    assert listed == counts and max(k for _, k in listed) > 4


def test_calibration_runs_all_sizes(spark):
    rows = __spark_entry__.queries()["graphene_calibration"](spark, SF).collect()
    assert sorted(r.requested_L_A for r in rows) == [8, 10, 15, 22, 30, 40]
