"""The classifier against a dense version in plain Python: n-grams of characters, ratios, weights and scores."""

import collections
import math
import zlib

import numpy as np

from tesserspark.llm import toxicity


def hashed(gram):
    h = 0
    for c in gram:
        h = h * 0x01000193 % 2**32 ^ (ord(c) + 1)
    x = h * 0x9E3779B1 % 2**32
    return ((x ^ x >> 15) * 0x85EBCA77 % 2**32) >> (32 - toxicity.BITS)


def features(text):
    s = " " + " ".join((text or "").lower().split()) + " "
    return {hashed(s[k : k + n]) for n in toxicity.ORDERS for k in range(len(s) - n + 1)}


def test_grams_are_of_characters():
    assert sorted(set(toxicity.grams("Ä über\t\n häß 漢字 😀!").tolist())) == sorted(features("Ä über\t\n häß 漢字 😀!"))
    assert len(toxicity.grams("äöüß")) == len(toxicity.grams("abcd"))  # four characters each, whatever their bytes


def test_scores_equal_a_dense_fit(spark):
    rng = np.random.default_rng(2)
    stems = ["".join(rng.choice(list("abcdefgäöü"), 5)) for _ in range(40)]
    rows, marks = [], []
    for k in range(160):
        bad = int(k % 3 == 0)
        w = list(rng.choice(stems, 12)) + (["gräßlich"] * 2 if bad and k % 2 else ["übelster"] if bad else ["freundlich"])
        rows.append((k, " ".join(w)))
        marks.append((k, bad))
    rows += [(900, None), (901, ""), (902, "x" * 50_000 + " gräßlich"), (903, rows[0][1])]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, label string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = [(features(dict(rows)[i]), y) for i, y in marks if not held(i)]
    n = collections.Counter(y for _, y in train)
    df = [collections.Counter(f for fs, y in train if y == c for f in fs) for c in (0, 1)]
    a = toxicity.ALPHA
    ratio = {}
    for f in {*df[0], *df[1]}:
        r = math.log((df[1][f] + a) / (n[1] + 2 * a)) - math.log((df[0][f] + a) / (n[0] + 2 * a))
        if df[0][f] + df[1][f] >= toxicity.LEAST and abs(r) >= toxicity.SURE * math.sqrt(1 / (df[1][f] + a) + 1 / (df[0][f] + a)):
            ratio[f] = r
    names = sorted(ratio)
    assert names
    x = np.array([[ratio[f] if f in fs else 0.0 for f in names] for fs, _ in train])
    y = np.array([y for _, y in train])
    share = n[1] / (n[0] + n[1])
    weight = np.where(y == 1, share / n[1], (1 - share) / n[0])
    w, bias = np.zeros(len(names)), math.log(share / (1 - share))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, 121):
        e = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        g = np.append(x.T @ e + 1e-2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.02 / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    for i, text in rows:
        fs = features(text)
        z = bias + sum(w[k] * ratio[f] for k, f in enumerate(names) if f in fs)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6, i
    assert got[900] == got[901] and got[903] == got[0] and got[902] > 0.5
