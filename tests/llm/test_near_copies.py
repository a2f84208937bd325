"""Near copies against all pairs of shingle sets, and in the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from tesserspark.llm import near_copies

SF = "/root/testdata/sf0.001"


def brute(rows, size=5, least=0.8):
    """Least doc_id of each component, by all pairs."""

    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [cut(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = sets[a] | sets[b]
            if rows[a][1] == rows[b][1] or both and len(sets[a] & sets[b]) >= least * len(both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return sorted(min((rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None), default=-1) for x in set(label))


@pytest.mark.parametrize("chunk", [500, 4])
def test_near_copies(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(900, None), (901, None), (902, ""), (903, " \n"), (904, "two words"), (905, "Two  words"), (None, "no id here but text of its own"), (906, "no id here but text of its own")]
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for _ in range(12):  # edits of 0 to 9 words: similarities on both sides of 0.8
            copy = list(words)
            for p in rng.choice(200, rng.integers(0, 10), replace=False):
                copy[p] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    out = near_copies.one_of_each(df, chunk=chunk)
    assert out.columns == df.columns
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    assert got == brute(rows) and len(got) < 100
    assert near_copies.one_of_each(df.where("false")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert kept <= set(brute([(r.doc_id, r.text) for r in docs.collect()]))
