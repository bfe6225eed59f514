import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int"


def _plain(rows, is_anchor, k=5, low=80, high=100):
    """All pairs, in Python integers."""
    seen = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = (lab, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        seen[i] = min(seen.get(i, w), w)
    dim = max({len(v) for _, v in seen.values()}, key=lambda d: (sum(len(v) == d for _, v in seen.values()), -d), default=0)
    seen = {i: r for i, r in seen.items() if len(r[1]) == dim}
    out = set()
    for a in filter(is_anchor, seen):
        score = sorted(((-sum(x * y for x, y in zip(seen[a][1], v)), i, lab) for i, (lab, v) in seen.items() if i != a))
        for ps, p, _ in [s for s in score if s[2] == seen[a][0]][:k]:
            fits = [s for s in score if s[2] != seen[a][0] and low * -ps <= 100 * -s[0] <= high * -ps]
            out |= {(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits[:k])}
    return out


def _rows(df):
    return {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()}


def _clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 0.5
    v = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.05
    return [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("dim,cell", [(3, 40), (16, 400), (16, 10_000)])
def test_equals_all_pairs(spark, dim, cell):
    rows = _clustered(1500, dim, dim + cell)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = gnat.mine(df, F.col("vec_id") % 25 == 0, leaf=20, cell=cell, sample=700)
    assert _rows(got) == _plain(rows, lambda i: i % 25 == 0)


def test_hot_vector_nulls_repeats_and_other_columns(spark):
    rows = _clustered(400, 4, 3)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 3) for i in range(300)]                        # one vector on a third of all rows
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0], 1), (2002, [1.0, float("nan"), 0.0, 0.0], 1), (2003, same, None),
             (None, same, 1), (2004, [0.0] * 4, 1), (2005, [float("inf"), 0.0, 0.0, 0.0], 0), (2006, [1.0], 0), (2007, [], 0)]
    rows += [rows[5]] * 50 + [(7, [0.1, 0.2, 0.3, 0.4], 9), (2004, [0.0] * 4, 1)]
    df = (spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("id", F.lit("x")).withColumn("cell", F.lit(1))
          .withColumn("windows", F.lit(2)).withColumn("s", F.lit(0)))
    got = gnat.mine(df, F.col("vec_id") % 100 == 0, leaf=16, cell=64, sample=300)
    assert _rows(got) == _plain(rows, lambda i: i % 100 == 0)


def test_large_components_and_negative_scores(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e5, 1e5) for _ in range(3)], i % 2) for i in range(120)]
    rows += [(500, [1e-9, 0.0, 0.0], 7), (600, [1.0, 0.0, 0.0], 8), (601, [-1.0, 0.0, 0.0], 8)]
    got = gnat.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, leaf=8, cell=30)
    assert _rows(got) == _plain(rows, lambda i: i % 20 == 0)
    with pytest.raises(ValueError):
        gnat.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA), F.col("vec_id") == 0)


def test_empty_and_tiny_tables(spark):
    assert _rows(gnat.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0)) == set()
    assert _rows(gnat.mine(spark.createDataFrame([(0, None, 1)], SCHEMA), F.col("vec_id") % 2 == 0)) == set()
    one = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2)], SCHEMA)
    assert _rows(gnat.mine(one, F.col("vec_id") == 0)) == {(0, 1, 1, 2, 65536, 58880)}


def test_clusters_close_most_leaves():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 8))
    v = np.floor(256 * (centers[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 8)) * 0.02))
    m2 = int((v * v).sum(axis=1).max())
    tree = gnat.Tree(v[:4000], len(v), m2, leaf=64, cell=512)

    def widen(node, child, d):
        tree.low[node][:, child] = np.minimum(tree.low[node][:, child], d.min(axis=0))
        tree.high[node][:, child] = np.maximum(tree.high[node][:, child], d.max(axis=0))

    leaf = tree.file(tree.lift(v), widen)
    asks = v[::100]
    score = asks @ v.T
    fifth = -np.sort(-score, axis=1)[:, 5]
    open_ = tree.reached(asks, *tree.annulus(asks, fifth, np.full(len(asks), 2.0 ** 62)))
    hit = score >= fifth[:, None]
    assert (open_[:, leaf] | ~hit).all()
    assert open_[:, leaf].mean() < 0.5
