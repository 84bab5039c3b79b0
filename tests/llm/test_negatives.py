"""Hard negatives against plain inner products over all rows."""

import math

import numpy as np
import pytest
from pitspark.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score long, block long, at int, cell int, ranges string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def _plain(rows, every=5, positives=5, keep=3):
    clean = [(i, [math.floor(float(np.float32(x)) * 1) for x in v], label) for i, v, label in rows
             if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, v, label) in enumerate(clean):
        if anchor is None or anchor % every:
            continue
        found = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i, other == label) for b, (i, w, other) in enumerate(clean) if a != b]
        found.sort(key=lambda f: f[:3])
        for p in [f for f in found if f[4]][:positives]:
            inside = [f for f in found if not f[4] and -50 * p[0] <= -100 * f[0] <= -95 * p[0]][:keep]
            out += [(anchor, p[3], rank, f[3], -p[0], -f[0]) for rank, f in enumerate(inside, 1)]
    return sorted(out, key=repr)


def _rows(seed, n, dims, size):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.floor(draw.normal(size * (i % 3), size, dims))], int(draw.integers(0, 3))) for i in range(n)]


def _got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("dims, size", [(64, 30), (5, 3), (13, 200)])
def test_against_plain_products(spark, dims, size):
    rows = _rows(dims, 90, dims, size)
    got = _got(negatives.hard_negatives(_table(spark, rows).repartition(3), F.col("vec_id") % 5 == 0))
    assert got == _plain(rows) and len(got) > 50


def test_cells_of_several_strips_and_salts(spark, monkeypatch):
    rows = _rows(7, 120, 16, 20)
    monkeypatch.setattr(negatives, "STRIP", 5)
    monkeypatch.setattr(negatives, "BLOCKS_PER_SALT", 1)
    assert _got(negatives.hard_negatives(_table(spark, rows).repartition(9), F.col("vec_id") % 5 == 0)) == _plain(rows)


def test_awkward_rows(spark):
    same = [3.0, 4.0, 0.0]
    rows = [(0, same, 1), (0, same, 1), (5, same, 1), (10, [], 2), (15, None, 1), (20, [1.0, None], 1), (25, [math.nan], 1), (30, [math.inf], 2), (35, same, None),
            (None, same, 1), (None, [2.0, 4.0, 0.0], 2), (1, [2.0, 4.0, 0.0], 2), (2, [2.0, 4.0], 2), (3, [2.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0], 3), (4, [-3.0, -4.0], 2)]
    assert _got(negatives.hard_negatives(_table(spark, rows), F.col("vec_id") % 5 == 0)) == _plain(rows)


def test_empty_table_and_no_anchor(spark):
    assert negatives.hard_negatives(_table(spark, []), F.lit(True)).collect() == []
    assert negatives.hard_negatives(_table(spark, _rows(1, 9, 3, 2)), F.col("vec_id") < 0).collect() == []


def test_scores_are_exact_up_to_the_last_bit():
    draw = np.random.default_rng(1)
    for size in (1, 200, 1 << 26):
        a, b = draw.integers(-size, size + 1, (7, 24)), draw.integers(-size, size + 1, (40, 24))
        assert (negatives.scores(a, negatives.bit_planes(b).astype(np.intp)) == b @ a.T).all()
    with pytest.raises(ValueError, match="64 bits"):
        negatives.scores(np.full((1, 8), 1 << 40), negatives.bit_planes(np.full((1, 8), 1 << 40)).astype(np.intp))
