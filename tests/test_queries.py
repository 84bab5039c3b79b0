"""Every registered query against its SQL twin on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

import oracle
from pitspark.queries import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    """Equal rows in any order; numbers to twelve digits."""
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns, key=lambda c: (pd.api.types.is_float_dtype(want[c]), c))

    def ordered(frame):
        frame = frame[columns].copy()
        for c in columns:
            if not pd.api.types.is_float_dtype(want[c]):
                frame[c] = frame[c].map(lambda v: "" if v is None or v != v else str(v))
            else:
                frame[c] = frame[c].astype(float)
        return frame.sort_values(columns).reset_index(drop=True)

    a, b = ordered(got), ordered(want)
    for c in columns:
        if pd.api.types.is_float_dtype(want[c]):
            assert np.allclose(a[c], b[c], rtol=1e-11, atol=2e-6, equal_nan=True), c
        else:
            assert a[c].equals(b[c]), c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        same(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0
