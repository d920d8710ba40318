"""Units with the same cells tie, in whatever order their cells are summed."""

import pytest

from fallowgrid.operators import suites


def test_units_of_equal_cells_tie(spark):
    values = {1: (0.1, 0.2, 0.3), 2: (0.3, 0.2, 0.1), 3: (1.0, 1.0, 1.0)}
    rows = [(u, 0, s, float(u)) for u, cells in values.items() for s in cells]
    cells = spark.createDataFrame(rows, "u int, split int, s double, y double").coalesce(1)
    got = {r.half: r.value for r in suites.unit_correlation(cells, "u", "split", ["s"], "y").collect()}
    assert got["full"] == pytest.approx(0.8660254, abs=1e-6)
