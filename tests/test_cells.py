import numpy as np
import pandas as pd

from autotab.operators import cells


def test_visits_come_in_pieces_whatever_the_number_of_cells(monkeypatch):
    """All cells lie in reach: the copies of a batch are handed over a bounded piece at a time, none lost."""
    monkeypatch.setattr(cells, "ROUTE_ROWS", 32)
    monkeypatch.setattr(cells, "ROUTE_VISITS", 500)
    rng = np.random.default_rng(1)
    found = cells.Cells(rng.normal(size=(10, 3)), [rng.normal(size=(4, 3)) for _ in range(10)])
    found.top_radius, found.radius, found.rows = np.full(10, 9.0), np.full(40, 9.0), np.full(40, 7)
    found.split = np.where(np.arange(40) % 3 == 0, 2, 1)
    pdf = pd.DataFrame({"_id": np.arange(50), "_x": list(rng.normal(size=(50, 3)))})
    got = list(cells.visits(pdf, found, cells.within(float("inf"))))
    assert max(map(len, got)) <= 32
    rows = pd.concat(got)
    want = {(i, c, p) for i in range(50) for c in range(40) for p in range(found.split[c])}
    assert len(rows) == len(want) and set(zip(rows["_id"], rows["_cell"], rows["_part"])) == want
