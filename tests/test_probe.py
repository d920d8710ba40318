"""Candidate axes: every gate against a plain refit."""

import numpy as np
import pytest

from fallowgrid.operators import selection, zoning


def test_gates_equal_plain_refits(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 6))
    x[:, 1] += 0.9 * x[:, 0]
    x = np.column_stack([x, x[:, 2] + 0.01 * r.normal(size=500), x[:, 3] + 0.6 * r.normal(size=500), np.ones(500)])
    names = ["t_a", "t_b", "u_c", "u_d", "v_new", "v_gov", "v_copy", "v_near", "flat"]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, *[0.0] * 8)], ", ".join(f"{n} double" for n in names))
    base = names[:4]
    rows = {g.candidate: g for g in selection.probe_candidates(df, base, {"v_new": True, "v_gov": False, "v_copy": True, "v_near": True}, [("t_a", "t_b"), ("u_c", "v_copy")], 3).collect()}
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)

    def needed(cols):
        w = np.array(zoning.theme_weights([names[c] for c in cols]))
        share = np.linalg.eigvalsh(np.cov((z[:, cols] * w).T))[::-1]
        return int((np.cumsum(share) / share.sum() < 0.9 - 1e-9).sum()) + 1

    limit = min(abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]), abs(np.corrcoef(x[:, 2], x[:, 6])[0, 1]))
    for c, name in ((4, "v_new"), (5, "v_gov"), (6, "v_copy"), (7, "v_near")):
        g = rows[name]
        rho = np.abs([np.corrcoef(x[:, c], x[:, i])[0, 1] for i in range(4)])
        assert g.nearest == base[int(rho.argmax())] and g.max_abs_r == pytest.approx(rho.max()) and g.redundant == (rho.max() >= limit)
        assert g.components == needed([0, 1, 2, 3]) and g.components_with == needed([0, 1, 2, 3, c]) and g.new_component == (g.components_with > g.components)
        full = np.column_stack([np.ones(500), z[:, :4]])
        rest = z[:, c] - full @ np.linalg.lstsq(full, z[:, c], rcond=None)[0]
        assert g.inflation == pytest.approx(z[:, c].var() / rest.var(), rel=1e-6) and -1 <= g.ari <= 1
    assert rows["v_gov"].verdict == "not admissible" and rows["v_copy"].verdict == "redundant" and rows["v_new"].verdict in ("moves the partition", "no new component")
