"""Principal components against numpy's singular values."""

import numpy as np
import pytest

from tickloom.operators import factors as fa


def test_components_equal_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2)) @ rng.normal(0, 1, (2, 5)) * [1, 10, 0.1, 5, 2] + rng.normal(0, 0.2, (300, 5)) + 100
    rows = [tuple(None if (i, j) in ((3, 1), (7, 4)) else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    names = list("abcde")
    got = fa.pca_report(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3), names).collect()
    z = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for j in range(5):
        known = np.sort(z[~np.isnan(z[:, j]), j])
        z[np.isnan(z[:, j]), j] = known[(len(known) - 1) // 2]  # the lower median, an element
    z = (z - z.mean(0)) / z.std(0)
    s, v = np.linalg.svd(z, full_matrices=False)[1:]
    share = s ** 2 / (s ** 2).sum()
    assert len(got) == 25 and got[0]["n_90"] == int(np.searchsorted(np.cumsum(share), 0.9)) + 1 and got[0]["n_95"] == int(np.searchsorted(np.cumsum(share), 0.95)) + 1
    for r in got:
        i, j = r["component"] - 1, names.index(r["feature"])
        line = v[i] * np.sign(v[i][np.abs(v[i]).argmax()])
        assert r["variance_share"] == pytest.approx(share[i], abs=1e-9) and r["cumulative"] == pytest.approx(share[:i + 1].sum()) and r["loading"] == pytest.approx(line[j], abs=1e-6)
    assert fa.pca_report(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect() == []
