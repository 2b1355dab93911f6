import numpy as np
import pytest

from lakeloom.llm import whitening


def plain(vectors, k=16):
    """By the dense covariance: for each kept vector, n, exact deviation; eigenvalues, components."""
    xs = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in xs]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [i for i in range(min(k, len(values))) if values[i] > 1e-12 * values[0]]
    whole = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in xs])
    return n, dev, values[keep] / values.sum(), whole @ vectors[:, keep] / np.sqrt(values[keep])


def compare(spark, vectors, rows=None, k=16):
    frame = spark.createDataFrame(rows or list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = whitening.transform(frame, whitening.fit(frame, k=k)).toPandas()
    n, dev, share, white = plain([np.array(v, np.float32) for v in vectors], k)
    assert (got.n == n).all() and (got.identity_error <= 1e-4).all() and got.identity_error.nunique() == 1
    size = len(share)
    assert len(got) == size * len(vectors)
    got = got.sort_values(["vec_id", "component"])
    assert got.deviation.tolist()[::size] == dev
    z = got.whitened.to_numpy().reshape(-1, size)
    for j in range(size):
        sign = np.sign(z[:, j] @ white[:, j])
        np.testing.assert_allclose(sign * z[:, j], white[:, j], atol=1e-7 * max(1, np.abs(white[:, j]).max()))
    np.testing.assert_allclose(got.explained.to_numpy().reshape(-1, size)[0], share, rtol=1e-9)
    return got


def test_against_the_dense_covariance(spark):
    r = np.random.default_rng(1)
    mix = r.standard_normal((40, 40)) * np.linspace(4, 0.3, 40)[:, None]
    v = (r.standard_normal((600, 40)) @ mix).round(3).tolist()
    compare(spark, v + [v[0]] * 300 + v[5:9])


def test_restarts_on_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SPANS", 3)
    r = np.random.default_rng(2)
    v = (r.standard_normal((300, 60)) * np.linspace(3, 1, 60)).tolist()
    frame = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    model = whitening.fit(frame, k=4)
    assert model.passes > 4 and (model.residuals <= 1e-12 * model.eigenvalues[0]).all()
    compare(spark, v, k=4)


def test_fewer_vectors_than_dimensions(spark):
    r = np.random.default_rng(3)
    got = compare(spark, r.standard_normal((5, 30)).tolist())
    assert got.component.max() == 4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [2.0, -1.0, 0.25], [0.1, 0.2, 7.0], [3.0, 3.0, 3.5], [1.0, 2.0, 0.5]]
    rows = [(i, v) for i, v in enumerate(good)] + [(9, None), (10, [1.0, None, 2.0]), (11, [nan, 1.0, 1.0]), (12, [inf, 0.0, 0.0]), (13, []), (14, [1.0, 2.0]), (15, [1e30, 0.0, 0.0]), (None, good[1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 d", "2 x", "3 component", "4 v")
    got = whitening.transform(frame, whitening.fit(frame)).toPandas()
    assert got.vec_id.dropna().astype(int).unique().tolist() == [0, 1, 2, 3, 4] and got.vec_id.isna().sum() == 3 and (got.n == 4).all()
    by = {(None if np.isnan(a) else int(a), c): w for a, c, w in zip(got.vec_id, got.component, got.whitened, strict=True)}
    assert all(by[0, c] == pytest.approx(by[4, c], abs=1e-12) and by[None, c] == pytest.approx(by[1, c], abs=1e-12) for c in (1, 2, 3))
    for none in (frame.limit(0), frame.where("vec_id = 13"), frame.where("vec_id = 1"), frame.where("vec_id in (0, 4)")):
        out = whitening.transform(none, whitening.fit(none))
        assert out.count() == 0 and out.columns == got.columns.tolist()


def test_deviations_are_exact_and_beyond_a_long_null():
    x = np.array([[1000000 + 5, 1000000 - 3], [1 << 40, 0]], np.int64)
    near, rest = np.array([1000000, 1000000]), np.array([3, -1])
    assert whitening.deviations(x, near, rest, 7).to_pylist() == [(35 - 3) ** 2 + (-21 + 1) ** 2, None]
    big = np.array([[1000000 + 2_100_000_000, 1000000]], np.int64)
    assert whitening.deviations(big, near, np.array([0, 0]), 1).to_pylist() == [2_100_000_000**2]
    some = np.array([[1000000 + 3_000_000_000, 1000000]], np.int64)
    assert whitening.deviations(some, near, np.array([0, 0]), 1).to_pylist() == [3_000_000_000**2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_tables(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = whitening.op13_whitening(spark, f"/root/testdata/{sf}").toPandas().sort_values(["vec_id", "component"])
    pairs = sorted((r.vec_id, r.embedding) for r in rows.collect())
    n, dev, share, white = plain([np.array(v, np.float32) for _, v in pairs])
    assert got.n.unique().tolist() == [n] and got.deviation.tolist()[::16] == dev and got.identity_error.max() < 1e-9
    z = got.whitened.to_numpy().reshape(-1, 16)
    signs = np.sign((z * white).sum(axis=0))
    np.testing.assert_allclose(z * signs, white, atol=1e-7)
    np.testing.assert_allclose(got.explained.to_numpy()[:16], share, rtol=1e-9)
