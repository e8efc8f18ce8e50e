import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators import projection
from orrery.operators import transforms as t
from tests.conftest import values

X = np.random.default_rng(0).standard_normal((50, 12)) * 3 + 1
CASES = [
    (t.Centering(), lambda x: x - x.mean(0)),
    (t.STDScaling(), lambda x: x / x.std(0, ddof=1)),
    (t.StandardScaling(), lambda x: (x - x.mean(0)) / x.std(0, ddof=1)),
    (t.LPNorm(2), lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)),
    (t.LPNorm(1), lambda x: x / np.abs(x).sum(1, keepdims=True)),
    (t.LPNorm(3), lambda x: x / (np.abs(x) ** 3).sum(1, keepdims=True) ** (1 / 3)),
    (t.IsotropicScaling(2.5), lambda x: x * 2.5),
]


@pytest.mark.parametrize("transform,expected", CASES, ids=lambda c: getattr(c, "name", ""))
def test_equals_numpy(frame, transform, expected):
    assert np.allclose(values(transform.fit_transform(frame(X))), expected(X))


@pytest.mark.parametrize("make", [t.Centering, t.STDScaling, t.StandardScaling, lambda: t.IsotropicScaling(3.0), lambda: t.RandomIsometry(1), lambda: t.RandomDimensionPermutation(1), t.Identity, lambda: t.TransformSequence([t.Centering(), t.RandomIsometry(2), t.STDScaling()])])
def test_inverse_restores(frame, make):
    df = frame(X)
    fitted = make().fit(df)
    assert np.allclose(values(fitted.inverse_transform(fitted.transform(df))), X)
    swapped = t.InverseTransform(fitted)
    assert np.allclose(values(swapped.inverse_transform(swapped.transform(df))), X)


def test_large_isometry_uses_the_kernel_and_keeps_norms(frame):
    x = np.random.default_rng(1).standard_normal((20, 40))
    got = values(t.RandomIsometry(0).fit_transform(frame(x)))
    assert np.allclose(np.linalg.norm(got, axis=1), np.linalg.norm(x, axis=1))
    assert not np.allclose(got, x)


def test_simple_transform_is_the_class(frame):
    df = frame(X)
    simple = t.SimpleTransform(t.centering, t.centering_state, t.centering_inverse)
    assert np.allclose(values(simple.fit_transform(df)), values(t.Centering().fit_transform(df)))
    assert np.allclose(values(simple.inverse_transform(simple.transform(df))), X)
    with pytest.raises(RuntimeError):
        t.SimpleTransform(t.centering, t.centering_state).transform(df)
    with pytest.raises(ValueError):
        t.SimpleTransform(t.lp_normalize).inverse_transform(df)


def test_constant_dimensions_and_single_rows(frame):
    x = X.copy()
    x[:, 0] = 3
    assert np.allclose(t.STDScaling().fit(frame(x)).state["scale"][0], 1)
    assert np.isnan(t.STDScaling().fit(frame(X[:1])).state["scale"]).all()
    zero = values(t.LPNorm(2).transform(frame(np.zeros((2, 3)))))
    assert (zero == 0).all()


def test_not_invertible(frame):
    with pytest.raises(ValueError):
        t.InverseTransform(t.LPNorm())
    with pytest.raises(ValueError):
        t.TransformSequence([t.LPNorm()]).inverse_transform(frame(X))


def test_mean_norm_inverse(frame):
    df = frame(X)
    fitted = t.MeanLPNorm().fit(df)
    mean = np.linalg.norm(X, axis=1).mean()
    assert np.allclose(values(fitted.inverse_transform(fitted.transform(df))), X / np.linalg.norm(X, axis=1, keepdims=True) * mean)


ANCHORS = X[:7]


def reference(name, x, a):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    if name == "cosine":
        return unit(x) @ unit(a).T
    if name == "angular":
        return np.arccos(np.clip(unit(x) @ unit(a).T, -1, 1)) / np.pi
    if name == "l1":
        return np.abs(x[:, None] - a).sum(2)
    if name == "euclidean":
        return np.sqrt(((x[:, None] - a) ** 2).sum(2))
    return np.linalg.lstsq(a.T, x.T, rcond=None)[0].T


@pytest.mark.parametrize("name", ["cosine", "angular", "l1", "euclidean", "CoB"])
def test_projections(frame, name):
    df = frame(X)
    got = values(projection.relative_projection(df, frame(ANCHORS), name))
    assert np.allclose(got, reference(name, X, ANCHORS))


def test_change_of_basis_with_more_anchors_than_dimensions(frame):
    a = X[:20]
    assert np.allclose(values(projection.relative_projection(frame(X), a, "CoB")), reference("CoB", X, a))


def test_pointwise_equals_vectorised(frame):
    slow = projection.pointwise(lambda x, a: np.abs(x - a).sum())
    assert np.allclose(values(projection.relative_projection(frame(X), ANCHORS, slow)), reference("l1", X, ANCHORS))
    with pytest.raises(ValueError):
        projection.projection_fn("cosine")(slow)


@pytest.mark.parametrize("name,change,same", [
    ("cosine", "scale", True), ("cosine", "rotate", True), ("cosine", "shift", False),
    ("euclidean", "shift", True), ("euclidean", "rotate", True), ("euclidean", "scale", False),
    ("l1", "permute", True), ("l1", "rotate", False), ("angular", "rotate", True),
])
def test_invariances(frame, name, change, same):
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((12, 12)))[0]
    f = {"scale": lambda m: m * 7, "rotate": lambda m: m @ q, "shift": lambda m: m + 20, "permute": lambda m: m[:, ::-1]}[change]
    before = values(projection.relative_projection(frame(X), ANCHORS, name))
    after = values(projection.relative_projection(frame(f(X)), f(ANCHORS), name))
    assert np.allclose(before, after) == same


def test_centred_cosine_is_invariant_to_shifts(frame):
    make = lambda: projection.RelativeProjection("cosine", abs_transform=t.Centering(), rel_transform=t.StandardScaling())
    one = values(make().fit(frame(ANCHORS)).transform(frame(X)))
    two = values(make().fit(frame(ANCHORS + 50)).transform(frame(X + 50)))
    assert np.allclose(one, two)


def test_nulls_and_empty(spark, frame):
    df = frame(X).withColumn("vector", F.when(F.col("offset") > 1, F.col("vector")))
    got = t.Centering().fit_transform(df)
    assert got.where("vector is null").count() == 2
    assert t.LPNorm().transform(frame(np.zeros((0, 3)))).count() == 0
    assert vec.rounded("vector") is not None
