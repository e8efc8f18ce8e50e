import numpy as np
import pytest

from orrery.operators import align, measures
from orrery.operators import transforms as t
from orrery.operators.kernels import least_squares, moments
from tests.conftest import values

RNG = np.random.default_rng(3)
#: Golden matrices and values (fixed values of the public measures on them).
GX = np.arange(32.0).reshape(8, 4)
GY = np.array([[1, 2, 27, 22], [0, 28, 15, 18], [12, 9, 14, 8], [11, 19, 16, 13], [31, 20, 10, 3], [24, 5, 7, 29], [4, 30, 21, 6], [26, 17, 23, 25]], float)
SHAPES = [(50, 25, 25), (50, 25, 30), (50, 30, 25), (20, 30, 25)]


@pytest.fixture(params=SHAPES, ids=str)
def spaces(request):
    n, a, b = request.param
    x = RNG.standard_normal((n, a))
    return x, x @ RNG.standard_normal((a, b)) + 0.1 * RNG.standard_normal((n, b)) + 2


def test_moments_of_many_partitions(frame):
    x = RNG.standard_normal((200, 5)) + 100
    m = moments(frame(x).repartition(90), "vector", fan_in=8)
    assert m.n == 200 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.scatter / 199, np.cov(x.T))


def test_least_squares_of_many_partitions(frame, spaces):
    x, y = spaces
    got = least_squares(align.pair(frame(x), frame(y)).repartition(70), "x", "y")
    assert np.allclose(got, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


@pytest.mark.parametrize("normal", [None, t.Centering, t.StandardScaling])
@pytest.mark.parametrize("name", ["svd", "lstsq", "lstsq_ortho"])
def test_translator_equals_numpy(frame, spaces, name, normal):
    x, y = spaces
    fit = {None: lambda m: (0, 1), t.Centering: lambda m: (m.mean(0), 1), t.StandardScaling: lambda m: (m.mean(0), m.std(0, ddof=1))}[normal]
    (mx, sx), (my, sy) = fit(x), fit(y)
    a, b = (x - mx) / sx, (y - my) / sy
    wide = max(a.shape[1], b.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    if name == "svd":
        u, _, v = np.linalg.svd(pad(a).T @ pad(b))
        expected = pad(a) @ (u @ v)
        if wide != y.shape[1] or wide != x.shape[1] or len(x) <= wide:
            pytest.skip("the orthogonal map is not unique here") if len(x) <= wide else None
    else:
        w = np.linalg.lstsq(pad(a), pad(b), rcond=None)[0]
        if name == "lstsq_ortho":
            if wide != y.shape[1] or wide != x.shape[1] or len(x) <= wide:
                pytest.skip("rank-deficient")
            u, _, v = np.linalg.svd(w, full_matrices=False)
            w = u @ v
        expected = pad(a) @ w
    make = lambda: normal() if normal else None
    tr = align.Translator(align.MatrixAligner(name), make(), make(), align.ZeroPadding()).fit(frame(x), frame(y))
    assert np.allclose(values(tr.transform(frame(x))), expected[:, : y.shape[1]] * sy + my, atol=1e-6)


def test_procrustes_recovers_a_rotation(frame):
    x = RNG.standard_normal((60, 8))
    q = np.linalg.qr(RNG.standard_normal((8, 8)))[0]
    y = x @ q * 4 + 3
    got = values(align.Translator(align.MatrixAligner("svd"), t.Centering(), t.Centering()).fit(frame(x), frame(x @ q)).transform(frame(x)))
    assert np.allclose(got, x @ q)
    pair = align.procrustes().fit(frame(x), frame(y))
    r = pair.aligner.state["matrix"]
    assert np.allclose(r.T @ r, np.eye(8)) and values(pair.translate(frame(x))).shape == y.shape


def test_sgd_comes_near_and_is_seeded(frame):
    x = RNG.standard_normal((200, 4))
    y = x @ RNG.standard_normal((4, 3)) + 1
    one = align.SGDAffineAligner(num_steps=3000, lr=0.01).fit(frame(x), frame(y))
    assert np.abs(values(one.transform(frame(x))) - y).max() < 0.05
    again = align.SGDAffineAligner(num_steps=3000, lr=0.01).fit(frame(x), frame(y))
    assert np.array_equal(one.state["matrix"], again.state["matrix"])


def test_aligner_errors(frame):
    with pytest.raises(RuntimeError):
        align.MatrixAligner("svd").transform(frame(GX))
    with pytest.raises(NotImplementedError):
        align.MatrixAligner("svd").inverse_transform(frame(GX))
    with pytest.raises(ValueError):
        align.MatrixAligner("svd").fit(frame(GX), frame(GX[:, :2]))
    with pytest.raises(RuntimeError):
        align.ZeroPadding().transform(x=frame(GX))


def test_golden_values(frame):
    x, y = frame(GX), frame(GY)
    assert abs(measures.linear_cka(x, y) - 0.2815) < 1e-4
    assert abs(measures.rbf_cka(x, y) - 0.3945) < 1e-4
    assert abs(measures.svcca(x, y) - 0.8125) < 1e-3
    assert abs(measures.CKA("linear")(x, y) - 0.2815) < 1e-4 and abs(measures.CKA("rbf")(x, y) - 0.3945) < 1e-4
    assert abs(measures.SVCCA(robust=True)(x, y) - 0.8125) < 1e-3


def test_similarity_properties(frame, spaces):
    x, y = (frame(m) for m in spaces)
    for f in (measures.linear_cka, measures.rbf_cka, measures.svcca):
        assert abs(f(x, x) - 1) < 1e-3 and abs(f(x, y) - f(y, x)) < 1e-3 and 0 <= f(x, y) <= 1.001


def test_median_distance_in_rounds_and_blocks(frame, monkeypatch):
    x = RNG.standard_normal((40, 3))
    d = ((x[:, None] - x) ** 2).sum(2)
    d = np.sort(d[d > 0])
    assert measures.median_squared_distance(frame(x), block=7) == pytest.approx(d[(len(d) - 1) // 2])


def test_rbf_blocks_give_the_same(frame):
    x, y = frame(GX), frame(GY)
    assert measures.rbf_cka(x, y, block=3) == pytest.approx(measures.rbf_cka(x, y))


def test_row_measures_pair_by_identity(frame):
    x, y = frame(GX), frame(GY).repartition(3)
    row = measures.compare(x, y, x, metrics=["l2", "l1", "cosine", "mse", "l1_loss", "trace"]).orderBy("other").collect()
    assert row[0].l2 == pytest.approx(np.linalg.norm(GX - GY, axis=1).mean())
    assert row[0].l1 == pytest.approx(np.abs(GX - GY).sum(1).mean())
    assert row[0].mse == pytest.approx(((GX - GY) ** 2).mean()) and row[0].l1_loss == pytest.approx(np.abs(GX - GY).mean())
    assert row[0].trace == pytest.approx(np.trace(GX @ GY.T)) and row[1].l2 == 0


def test_svcca_without_variance(frame):
    assert measures.svcca(frame(np.ones((5, 2))), frame(GX[:5, :2])) == 0
