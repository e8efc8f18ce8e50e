"""Subsets, clusters and neighbours of vectors, samples by proportion: against brute force, with their edge cases."""

import numpy as np
import pytest

from orrery.llm import clusters, neighbours, proportional, subset
from orrery.llm.vectors import sample_rows, valid_vectors

KINDS = "vec_id long, space_id string, vec_offset long, vec_key string, sample_id long, label int, vector array<float>, added_at timestamp, k int, cell string, rows int, score int, unit string, draw int"
RNG = np.random.default_rng(0)


def spaces(spark, dims, subset_of=10):
    rows = [(s, d, subset_of, "x") for s, d in dims.items()]
    return spark.createDataFrame([*rows, ("nodim", None, 5, "x"), (None, 3, 5, "x")], "space_id string, dim int, n_subset long, vec_id string")


def vectors(spark, rows):
    """(vec_id, space, vector, day) as a table with extra columns whose names clash with those used inside."""
    import datetime as dt

    day = lambda d: None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    made = [(i, s, i, None, i, 0, None if v is None else [None if x is None else float(x) for x in v], day(d), 1, "c", 2, 3, "u", 4) for i, s, v, d in rows]
    return spark.createDataFrame(made, KINDS)


def dirty(d):
    return [(9001, "s", None, 0), (9002, "s", [0.0] * d, 0), (9003, "s", [1.0] * (d - 1), 0), (9004, "s", [float("nan")] + [1.0] * (d - 1), 0), (9005, "s", [None] + [1.0] * (d - 1), 0), (9006, "gone", [1.0] * d, 0), (9007, "nodim", [1.0], 0), (None, "s", [1.0] * d, 0), (9008, None, [1.0] * d, 0), (9009, "s", [], 0)]


def planted(d=24, groups=(40, 25, 12, 6, 5, 4), loners=30, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for n in groups:
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        out += [(centre + rng.standard_normal(d) * 0.45 / np.sqrt(d)) * rng.uniform(0.5, 5) for _ in range(n)]
    out += [rng.standard_normal(d) * 2 for _ in range(loners)]
    return np.array(out)[rng.permutation(len(out))]


def test_valid_vectors(spark):
    rows = [(1, "s", [1, 2, 3], 2), (1, "s", [4, 5, 6], 1), (2, "s", [-1, 0, 0], 0), (2, "s", [-1, 0, 0], 0), *dirty(3)]
    got = valid_vectors(vectors(spark, rows), spaces(spark, {"s": 3})).collect()
    assert {(r.vec_id, tuple(r.vector)) for r in got} == {(1, (4, 5, 6)), (2, (-1, 0, 0))} and len(got) == 2
    assert valid_vectors(vectors(spark, rows).limit(0), spaces(spark, {"s": 3})).count() == 0


def test_sample_is_bounded_and_stable(spark):
    df = valid_vectors(vectors(spark, [(i, "s", [i + 1, 1], 0) for i in range(300)]), spaces(spark, {"s": 2}))
    one = {r.vec_id for r in sample_rows(df, 50).collect()}
    assert len(one) == 50 and one == {r.vec_id for r in sample_rows(df.repartition(7), 50).collect()}


def brute_knn(x, ids, q, k, metric):
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    at = int(np.flatnonzero(ids == q)[0])
    s = {"cosine": unit(x) @ unit(x[at]), "l2": -((x - x[at]) ** 2).sum(1), "inner_product": x @ x[at]}[metric]
    order = [i for i in np.lexsort((ids, -np.round(s, 9))) if i != at][:k]
    return ids[order].tolist()


@pytest.mark.parametrize("sample,rows_at_once", [(2048, 262_144), (60, 40)])
def test_neighbours_equal_brute_force(spark, monkeypatch, sample, rows_at_once):
    monkeypatch.setattr(neighbours, "ROWS", rows_at_once)
    x = np.vstack([planted(32, (200, 150, 60, 8), 60, 1), planted(32, (30,), 0, 2)[:1].repeat(3, 0)]).astype(np.float32)
    rows = [(i, "s", v, 0) for i, v in enumerate(x)] + [(i + 5000, "t", v[:8], 0) for i, v in enumerate(x[:40])] + dirty(32)
    valid = valid_vectors(vectors(spark, rows), spaces(spark, {"s": 32, "t": 8}))
    asked = [(j, "s", int(i), k, m) for j, (i, k, m) in enumerate((i, k, m) for i in range(0, 479, 37) for k in (1, 10) for m in neighbours.METRICS)]
    asked += [(900, "t", 5003, 100, "l2"), (901, "s", 9001, 5, "l2"), (902, "s", 1, 5, "hamming"), (903, "s", None, 5, "l2"), (904, "s", 1, 0, "l2"), (905, "none", 1, 5, "l2"), asked[0]]
    q = spark.createDataFrame([(*a, "x") for a in asked], "query_id long, space_id string, vec_id long, k int, metric string, vector string")
    got = {}
    for r in neighbours.nearest(valid, q, sample=sample).collect():
        got.setdefault(r.query_id, {})[r.rank_no] = r.vec_id
    ids = np.arange(len(x))
    found = wanted = 0
    for qid, s, v, k, m in asked[:-7]:
        want = brute_knn(x.astype(float), ids, v, k, m)
        found, wanted = found + len(set(want) & set(got[qid].values())), wanted + len(want)
    assert found / wanted >= 0.99 and set(got) == {a[0] for a in asked[:-7]} | {900}
    assert sorted(got[900]) == list(range(39))
    small = neighbours.nearest(valid, q, sample=sample, block=5, spaces=1).collect()
    assert {(r.query_id, r.rank_no, r.vec_id) for r in small} == {(a, b, c) for a, g in got.items() for b, c in g.items()}
    assert neighbours.nearest(valid.limit(0), q).count() == 0 and neighbours.nearest(valid, q.limit(0)).count() == 0


def test_multi_index_equals_scan():
    bits = (RNG.random((500, 40)) < 0.5).astype(np.uint8)
    bits[200:350] = bits[0]
    bits[200:350, :3] ^= (RNG.random((150, 3)) < 0.5).astype(np.uint8)
    index = neighbours.MultiIndex(bits)
    for i in (0, 7, 210):
        for r in (0, 2, 5, 14):
            rows, far = index.within(bits[i], index.words[i], r)
            true = (bits != bits[i]).sum(1)
            assert rows.tolist() == np.flatnonzero(true <= r).tolist() and (far == true[rows]).all()


def test_least_cosine_bounds():
    q = RNG.standard_normal(5)
    x = RNG.standard_normal((400, 5)) * RNG.uniform(0.2, 4, (400, 1))
    nq, nx = np.linalg.norm(q), np.linalg.norm(x, axis=1)
    cos = x @ q / nq / nx
    for metric, value, ok in (("cosine", 0.5, cos >= 0.5), ("l2", 3.0, ((x - q) ** 2).sum(1) <= 3.0), ("inner_product", 1.5, x @ q >= 1.5)):
        least = neighbours.least_cosine(metric, np.array(value), nq, nx, nx)
        assert (cos[ok] >= least[ok] - 1e-9).all()
        whole = neighbours.least_cosine(metric, np.array(value), nq, nx.min(), nx.max())
        assert (cos[ok] >= whole - 1e-9).all()


def brute_clusters(x, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(u)):
        m = u @ u[i] >= 0.5
        for _ in range(5):
            c = u[m].mean(0)
            cs = u @ (c / np.linalg.norm(c))
            m = cs >= 0.75
        if m.sum() >= 5 and not ((cs >= 0.5) & ~m).any():
            out |= {(int(ids[m].min()), int(v)) for v in ids[m]}
    return out


@pytest.mark.parametrize("sample", [2048, 20])
def test_clusters_equal_brute_force(spark, sample):
    """With a tiny sample most groups are found among the rows without an anchor."""
    x = planted(96, (60, 25, 12, 7, 6, 4), 40, 3)
    rows = [(i, "s", v, 0) for i, v in enumerate(x)] + [(3, "s", x[3] * -1, 5)] + [(i + 1000, "t", v[:5], 0) for i, v in enumerate(x[:3])] + dirty(96)
    valid = valid_vectors(vectors(spark, rows), spaces(spark, {"s": 96, "t": 5}))
    got = clusters.similarity_clusters(valid, sample=sample)
    want = brute_clusters(x.astype(np.float32).astype(float), np.arange(len(x)))
    assert {(r.cluster_id, r.vec_id) for r in got.collect()} == want and len({c for c, _ in want}) >= 5
    told = {r.cluster_id: r for r in clusters.describe_clusters(got, valid, 3).collect()}
    assert {c: r["size"] for c, r in told.items()} == {c: sum(1 for a, _ in want if a == c) for c, _ in want}
    big = max(told.values(), key=lambda r: r["size"])
    own = [v for c, v in want if c == big.cluster_id]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert big.typical[0] == max(own, key=lambda v: (u[own] @ u[v]).sum()) and len(big.typical) == 3


def loose(rng, n, d, spread=0.8):
    """n unit vectors with a cosine of 0.75 or more to their mean, not much more."""
    c = rng.standard_normal(d)
    while True:
        x = c / np.linalg.norm(c) + rng.standard_normal((n, d)) * spread / np.sqrt(d)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        m = x.sum(0)
        if (x @ m).min() >= 0.75 * np.linalg.norm(m):
            return x


@pytest.mark.parametrize("block", [clusters.BLOCK, 2000])
def test_lone_rows_of_a_cluster_are_linked(spark, block):
    """Loose groups of five among thousands of loners: each member has a link inside its group, as brute force has."""
    rng = np.random.default_rng(5)
    x = np.vstack([*[loose(rng, 5, 64) for _ in range(40)], rng.standard_normal((6000, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "space_id string, vec_id long, vector array<float>")
    got = {(r.a, r.b) for r in clusters.lone_links(rows, block).collect()}
    cos = np.triu(x @ x.T, 1)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(cos >= clusters.LINK))}
    assert {v for a, b in got if a // 5 == b // 5 and b < 200 for v in (a, b)} == set(range(200))


def test_gathering_from_one_member(spark):
    """Loose groups of five are gathered from a seed that is just one of their members."""
    rng = np.random.default_rng(6)
    x = np.vstack([*[loose(rng, 5, 96) for _ in range(60)], rng.standard_normal((2000, 96))]).astype(np.float32)
    want = {i // 5 for c, i in brute_clusters(x.astype(float), np.arange(len(x))) if i < 300}
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "space_id string, vec_id long, vector array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seeds = spark.createDataFrame([("s", i, unit[i].tolist()) for i in range(0, 300, 5)], "space_id string, label long, unit array<double>")
    mean = np.array([r.unit for r in clusters.gather(rows, seeds, ["s"]).collect()])
    cos = unit @ mean.T
    got = {int(np.flatnonzero(c >= 0.5)[0]) // 5 for c in cos.T if c[c >= 0.5].min() >= 0.75 and (c >= 0.5).sum() == 5}
    assert want <= got and got == set(range(60))


def test_clusters_of_nothing(spark):
    none = valid_vectors(vectors(spark, dirty(4)), spaces(spark, {"s": 4}))
    assert clusters.similarity_clusters(none).count() == 0
    few = valid_vectors(vectors(spark, [(i, "s", np.eye(4)[i], 0) for i in range(4)]), spaces(spark, {"s": 4}))
    assert clusters.similarity_clusters(few).count() == 0
    same = valid_vectors(vectors(spark, [(i, "s", [1, 2, 3, 4], 0) for i in range(6)]), spaces(spark, {"s": 4}))
    assert {(r.cluster_id, r.vec_id) for r in clusters.similarity_clusters(same).collect()} == {(0, i) for i in range(6)}


def test_varied_subset(spark):
    x = planted(16, (150, 20, 10, 5), 15, 4)
    rows = [(i, "s", v, 0) for i, v in enumerate(x)] + [(i + 1000, "t", v, 0) for i, v in enumerate(x[:4])] + dirty(16)
    v, s = vectors(spark, rows), spaces(spark, {"s": 16, "t": 16}, 25)
    got = subset.varied_subset(v, s).collect()
    own = [r for r in got if r.space_id == "s"]
    assert len(own) == 25 and len({r.vec_id for r in own}) == 25 and sum(r.space_id == "t" for r in got) == 4
    cells = {r.cell for r in own}
    per = {c: sorted(r.rank_no for r in own if r.cell == c) for c in cells}
    assert all(p == list(range(1, len(p) + 1)) for p in per.values())
    sizes = sorted(map(len, per.values()))
    assert sizes[-1] - sizes[0] <= 25 and len(cells) <= 25 * subset.ROOM
    every = subset.grid_cells(subset.grid_bins(valid_vectors(v, s).where("space_id = 's'").select("space_id", "vec_id", "vector"))).collect()
    grids = [{str(r.cells[g]) for r in every} for g in range(subset.GRIDS)]
    grid = max(g for g in range(subset.GRIDS) if len(grids[g]) <= 25 * subset.ROOM)
    assert cells <= grids[grid] and len(cells) == min(25, len(grids[grid]))  # every occupied cell is represented, if there are not more than records
    # the bins against numpy
    for r in subset.grid_bins(valid_vectors(v, s).where("space_id = 's'").select("space_id", "vec_id", "vector")).collect():
        y = np.float32(x[r.vec_id])
        for j, (low, high) in enumerate(subset.WINDOWS):
            at = low * 4 + int(np.abs(y[low * 4 : high * 4]).argmax())
            assert [r.bins[g * 3 + j] - (g * 3 + j) * 32 for g in range(6)] == [2 * (at >> (5 - g)) + (y[at] > 0) for g in range(6)]


def test_varied_subset_covers_groups(spark):
    """More groups and loners than uniform samples of the same size, and a smaller share of the largest group."""
    groups = (900, 700, 300, *[12] * 30)
    rng = np.random.default_rng(5)
    label = np.repeat(np.arange(len(groups)), groups)
    centre = rng.standard_normal((len(groups), 64))
    x = np.concatenate([(centre / np.linalg.norm(centre, axis=1)[:, None])[label] + rng.standard_normal((len(label), 64)) * 0.04, rng.standard_normal((60, 64))])
    label = np.concatenate([label, np.full(60, -1)])
    rows = [(i, "s", v, 0) for i, v in enumerate(x)]
    got = label[[r.vec_id for r in subset.varied_subset(vectors(spark, rows), spaces(spark, {"s": 64}, 90)).collect()]]
    figures = lambda own: (len(set(own[own >= 0])), (own < 0).sum(), (own == 0).mean())
    mean = np.mean([figures(label[rng.choice(len(x), 90, False)]) for _ in range(100)], axis=0)
    reached, loners, share = figures(got)
    assert len(got) == 90 and reached >= mean[0] + 3 and loners > 2 * mean[1] and share < mean[2] / 2


def test_varied_subset_of_tiny_vectors(spark):
    rows = [(i, "a", [1.0 if i % 2 else -1.0], 0) for i in range(9)] + [(i + 50, "b", [float(i), 1.0 - i], 0) for i in range(9)] + [(i + 90, "c", [1.0, 1.0, 1.0], 0) for i in range(9)]
    got = subset.varied_subset(vectors(spark, rows), spaces(spark, {"a": 1, "b": 2, "c": 3}, 4)).collect()
    assert sorted(r.space_id for r in got) == ["a"] * 4 + ["b"] * 4 + ["c"] * 4 and len({r.vec_id for r in got}) == 12


def test_varied_subset_of_nothing(spark):
    v, s = vectors(spark, [(1, "s", [1.0] * 16, 0)]), spaces(spark, {"s": 16})
    assert subset.varied_subset(v, spaces(spark, {"s": 16}, None)).count() == 0
    assert subset.varied_subset(v.limit(0), s).count() == 0


def samples(spark, rows):
    import datetime as dt

    made = [(i, s, y, dt.datetime(2024, 1, 1 + d), "x", 1, 2, 3, 4) for i, s, y, d in rows]
    return spark.createDataFrame(made, "sample_id long, split string, y int, ingested_at timestamp, at string, rank_no int, most int, seats int, priority int")


def test_proportions(spark):
    rows = [(i, "train", 0 if i < 300 else 1 if i < 330 else 2, 0) for i in range(335)]
    rows += [(1000, "val", 0, 0), (1001, None, 0, 0), (1002, " Train ", 2, 0), (1003, "train", None, 0), (1004, "train", 99, 0), (None, "train", 0, 0), (0, "train", 1, 3), (5, "train", 0, 0)]
    asks = [(1, 0, 0.2, 0.5, 1), (1, 1, 0.4, 0.5, 1), (1, 2, 0.4, 0.5, 1), (2, 0, 0.99, 0.1, 0), (2, 1, 0.005, 0.1, 4), (2, 2, 0.005, 0.1, 9), (3, 7, 1.0, 0.1, 1), (None, 0, 1.0, 1.0, 1), (4, 0, None, None, None), (5, 0, 1.0, 2.0, 0)]
    requests = spark.createDataFrame([(*a, "x") for a in asks], "target_id long, y int, target_share double, pool_frac double, min_rows long, available string")
    sample, report = proportional.proportional_sample(samples(spark, rows), requests)
    rep = {(r.target_id, r.y): r for r in report.collect()}
    pool = {0: 300, 1: 30, 2: 6}
    assert all(r.available == pool.get(k[1], 0) and r.pool_rows == 336 for k, r in rep.items())
    assert {k for k, r in rep.items() if r.short} == {k for k, (s, f, m) in {(a, b): (s or 0, f or 0, m or 0) for a, b, s, f, m in asks if a}.items() if pool.get(k[1], 0) < max(m, s * f * 336)}
    assert {(r.target_id, r.y) for r in proportional.unmet(samples(spark, rows), requests).collect()} == {k for k, r in rep.items() if r.short}
    assert sum(r.seats for k, r in rep.items() if k[0] == 1) == 168 and rep[1, 1].seats == 30 and rep[1, 2].seats == 6 and rep[1, 0].seats == 132
    assert rep[2, 2].seats == 6 and rep[2, 1].seats >= 4 and sum(r.seats for k, r in rep.items() if k[0] == 2) == 33
    assert rep[3, 7].seats == 0 and rep[4, 0].seats == 0 and rep[5, 0].seats == 300
    got = sample.collect()
    for k, r in rep.items():
        own = [x for x in got if (x.target_id, x.y) == k]
        assert len(own) == r.seats == len({x.sample_id for x in own}) and sorted(x.rank_no for x in own) == list(range(1, r.seats + 1))
    empty, none = proportional.proportional_sample(samples(spark, rows[:1]).limit(0), requests)
    assert empty.count() == 0 and none.where("seats > 0").count() == 0
    assert proportional.proportional_sample(samples(spark, rows), requests.limit(0))[0].count() == 0


def test_seats_equal_sorted_priorities():
    import pandas as pd

    rng = np.random.default_rng(1)
    for _ in range(100):
        k = int(rng.integers(1, 8))
        have, share, floor = rng.integers(0, 60, k), rng.dirichlet(np.ones(k)), rng.integers(0, 5, k)
        size = int(rng.integers(0, 150))
        got = proportional._seats(pd.DataFrame({"y": range(k), "available": have, "target_share": share, "min_rows": floor}), size)
        every = sorted((r > floor[i], (r - 0.5) / share[i], i) for i in range(k) for r in range(1, have[i] + 1))
        lows = sum(1 for e in every if not e[0])
        kept = every[: max(size, lows)]
        assert got.tolist() == [sum(1 for e in kept if e[2] == i) for i in range(k)]
