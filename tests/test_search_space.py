import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import sampling, search
from orrery.operators.space import READERS, Space, reader
from tests.conftest import values

X = np.random.default_rng(2).standard_normal((100, 10)) * np.arange(1, 101)[:, None] / 20
X[7] = X[3]


def brute(metric, q, k):
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    score = {"l2": ((X - q) ** 2).sum(1), "euclidean": ((X - q) ** 2).sum(1), "cosine": -(unit(X) @ unit(q)), "inner_product": -(X @ q), "l1": np.abs(X - q).sum(1), "linf": np.abs(X - q).max(1)}[metric]
    return np.lexsort((np.arange(100), np.round(score, 9)))[:k].tolist()


@pytest.mark.parametrize("metric", list(search.METRICS))
def test_knn_equals_brute_force(frame, metric):
    got = search.SearchIndex(frame(X), metric).search_knn(5, query_offsets=[0, 3, 50], digits=9).orderBy("query_id", "rank").collect()
    for i, at in enumerate((0, 3, 50)):
        assert [r.offset for r in got if r.query_id == i] == brute(metric, X[at], 5)


def test_sql_and_kernel_agree(spark, frame):
    df = frame(X)
    q = df.where("offset % 20 = 0").select(F.col("offset").alias("query_id"), "vector")
    one = search.SearchIndex(df, "l2").search_knn(4, queries=q, digits=6).select("query_id", "rank", "offset").collect()
    two = search.knn_sql(df, q, 4, "l2").select("query_id", "rank", "offset").collect()
    assert sorted(one) == sorted(two)


def test_results_per_query(frame):
    got = search.per_query(search.SearchIndex(frame(X, key_prefix="k"), "l2").search_knn(3, query_offsets=[50], digits=9)).first()
    assert got.offsets == brute("l2", X[50], 3) and got.keys[0] == "k50" and got.distances[0] == 0


def test_blocks_of_queries(frame, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    got = search.SearchIndex(frame(X), "l2").search_knn(1, query_offsets=list(range(20)), digits=9).collect()
    assert {(r.query_id, r.offset) for r in got} == {(i, 3 if i == 7 else i) for i in range(20)}


def test_range_finds_itself_and_is_strict(frame):
    index = search.SearchIndex(frame(X), "l2")
    rows = index.search_range(30.0, query_offsets=[5]).orderBy("rank").collect()
    d = ((X - X[5]) ** 2).sum(1)
    assert rows[0].offset == 5 and {r.offset for r in rows} == set(np.flatnonzero(d < 30).tolist())
    assert index.search_range(0.0, query_offsets=[5]).count() == 0
    assert index.search_range(30.0, query_offsets=[5], sort=False).count() == len(rows)
    cosine = search.SearchIndex(frame(X), "cosine").search_range(0.5, query_offsets=[5]).orderBy("rank").collect()
    assert cosine[0].offset == 5 and all(r.distance > 0.5 for r in cosine)


def test_keys_and_point_access(spark, frame):
    index = search.SearchIndex(frame(X, key_prefix="k"), "l2")
    assert "k4" in index and "z" not in index and index.num_elements == 100 and index.num_dimensions == 10
    assert np.allclose(index.vector(key="k4"), X[4]) and np.allclose(index.vector(offset=4), X[4])
    got = index.vectors(keys=["k9", "k1", "k9"]).orderBy("pos").collect()
    assert [r.offset for r in got] == [9, 1, 9]
    near = index.search_knn(2, query_keys=["k3"], digits=9).orderBy("rank").collect()
    assert [r.key for r in near] == ["k3", "k7"]
    for bad in ({}, {"offset": 1, "key": "k1"}):
        with pytest.raises(ValueError):
            index.vector(**bad)
    with pytest.raises(KeyError):
        index.vector(key="none")
    with pytest.raises(ValueError):
        index.search_knn(3)


def test_cosine_is_inner_product_of_units(frame):
    unit = X / np.linalg.norm(X, axis=1, keepdims=True)
    a = search.SearchIndex(frame(X), "cosine").search_knn(5, queries=X[:3], transform=True, digits=9).select("query_id", "rank", "offset").collect()
    b = search.SearchIndex(frame(unit), "inner_product").search_knn(5, queries=unit[:3], digits=9).select("query_id", "rank", "offset").collect()
    assert sorted(a) == sorted(b)


def test_growing_and_saving(spark, frame, tmp_path):
    index = search.SearchIndex.create(spark, "cosine").add_rows(X[:10], [f"a{i}" for i in range(10)]).add_rows(X[10:12], ["b0", "b1"])
    index.check()
    assert index.num_elements == 12 and index.vectors(keys=["b1"]).first().offset == 11
    with pytest.raises(KeyError):
        index.add_rows(X[:1], ["b0"])
    with pytest.raises(KeyError):
        index.add_rows(X[:2], ["c", "c"])
    index.save(str(tmp_path / "i"))
    back = search.SearchIndex.load(spark, str(tmp_path / "i"))
    assert back.metadata == index.metadata and np.allclose(values(back.df), values(index.df))
    with pytest.raises(NotImplementedError):
        search.SearchIndex(frame(X), "cosine", transform="l1_normalize")


def test_few_rows_and_ties(frame):
    assert search.SearchIndex(frame(X[:3]), "l2").search_knn(10, query_offsets=[0]).count() == 3
    same = search.SearchIndex(frame(np.ones((6, 4))), "l2").search_knn(3, query_offsets=[4], digits=9).orderBy("rank").collect()
    assert [r.offset for r in same] == [0, 1, 2]
    assert search.SearchIndex(frame(np.zeros((0, 3))), "l2").search_knn(3, queries=[[1.0, 2, 3]]).count() == 0


def test_space(spark, frame, tmp_path):
    space = Space.from_rows(spark, X, [f"k{i}" for i in range(100)], {"name": "one"})
    space.validate()
    assert space.shape == (100, 10) and space.name == "one" and np.allclose(space[4], X[4])
    assert np.allclose(values(space[[5, 2, 5]].df), X[[5, 2, 5]]) and np.allclose(values(space[2:9:3].df), X[2:9:3])
    assert np.allclose(space.get_vector_by_key("k8"), X[8]) and len(list(space)) == 100
    grown = space.add_vectors(Space.from_rows(spark, X[:2], ["n0", "n1"]).df)
    assert len(grown) == 102 and np.allclose(grown[101], X[1])
    for bad in (["k1", "n"], ["n", "n"]):
        with pytest.raises(KeyError):
            space.add_vectors(Space.from_rows(spark, X[:2], bad).df)
    with pytest.raises(ValueError):
        space.add_vectors(Space.from_rows(spark, X[:2]).df)
    assert space.equals(space.like()) and not space.equals(grown)
    space.save(str(tmp_path / "s"))
    assert Space.load(spark, str(tmp_path / "s")).equals(space)
    space.save_key_tsv(str(tmp_path / "t/vectors"))
    assert READERS["key_tsv"](spark, str(tmp_path / "t/vectors")).where("key = 'k3'").first().offset == 3
    with pytest.raises(ValueError):
        reader("parquet")(None)
    with pytest.raises(ValueError):
        Space(frame(np.vstack([X[:2]])).unionByName(frame(X[:1]))).validate()
    assert space.to_index("cosine").search_knn(1, query_keys=["k5"]).first().key == "k5"
    assert space.compare(space, metrics=["l2"]).first().l2 == 0


def test_samples(frame):
    df = frame(X, key_prefix="k")
    a, b = sampling.Uniform(1)(df, df, n=30)
    assert a.count() == 30 and sorted(a.select("offset").collect()) == sorted(b.select("offset").collect())
    assert a.where("key is null").count() == 0
    for n in (0, 101):
        with pytest.raises(ValueError):
            sampling.Uniform(1)(df, n=n)
    with pytest.raises(ValueError):
        sampling.Uniform(1)(df, df.limit(3), n=2)
    parts = sampling.train_val_split(df.withColumnRenamed("offset", "id"), 0.1)
    assert parts.where("part = 'val'").count() == 10
    grouped = sampling.stratified_sample(df.withColumn("g", F.col("offset") % 3), 4, "g")
    assert {r["count"] for r in grouped.groupBy("g").count().collect()} == {4}


def test_dense_offsets(frame):
    got = search.dense_offsets(frame(X).withColumn("o", F.pmod(F.col("offset") * 37, F.lit(100))).drop("offset"), "o", 5, slices=7)
    assert all(r.offset == r.o + 5 for r in got.collect())
