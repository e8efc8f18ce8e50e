import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import pooling
from orrery.functions.ranking import hash_order, spread_rank
from orrery.operators import align, encode
from orrery.operators.correspondence import Correspondence, correspondence_grid, dataset_view
from orrery.operators.search import SearchIndex
from orrery.operators.space import Space
from orrery.plans.experiment import Experiment, experiments_summary, resolve_benchmark
from orrery.runtime import checked_broadcast, materialize
from orrery.sources import datasets
from orrery.sources.catalog import DiskCatalog, Nexus, content_id, resolve_items
from orrery.streaming.append import append_batches, append_stream, search_stream
from tests.conftest import values

X = np.random.default_rng(4).standard_normal((40, 6))


def test_content_id():
    p = {"b": 1, "a": "x"}
    assert content_id(p) == hashlib.sha256(b'{"a": "x", "b": 1}').hexdigest()


def test_catalog_life(spark, tmp_path):
    catalog = DiskCatalog(spark, str(tmp_path / "c"), "spaces", Space.load)
    assert len(catalog) == 0 and catalog.frame().count() == 0 and not (tmp_path / "c").exists()
    spaces = [Space.from_rows(spark, X[:2], properties={"p1": str(i), "p2": "v"}) for i in range(4)]
    ids = catalog.add_items([(s.properties, s.save) for s in spaces])
    assert ids == [s.item_id for s in spaces] and len(catalog) == 4
    assert catalog.get_item_key(p1="2") == ids[2] and catalog.get_item_key(ids[1][:12]) == ids[1]
    assert catalog.load_item(p1="3").equals(spaces[3]) and len(catalog.load_items(p2="v")) == 4
    assert catalog.get_items_key(p1="none") == [] and catalog.get_items_key(absent=None) == ids[:0] + sorted(ids)
    for error, call in ((KeyError, lambda: catalog.get_item_key(p1="9")), (ValueError, lambda: catalog.get_item_key(p2="v")), (KeyError, lambda: catalog.get_items("zz")), (FileExistsError, lambda: catalog.add_item(spaces[0].properties)), (ValueError, lambda: catalog.add_item({}))):
        with pytest.raises(error):
            call()
    with pytest.raises(FileExistsError):
        catalog.add_items([({"n": 1}, None), (spaces[0].properties, None)])
    assert len(catalog) == 4
    frame = catalog.frame()
    assert {r.item_id for r in resolve_items(frame, p1="1").collect()} == {ids[1]}
    assert resolve_items(frame, ids[0][:10]).count() == 1 and resolve_items(frame, absent=None).count() == 4
    assert len(DiskCatalog(spark, str(tmp_path / "c"), "spaces")) == 4
    with pytest.raises(ValueError):
        DiskCatalog(spark, str(tmp_path / "c"), "decoders")
    catalog.remove_item(p1="0")
    assert len(catalog) == 3
    catalog.clear()
    assert len(catalog) == 0


def test_nexus_is_lazy(spark, tmp_path):
    nexus = Nexus(spark, str(tmp_path / "n"))
    assert not (tmp_path / "n").exists()
    nexus.decoders.add_item({"a": 1})
    assert len(nexus.decoders) == 1 and len(nexus.spaces) == 0
    with pytest.raises(AttributeError):
        nexus.other


def test_correspondences(spark, frame, tmp_path):
    c = Correspondence.from_pairs(spark, [(3, 1), (3, 2), (0, 39)], {"name": "c"})
    got = c.gather(frame(X), frame(X * 2)).orderBy("offset").collect()
    assert np.allclose([r.x for r in got], X[[3, 3, 0]]) and np.allclose([r.y for r in got], X[[1, 2, 39]] * 2)
    c.save(str(tmp_path / "c"))
    back = Correspondence.load(spark, str(tmp_path / "c"))
    assert back.item_id == c.item_id and sorted(back.df.collect()) == sorted(c.df.collect())
    same = Correspondence.identity(spark, 50)
    a, b = same.split(0.3, 1)
    assert a.df.count() == 15 and b.df.count() == 35 and a.df.intersect(b.df).count() == 0
    assert same.random_subset(7, 1).df.count() == 7
    noisy = same.add_noise(0.2, 1).df
    assert noisy.count() == 50 and noisy.select("y_id").distinct().count() == 50 and noisy.where("x_id <> y_id").count() == 10
    assert correspondence_grid(spark, ["a", "b"], ["a", "b", "c"], [0.0, 0.5], ["train", "test"]).count() == 24
    data = spark.createDataFrame([(i, "train" if i < 5 else "test") for i in range(10)], "sample_id long, split string")
    assert dataset_view(data, {"x": frame(X), "y": frame(X[:3])}, "train").count() == 3


def test_spread_rank_is_row_number(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g int").withColumn("at", hash_order(5, "i"))
    got = {r.i: r.n for r in spread_rank(df, ["g"], "at", "n", ["i"]).collect()}
    key = lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i)
    for g in (None, 0, 1, 2):
        own = sorted((i for i, x in rows if x == g), key=key)
        assert [got[i] for i in own] == list(range(1, len(own) + 1))
    assert spread_rank(df.limit(0), ["g"], "at", "n").count() == 0


def test_broadcast_is_checked(spark):
    hint = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(checked_broadcast(spark.range(5), 5)) and not hint(checked_broadcast(spark.range(6), 5))
    assert materialize(spark.range(3)).count() == 3


def test_pooling(spark):
    tok = np.random.default_rng(0).standard_normal((3, 5, 4))
    mask = np.array([[True, False, True, True, False], [False] * 5, [True] * 5])
    df = spark.createDataFrame([(i, i % 2, tok[i].tolist(), mask[i].tolist()) for i in range(3)], "id long, layer int, tokens array<array<double>>, mask array<boolean>")
    mean = values(pooling.pool_layers(df, "tokens", "mask", "mean"), on="id")
    assert np.allclose(mean[[0, 2]], [tok[0][mask[0]].mean(0), tok[2].mean(0)]) and np.isnan(mean[1]).all()
    assert np.allclose(values(pooling.pool_layers(df, "tokens", "mask", "sum"), on="id"), [tok[i][mask[i]].sum(0) for i in range(3)])
    assert np.allclose(values(pooling.pool_layers(df, "tokens", "mask", "cls"), on="id"), tok[:, 0])
    assert [len(r.vector) for r in pooling.pool_layers(df, "tokens", "mask", "token").orderBy("id").collect()] == [3, 0, 5]
    assert pooling.pool_layers(df, "tokens", "mask", "sum", [1]).count() == 1
    with pytest.raises(KeyError):
        pooling.pool_layers(df, "tokens", "mask", "none")


def test_datasets(spark, tmp_path):
    raw = spark.createDataFrame([(i, ["train", "test", "unsupervised"][i % 3], f" t{i}", f'"\t body {i} \n"', i % 2) for i in range(60)], "id long, split string, title string, content string, label int")
    made = datasets.process("dbpedia_14", raw, 0.5)
    assert made.df.groupBy("split").count().where("count <> 10").count() == 0
    assert made.df.where("x not like '% t%. body __' and x not like '% t%. body _'").count() == 0
    assert {r[0] for r in made.df.where("split = 'train'").select("sample_id").collect()} == set(range(10))
    assert made.df.schema["x"].metadata["data_type"] == "text" and made.get_feature("y").data_type == datasets.DataType.LABEL
    made.save(str(tmp_path / "d"))
    back = datasets.Dataset.load(spark, str(tmp_path / "d"))
    assert back.metadata == made.metadata and back.df.count() == 30
    with pytest.raises(FileExistsError):
        made.save(str(tmp_path / "d"))
    with pytest.raises(KeyError):
        made.get_feature("z")
    for bad in ({"perc": 0}, {"features": []}, {"features": [datasets.Feature("gone", datasets.DataType.TEXT)]}):
        with pytest.raises(ValueError):
            datasets.Dataset("d", **({"df": made.df, "features": made.features} | bad))
    imdb = datasets.imdb(raw.withColumn("text", F.col("title"))).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in imdb} == {"train": 18, "val": 2, "test": 20}
    assert datasets.class_names(raw, "label") == ["0", "1"]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"abc")
    assert datasets.read_images(spark, str(tmp_path)).first().image == b"abc"


def test_encoders_and_decoders(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word{i % 2} tail{i % 2}" if i else None, i % 2) for i in range(40)], "sample_id long, text string, label int")
    one = encode.encode_feature(rows, "text", encode.HashingEncoder(80), "mean")
    assert one.where(F.size("vector") != 80).where("offset > 0").count() == 0 and len({tuple(r.vector) for r in one.where("offset > 1").collect()}) == 2
    path = str(tmp_path / "s")
    encode.add_encoding(one.where("offset < 20"), path)
    encode.add_encoding(one.where("offset >= 20"), path)
    assert spark.read.parquet(f"{path}/vectors").count() == 40
    load = lambda: lambda values: np.array([[len(v or ""), 1.0] for v in values])
    assert encode.encode_feature(rows, "text", encode.BatchEncoder(load)).where("offset = 1").first().vector == [11.0, 1.0]
    data = one.where("offset > 0").join(rows.select(F.col("sample_id").alias("offset"), "label"), "offset").cache()
    for kind in ("linear", "svc", "deep"):
        model = encode.Classifier(2, 80, kind, max_iter=10).fit(data)
        assert model.score(data)["accuracy"] == 1.0
        assert data.count() == model.scores(data).where(F.size("scores") == 2).count()
    model, scores = encode.fit_decoder(data, data, 2, DiskCatalog(spark, str(tmp_path / "dec"), "decoders"), {"space": "s"}, max_iter=5)
    assert scores["accuracy"] == 1.0
    again = encode.Classifier(2).load(DiskCatalog(spark, str(tmp_path / "dec"), "decoders").get_item_path(space="s") + "/model")
    assert encode.StitchedModel(lambda d: d, again).predict(data).where("prediction <> label").count() == 0


def test_experiments(spark, frame):
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((6, 6)))[0]
    x, y = Space(frame(X), {"name": "x"}), Space(frame(X @ q), {"name": "y"})
    same = Correspondence.identity(spark, 40)
    labels = frame(X).select("offset", (F.get("vector", F.lit(0)) > 0).cast("int").alias("label"))
    decoder = encode.Classifier(2, max_iter=20).fit(y.df.join(labels, "offset"))
    one = Experiment(x, y, same, align.Translator(align.MatrixAligner("svd")), x, y, same, ["l2", "cosine"], decoder, labels, ["accuracy"])
    got = {r.metric: r.score for r in one.run().collect()}
    assert got["l2"] < 1e-8 and got["cosine"] == pytest.approx(1) and got["accuracy"] > 0.9
    wide = one.export(one.run(), {"x_fit": ["name", "gone"], "metric": ["name"], "score": []})
    assert wide.columns == ["x_fit/name", "x_fit/gone", "metric/name", "score"] and wide.first()[0] == "x"
    with pytest.raises(ValueError):
        Experiment(x, y, same, one.estimator, x, y, same, y_decoder=decoder)


def test_resolver_takes_every_policy(spark):
    items = lambda ps: spark.createDataFrame([(content_id(p), json.dumps(p, sort_keys=True)) for p in ps], "item_id string, properties string")
    corr = items([{"x_dataset": "a", "y_dataset": "b", "split": s, "quality": q} for s in ("train", "test") for q in (0, 1)])
    spaces = items([{"dataset": d, "split": s, "layer": n} for d in "ab" for s in ("train", "test") for n in (1, 2)])
    policy = {"estimators": ["svd"], "correspondence_constraints": {"quality": 0}, "space_constraints": {"layer": 1}, "fit": {"split": "train"}, "tests": [{"split": "test", "x_space_constraints": {"layer": 2}}]}
    got = resolve_benchmark(corr, spaces, [policy, policy | {"estimators": ["lstsq", "cca"], "space_constraints": {}}], {"latent": ["l2"], "downstream": ["f1", "accuracy"]})
    assert got.where("estimator = 'svd'").count() == 3 and got.where("estimator <> 'svd'").count() == 2 * 2 * 1 * 2 * 2 * 3
    row = experiments_summary(got).first()
    assert row.experiments == got.count() and row.estimators == 3 and row.metrics == 3
    assert resolve_benchmark(corr, spaces, [], {"latent": ["l2"]}).count() == 0


def test_streams(spark, frame, tmp_path):
    source = str(tmp_path / "in")
    frame(X[:20]).write.parquet(source)
    stream = spark.readStream.schema("offset long, key string, vector array<double>").parquet(source)
    append_stream(stream, str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    append_batches(stream, str(tmp_path / "b"), str(tmp_path / "cb")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a/vectors")).count() == spark.read.parquet(str(tmp_path / "b/vectors")).count() == 20
    queries = stream.select(F.col("offset").alias("query_id"), "vector")
    search_stream(queries, SearchIndex(frame(X), "l2"), 2, str(tmp_path / "o"), str(tmp_path / "co")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 40 and got.where("rank = 0 and query_id <> offset").count() == 0
    frame(X[20:25]).selectExpr("offset + 20 as offset", "key", "vector").write.mode("append").parquet(source)
    append_stream(stream, str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a/vectors")).count() == 25


def test_class_names_are_whole_or_an_error(spark):
    many = spark.range(10_001).selectExpr("'train' as split", "id as label")
    with pytest.raises(ValueError):
        datasets.class_names(many, "label")
    most = many.where("label < 10000").unionByName(spark.sql("select 'train' as split, cast(null as long) as label"))
    assert datasets.class_names(most, "label") == sorted(str(i) for i in range(10_000))
