"""The queries of the driver contract: every operator of the engine over whole tables.

`x` is the embeddings table with norms from 1 to 7, `y` a second space of another width, paired with x by id. Floats are
rounded to 6 digits. Searches take as queries the rows whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import pooling, vec
from orrery.operators import align, encode, measures, projection, sampling, search
from orrery.operators import transforms as t
from orrery.operators.correspondence import Correspondence, correspondence_grid, dataset_view
from orrery.operators.kernels import apply_matrix
from orrery.operators.space import Space
from orrery.plans import experiment
from orrery.runtime import checked_broadcast, table
from orrery.sources import catalog, datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K, RADIUS_L2, RADIUS_COSINE = 5, 9.0, 0.35
PERMUTATION = [(5 * j + 3) % 64 for j in range(64)]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- inputs -----------------------------------------------------------------------------------------------------------------


def x(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda a: a * (1 + F.col("vec_id") % 7))
    return e.select(F.col("vec_id").alias("offset"), F.concat(F.lit("k"), F.col("vec_id")).alias("key"), v.alias("vector"), "label")


def y(spark: SparkSession, sf: str) -> DataFrame:
    rows = x(spark, sf)
    back = F.transform("vector", lambda a: a / (1 + F.col("offset") % 7))
    v = F.transform(F.reverse(F.slice(back, 1, 48)), lambda a: a * (1 + F.col("offset") % 3) + F.lit(0.1) * F.col("label"))
    return rows.withColumn("vector", v)


def width(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("vector", vec.head("vector", n))


def asked(spark: SparkSession, sf: str, on: str = "offset") -> DataFrame:
    """(pos, offset | key) of the query rows."""
    return x(spark, sf).where("offset % 100 = 0").select(F.col("offset").alias("pos"), on)


def num(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def long(df: DataFrame, vector: str = "vector", on: str = "offset") -> DataFrame:
    """(id, i, x): one row per element."""
    return df.select(F.col(on).alias("id"), F.posexplode(vector).alias("i", "e")).select("id", "i", num("e").alias("x"))


def found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", F.col("offset").alias("nbr"), num("distance").alias("distance"))


def state(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """(i, j, value) of a small fitted matrix."""
    m = np.atleast_2d(values)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, v double").select("i", "j", num("v").alias("value"))


# -- search -----------------------------------------------------------------------------------------------------------------


def _knn(metric: str):
    def run(spark, sf):
        return found(search.SearchIndex(x(spark, sf), metric).search_knn(K, query_offsets=asked(spark, sf), digits=6))

    return run


for _m in ("l2", "cosine", "inner_product", "l1", "linf"):
    QUERIES[f"knn_{_m}"] = _knn(_m)


@query
def knn_by_key(spark, sf):
    return search.SearchIndex(x(spark, sf), "l2").search_knn(K, query_keys=asked(spark, sf, "key"), digits=6).select("query_id", "rank", F.col("key").alias("nbr_key"), num("distance").alias("distance"))


@query
def knn_sql_plan(spark, sf):
    rows = x(spark, sf)
    return found(search.knn_sql(rows, rows.where("offset % 100 = 0").select(F.col("offset").alias("query_id"), "vector"), K, "l2"))


@query
def knn_cosine_untransformed_query(spark, sf):
    q = x(spark, sf).where("offset % 100 = 0").select(F.col("offset").alias("query_id"), "vector")
    return found(search.SearchIndex(x(spark, sf), "cosine").search_knn(K, queries=q, digits=6))


@query
def knn_cosine_transformed_query(spark, sf):
    q = x(spark, sf).where("offset % 100 = 0").select(F.col("offset").alias("query_id"), "vector")
    return found(search.SearchIndex(x(spark, sf), "cosine").search_knn(K, queries=q, transform=True, digits=6))


@query
def range_l2(spark, sf):
    return found(search.SearchIndex(x(spark, sf), "l2").search_range(RADIUS_L2, query_offsets=asked(spark, sf))).drop("rank")


@query
def range_cosine(spark, sf):
    return found(search.SearchIndex(x(spark, sf), "cosine").search_range(RADIUS_COSINE, query_offsets=asked(spark, sf))).drop("rank")


@query
def range_by_key(spark, sf):
    return search.SearchIndex(x(spark, sf), "l2").search_range(RADIUS_L2, query_keys=asked(spark, sf, "key"), sort=False).select("query_id", F.col("key").alias("nbr_key"), num("distance").alias("distance"))


@query
def get_vectors_by_offset(spark, sf):
    return long(search.SearchIndex(x(spark, sf), "cosine").vectors(offsets=asked(spark, sf)), on="pos")


@query
def get_vectors_by_key(spark, sf):
    return long(search.SearchIndex(x(spark, sf), "l2").vectors(keys=asked(spark, sf, "key")), on="pos")


@query
def contains_keys(spark, sf):
    """Whether each key of a list that runs past the index is held."""
    rows = x(spark, sf)
    return search.SearchIndex(rows, "l2").contains(rows.select(F.concat(F.lit("k"), F.col("offset") * 2).alias("key"))).select("key", "held")


@query
def index_append_offsets(spark, sf):
    index = search.SearchIndex(x(spark, sf), "l2").add(x(spark, sf).withColumn("key", F.concat(F.lit("new"), F.col("offset"))))
    return index.df.select(F.col("offset").alias("id"), "key", num(F.get("vector", F.lit(0))).alias("first"))


@query
def space_append(spark, sf):
    space = Space(x(spark, sf)).add_vectors(x(spark, sf).withColumn("key", F.concat(F.lit("new"), F.col("offset"))))
    return space.df.select(F.col("offset").alias("id"), "key", num(vec.norm("vector")).alias("norm"))


@query
def space_slice(spark, sf):
    return long(Space(x(spark, sf))[10:400:3].df)


@query
def space_introspection(spark, sf):
    return x(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("dim"), F.countDistinct("key").alias("keys"))


# -- transforms -------------------------------------------------------------------------------------------------------------


def _transform(make: Callable[[], t.Transform], inverse: bool = False):
    def run(spark, sf):
        rows = x(spark, sf)
        fitted = make().fit(rows)
        return long(fitted.inverse_transform(rows) if inverse else fitted.transform(rows))

    return run


def _round_trip(make: Callable[[], t.Transform]):
    def run(spark, sf):
        rows = x(spark, sf)
        fitted = make().fit(rows)
        return long(fitted.inverse_transform(fitted.transform(rows)))

    return run


_TRANSFORMS: dict[str, Callable[[], t.Transform]] = {"centering": t.Centering, "std_scaling": t.STDScaling, "standard_scaling": t.StandardScaling}
for _n, _c in _TRANSFORMS.items():
    QUERIES[_n] = _transform(_c)
    QUERIES[f"{_n}_inverse"] = _transform(_c, True)
    QUERIES[f"{_n}_roundtrip"] = _round_trip(_c)
QUERIES["random_isometry_roundtrip"] = _round_trip(lambda: t.RandomIsometry(3))
QUERIES["random_permutation_roundtrip"] = _round_trip(lambda: t.RandomDimensionPermutation(3))
QUERIES["sequence_roundtrip"] = _round_trip(lambda: t.TransformSequence([t.Centering(), t.IsotropicScaling(3.0), t.RandomDimensionPermutation(1)]))
for _p in (1, 2, 3):
    QUERIES[f"lp_norm_p{_p}"] = _transform(lambda p=_p: t.LPNorm(p))
QUERIES["mean_lp_norm"] = _transform(t.MeanLPNorm)
QUERIES["mean_lp_norm_inverse"] = _transform(t.MeanLPNorm, True)
QUERIES["isotropic_scaling"] = _transform(lambda: t.IsotropicScaling(2.5))
QUERIES["isotropic_scaling_inverse"] = _transform(lambda: t.IsotropicScaling(2.5), True)


@query
def std_handle_zeros(spark, sf):
    rows = x(spark, sf).withColumn("vector", F.transform("vector", lambda a, i: F.when(i == 0, 3.0).otherwise(a)))
    return long(t.STDScaling().fit_transform(rows))


@query
def dim_permutation(spark, sf):
    return long(x(spark, sf).withColumn("vector", t.dimension_permutation(F.col("vector"), PERMUTATION)))


@query
def dim_permutation_inverse(spark, sf):
    return long(x(spark, sf).withColumn("vector", t.dimension_permutation_inverse(F.col("vector"), PERMUTATION)))


def rotation() -> np.ndarray:
    m = np.eye(64)
    c = np.sqrt(0.5)
    m[:2, :2] = [[c, c], [-c, c]]
    return m


@query
def isometry_apply(spark, sf):
    return long(apply_matrix(x(spark, sf), "vector", rotation()))


@query
def isometry_inverse(spark, sf):
    return long(apply_matrix(x(spark, sf), "vector", rotation().T))


# -- relative projections ---------------------------------------------------------------------------------------------------


def _relative(name: str, **params):
    def run(spark, sf):
        rows = x(spark, sf)
        return long(projection.relative_projection(rows, rows.where("offset < 10"), name, **params))

    return run


for _n, _args in {"cosine": {}, "angular": {}, "l1": {}, "euclidean": {}}.items():
    QUERIES[f"rel_{_n}"] = _relative(_n, **_args)
QUERIES["rel_lp10"] = _relative("lp", p=10)


@query
def rel_cob_2anchors(spark, sf):
    rows = x(spark, sf)
    return long(projection.relative_projection(rows, rows.where("offset < 2"), "CoB"))


@query
def rel_pipeline_centered_cosine(spark, sf):
    rows = x(spark, sf)
    return long(projection.RelativeProjection("cosine", abs_transform=t.Centering()).fit(rows.where("offset < 10")).transform(rows))


# -- alignment --------------------------------------------------------------------------------------------------------------


@query
def zero_padding(spark, sf):
    return long(align.ZeroPadding().fit(48, 64).transform(x=y(spark, sf))[0])


@query
def zero_padding_inverse(spark, sf):
    pad = align.ZeroPadding().fit(48, 64)
    return long(pad.inverse_transform(x=pad.transform(x=y(spark, sf))[0])[0])


@query
def procrustes_2d(spark, sf):
    return state(spark, align.MatrixAligner("svd").fit(width(x(spark, sf), 2), width(y(spark, sf), 2)).state["matrix"])


@query
def lstsq_2d(spark, sf):
    return state(spark, align.MatrixAligner("lstsq").fit(width(x(spark, sf), 2), width(y(spark, sf), 2)).state["matrix"])


@query
def translate_2d(spark, sf):
    """Rows of x in y's coordinates by the 2-D orthogonal map."""
    return long(align.translate(width(x(spark, sf), 2), width(y(spark, sf), 2), "svd"))


@query
def svd_align(spark, sf):
    return long(align.translate(x(spark, sf), y(spark, sf), "svd"))


@query
def procrustes(spark, sf):
    return long(align.procrustes().fit(x(spark, sf), y(spark, sf)).transform(x(spark, sf)))


@query
def lstsq_align(spark, sf):
    return long(align.MatrixAligner("lstsq").fit(x(spark, sf), y(spark, sf)).transform(x(spark, sf)))


@query
def lstsq_ortho_align(spark, sf):
    return long(align.MatrixAligner("lstsq_ortho").fit(x(spark, sf), y(spark, sf)).transform(x(spark, sf)))


@query
def sgd_affine_align(spark, sf):
    return long(align.SGDAffineAligner(num_steps=100).fit(x(spark, sf), y(spark, sf)).transform(x(spark, sf)))


@query
def certify_procrustes_orthogonal(spark, sf):
    """R'R of the fitted matrix."""
    r = align.MatrixAligner("svd").fit(width(x(spark, sf), 48), y(spark, sf)).state["matrix"]
    return state(spark, r.T @ r)


@query
def certify_lstsq_normal_eq(spark, sf):
    """X'(XW - Y) of the fitted map, from the rows."""
    pairs = align.pair(x(spark, sf), y(spark, sf))
    w = align.MatrixAligner("lstsq").fit_pairs(pairs).state["matrix"]
    rest = apply_matrix(pairs, "x", w, out="fit").select("x", vec.sub("fit", "y").alias("r"))
    m = rest.select(F.posexplode("x").alias("i", "a"), "r").select("i", "a", F.posexplode("r").alias("j", "b"))
    return m.groupBy("i", "j").agg(num(F.sum(F.col("a") * F.col("b"))).alias("value"))


# -- measures ---------------------------------------------------------------------------------------------------------------


def _measure(name: str):
    def run(spark, sf):
        got = measures.compare(width(x(spark, sf), 48), y(spark, sf), metrics=[name])
        return got.select(num(name).alias("value"))

    return run


for _m in ("l2", "l1", "cosine", "mse", "l1_loss", "trace"):
    QUERIES[f"metric_{_m}"] = _measure(_m)


@query
def compare_many(spark, sf):
    """Several metrics of one space against two others, a row for each."""
    got = measures.compare(width(x(spark, sf), 48), y(spark, sf), width(x(spark, sf), 48), metrics=["l2", "cosine"])
    return got.select("other", num("l2").alias("l2"), num("cosine").alias("cosine"))


@query
def cka_linear(spark, sf):
    return spark.createDataFrame([(measures.linear_cka(x(spark, sf), y(spark, sf)),)], "v double").select(num("v").alias("value"))


@query
def cka_rbf(spark, sf):
    return spark.createDataFrame([(measures.rbf_cka(x(spark, sf), y(spark, sf)),)], "v double").select(num("v").alias("value"))


@query
def cka_rbf_sigma(spark, sf):
    return spark.createDataFrame([(measures.rbf_cka(x(spark, sf), y(spark, sf), sigma=3.0),)], "v double").select(num("v").alias("value"))


@query
def svcca_1d(spark, sf):
    return spark.createDataFrame([(measures.svcca(width(x(spark, sf), 1), width(y(spark, sf), 1)),)], "v double").select(num("v").alias("value"))


@query
def svcca_64d(spark, sf):
    return spark.createDataFrame([(measures.svcca(x(spark, sf), y(spark, sf), robust=True),)], "v double").select(num("v", 4).alias("value"))


@query
def accuracy_argmax(spark, sf):
    """Of the first 10 dimensions as class scores."""
    return measures.accuracy(width(x(spark, sf), 10), "vector", "label").select(num("accuracy").alias("value"))


@query
def label_counts(spark, sf):
    return x(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# -- samples ----------------------------------------------------------------------------------------------------------------


@query
def uniform_sample(spark, sf):
    (one,) = sampling.Uniform(42)(x(spark, sf), n=50)
    return one.select(F.col("offset").alias("id"), "key")


@query
def uniform_sample_paired(spark, sf):
    a, b = sampling.Uniform(42)(x(spark, sf), y(spark, sf), n=50)
    return align.pair(a, b).select(F.col("offset").alias("id"), num(F.get("x", F.lit(0))).alias("x"), num(F.get("y", F.lit(0))).alias("y"))


@query
def stratified_sample(spark, sf):
    return sampling.stratified_sample(x(spark, sf), 5, "label", 42).select(F.col("offset").alias("id"), "label")


def _records(spark, sf) -> DataFrame:
    """One row for each sample id, with a clean split."""
    rows = table(spark, sf, "samples").groupBy("sample_id").agg(F.min(F.struct("ingested_at", "split", "title", "x", "y", "source")).alias("r"))
    return rows.select(F.col("sample_id").alias("id"), F.lower(F.trim("r.split")).alias("split"), F.col("r.title").alias("title"), F.col("r.x").alias("content"), F.col("r.y").alias("label"), F.col("r.source").alias("source"))


@query
def dataset_subset(spark, sf):
    return sampling.subset(_records(spark, sf), 0.25).select("id", "split", "sample_id")


@query
def train_val_split(spark, sf):
    return sampling.train_val_split(_records(spark, sf)).select("id", "part")


# -- pairings, catalog and plans --------------------------------------------------------------------------------------------


@query
def correspondence_gather(spark, sf):
    ids = x(spark, sf).select(F.col("offset").alias("pos"), ((F.col("offset") * 3) % 100).alias("x_id"), (F.col("offset") % 77).alias("y_id"))
    got = Correspondence(ids).gather(x(spark, sf), y(spark, sf))
    return got.select(F.col("offset").alias("id"), num(F.get("x", F.lit(0))).alias("x"), num(F.get("y", F.lit(0))).alias("y"))


@query
def identity_correspondence(spark, sf):
    n = x(spark, sf).count()
    got = Correspondence.identity(spark, n).gather(x(spark, sf), y(spark, sf))
    return got.select(F.col("offset").alias("id"), num(vec.norm("x")).alias("x"), num(vec.norm("y")).alias("y"))


@query
def correspondence_noise(spark, sf):
    """A tenth of the pairs is shifted; every row stays paired once on either side."""
    got = Correspondence.identity(spark, x(spark, sf).count()).add_noise(0.1, 7).df
    return got.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("x_id").alias("xs"), F.countDistinct("y_id").alias("ys"), F.sum((F.col("x_id") != F.col("y_id")).cast("long")).alias("moved"))


@query
def dataset_view_join(spark, sf):
    """Documents beside the vectors of two spaces."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source", "n_chars")
    got = dataset_view(docs, {"x": x(spark, sf), "y": y(spark, sf)})
    return got.select("sample_id", "source", "n_chars", num(vec.norm("x")).alias("x"), num(vec.norm("y")).alias("y"))


def _catalog(spark, sf) -> DataFrame:
    return table(spark, sf, "spaces").select(F.col("space_id").alias("item_id"), F.col("properties_json").alias("properties"), "dim", "n_rows")


@query
def catalog_ids(spark, sf):
    """Whether each item's id is the hash of its properties."""
    return _catalog(spark, sf).select("item_id", (F.sha2("properties", 256) == F.col("item_id")).alias("ok"))


@query
def catalog_prefix_lookup(spark, sf):
    items = _catalog(spark, sf)
    first = items.agg(F.min("item_id").alias("m"))
    prefix = F.substring("m", 1, 1)
    return items.join(F.broadcast(first), F.col("item_id").startswith(prefix)).select("item_id", "dim")  # one row


@query
def catalog_property_filter(spark, sf):
    return catalog.resolve_items(_catalog(spark, sf), dataset="dbpedia_like", pool="mean").select("item_id", "n_rows")


@query
def catalog_absent_property(spark, sf):
    return catalog.resolve_items(_catalog(spark, sf), pool=None).select("item_id")


@query
def catalog_add_conflicts(spark, sf):
    """Of all items with another seed or their own, those that exist."""
    items = _catalog(spark, sf)
    other = items.select(F.regexp_replace("properties", '"revision": 0', '"revision": 9').alias("properties"))
    return catalog.conflicts(items, other.unionByName(items.select("properties")))


@query
def catalog_properties(spark, sf):
    """The catalog as a wide frame."""
    return _catalog(spark, sf).select("item_id", *[catalog.property_of("properties", p).alias(p) for p in ("dataset", "encoder", "layer", "pool")])


@query
def correspondence_grid_rows(spark, sf):
    return correspondence_grid(spark, ["trec", "imdb"], ["trec", "imdb", "amazon"], [i / 10 for i in range(10)], ["train", "test"])


def _benchmark(spark, sf) -> DataFrame:
    """Correspondences of every two datasets of the catalog, the same spaces in either split."""
    items = _catalog(spark, sf).withColumn("dataset", catalog.property_of("properties", "dataset"))
    names = items.select("dataset").where("dataset is not null").distinct()
    splits = F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split")
    text = F.concat(F.lit('{"quality": 0, "split": "'), F.col("split"), F.lit('", "x_dataset": "'), F.col("x"), F.lit('", "y_dataset": "'), F.col("y"), F.lit('"}'))
    named = names.select(F.col("dataset").alias("x"))
    corr = named.join(checked_broadcast(named.select(F.col("x").alias("y")), 10_000), F.lit(True)).select("x", "y", splits).select(F.sha2(text, 256).alias("item_id"), text.alias("properties"))
    held = items.where("n_rows > 0 and dataset is not null").select("item_id", "dataset", splits)
    spaces = held.select("item_id", F.concat(F.lit('{"dataset": "'), F.col("dataset"), F.lit('", "split": "'), F.col("split"), F.lit('"}')).alias("properties"))
    policy = {"estimators": ["svd", "lstsq"], "correspondence_constraints": {"quality": 0}, "fit": {"split": "train"}, "tests": [{"split": "train"}, {"split": "test"}]}
    return experiment.resolve_benchmark(corr, spaces, [policy], {"latent": ["l2", "cosine"], "downstream": ["accuracy"]})


@query
def resolve_benchmark(spark, sf):
    return _benchmark(spark, sf)


@query
def experiments_summary(spark, sf):
    return experiment.experiments_summary(_benchmark(spark, sf))


@query
def experiment_run(spark, sf):
    a, b = Space(x(spark, sf), {"name": "x"}), Space(y(spark, sf), {"name": "y"})
    all_rows = Correspondence.identity(spark, len(a))
    one = experiment.Experiment(a, b, all_rows, align.procrustes(), a, b, all_rows)
    return one.export(one.run(), {"x_fit": ["name"], "metric": ["name"], "score": []}).select(F.col("x_fit/name").alias("x_fit"), F.col("metric/name").alias("metric"), num("score", 4).alias("score"))


@query
def experiment_export(spark, sf):
    items = _catalog(spark, sf).select(F.col("properties").alias("space"), F.col("n_rows").alias("score"))
    return experiment.export_properties(items, {"space": ["dataset", "encoder", "layer"], "score": []}).select(F.col("space/dataset").alias("dataset"), F.col("space/encoder").alias("encoder"), F.col("space/layer").alias("layer"), "score")


# -- pooling, datasets, decoders --------------------------------------------------------------------------------------------


def _tokens(spark, sf) -> DataFrame:
    tok = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vector", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i + F.col("offset")) % 3 != 0)
    return x(spark, sf).select("offset", F.lit(0).alias("layer"), tok.alias("tokens"), mask.alias("mask"))


@query
def pool_token(spark, sf):
    got = pooling.pool_layers(_tokens(spark, sf), "tokens", "mask", "token")
    return got.select(F.col("offset").alias("id"), F.posexplode("vector").alias("token", "v")).select("id", "token", F.posexplode("v").alias("i", "e")).select("id", "token", "i", num("e").alias("x"))


for _n in ("mean", "sum", "cls"):
    QUERIES[f"pool_{_n}"] = lambda spark, sf, n=_n: long(pooling.pool_layers(_tokens(spark, sf), "tokens", "mask", n))


@query
def map_features(spark, sf):
    got = datasets.map_features(_records(spark, sf), datasets.FeatureMapping("content", "text"), datasets.FeatureMapping("label", "target"))
    return got.select("id", "text", "target", "content")


@query
def dbpedia_text(spark, sf):
    return datasets.dbpedia(_records(spark, sf)).select("id", "x", "y")


@query
def feature_select(spark, sf):
    got = datasets.process("dbpedia_14", _records(spark, sf), 0.5)
    return got.df.select("sample_id", "split", "x", "y")


@query
def class_names(spark, sf):
    names = datasets.class_names(_records(spark, sf).withColumn("label", F.col("label").cast("string")), "label")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")


@query
def encode_append(spark, sf):
    """Texts encoded by hashing, mean-pooled and added to a space in two batches, of which the second repeats half of the first."""
    from orrery.plans.stored import scratch

    rows, at = _records(spark, sf).where("content is not null"), scratch(spark)
    for part in (rows.where("id % 4 < 2"), rows.where("id % 4 > 0")):
        encode.add_encoding(encode.encode_feature(part, "content", encode.HashingEncoder(16), id_column="id"), at)
    got = spark.read.parquet(f"{at}/vectors")
    return got.select(F.col("offset").alias("id"), F.size("vector").alias("dim"), num(vec.norm("vector"), 4).alias("norm"))


@query
def classifier_scores(spark, sf):
    rows = x(spark, sf)
    model = encode.Classifier(10, 64, max_iter=20).fit(rows)
    return model.predict(rows).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


from orrery.plans import stored as _stored  # noqa: E402, F401  (registers its queries)
