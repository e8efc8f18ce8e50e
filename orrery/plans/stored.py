"""More queries: what is saved and loaded again, looked up, added, certified or processed by name. SQL in stored_sql.py."""

from __future__ import annotations

import atexit
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators import align, encode, measures, sampling, search
from orrery.operators import transforms as t
from orrery.operators.correspondence import Correspondence, correspondence_grid
from orrery.operators.space import Space
from orrery.plans import experiment
from orrery.plans.queries import K, _benchmark, _catalog, _records, found, long, num, query, state, width, x, y
from orrery.runtime import _remove, shared_dir
from orrery.sources import datasets
from orrery.sources.bimap import BiMap
from orrery.sources.catalog import DiskCatalog
from orrery.sources.files import read_text, write_text


def scratch(spark) -> str:
    """A folder of its own in the shared folder, gone when the process ends."""
    path = f"{shared_dir(spark)}/orrery-stored-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


# -- two-way maps


@query
def bimap_lookup(spark, sf):
    """Offsets of keys and keys of offsets, of a list that runs past the map."""
    m = BiMap(x(spark, sf).select(F.col("key").alias("x"), F.col("offset").alias("y")))
    twice = (F.col("offset") * 2).alias("y")
    by_y = m.get_x(x(spark, sf).select(twice)).select("y", "x")
    by_x = m.get_y(x(spark, sf).select(F.concat(F.lit("k"), twice).alias("x"))).select(F.col("y"), F.col("x"))
    return by_y.withColumn("side", F.lit("x")).unionByName(by_x.withColumn("side", F.lit("y")))


@query
def bimap_grow(spark, sf):
    """A map grown by pairs of which half are there already, saved as text and loaded; with the flags of keys."""
    pairs = x(spark, sf).select(F.col("key").alias("x"), F.col("offset").alias("y"))
    at = scratch(spark)
    BiMap(pairs.where("y % 2 = 0")).add_all(pairs.where("y % 4 < 2")).save(at)
    return BiMap.load(spark, at).contains_x(pairs.select("x")).select(F.col("x").alias("key"), "held")


# -- search results and indexes


@query
def knn_padded(spark, sf):
    rows = x(spark, sf)
    asked = rows.where("offset % 100 = 0").select(F.col("offset").alias("query_id"), "vector")
    return found(search.SearchIndex(rows.where("offset < 3"), "l2").search_knn(K, queries=asked, digits=6, pad=True))


@query
def range_l2_ranked(spark, sf):
    index = search.SearchIndex(x(spark, sf), "l2")
    got = index.search_range(9.0, query_offsets=x(spark, sf).where("offset % 100 = 0").select(F.col("offset").alias("pos"), "offset"))
    return got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.min(F.when(F.col("rank") == 0, F.col("offset"))).alias("nearest"))


@query
def search_result_arrays(spark, sf):
    index = search.SearchIndex(x(spark, sf), "l2")
    got = search.per_query(index.search_knn(3, query_offsets=x(spark, sf).where("offset % 100 = 0").select(F.col("offset").alias("pos"), "offset"), digits=6))
    return got.select("query_id", F.array_join(F.col("offsets").cast("array<string>"), " ").alias("offsets"), F.array_join("keys", " ").alias("keys"))


@query
def index_stored(spark, sf):
    """The nearest rows by an index that was saved and loaded."""
    at = scratch(spark)
    search.SearchIndex(x(spark, sf), "cosine").save(at)
    index = search.SearchIndex.load(spark, at)
    return found(index.search_knn(K, query_offsets=x(spark, sf).where("offset % 100 = 0").select(F.col("offset").alias("pos"), "offset"), digits=6))


@query
def index_grown_by_rows(spark, sf):
    index = search.SearchIndex.create(spark, "l2").add_rows([[float(i), 1.0] for i in range(5)], [f"a{i}" for i in range(5)]).add_rows([[9.0, 9.0]], ["late"])
    return index.df.select("offset", "key", F.get("vector", F.lit(0)).alias("first"))


# -- spaces


@query
def space_stored(spark, sf):
    at = scratch(spark)
    Space(x(spark, sf), {"name": "x", "split": "train"}).save(at)
    back = Space.load(spark, at)
    return back.df.select(F.col("offset").alias("id"), "key", num(vec.norm("vector")).alias("norm"), F.lit(back.name).alias("name"), F.lit(back.split).alias("split"))


@query
def space_key_tsv(spark, sf):
    at = scratch(spark)
    Space(x(spark, sf)).save_key_tsv(at)
    from orrery.operators.space import READERS

    return READERS["key_tsv"](spark, at).select(F.col("offset").alias("id"), "key", num(vec.norm("vector")).alias("norm"))


@query
def space_equality(spark, sf):
    """A space against itself, against one with a change below the tolerance, above it, and with a row less."""
    a = Space(x(spark, sf))
    moved = lambda d: a.like(a.df.withColumn("vector", F.transform("vector", lambda e: e + d)))
    cases = [("same", a), ("near", moved(1e-12)), ("far", moved(0.5)), ("shorter", a.like(a.df.where("offset > 0")))]
    return spark.createDataFrame([(name, bool(a.equals(other))) for name, other in cases], "case string, equal boolean")


@query
def space_sample_transform(spark, sf):
    part = Space(x(spark, sf)).to_memory().sample(sampling.Uniform(42), 50).transform(t.LPNorm(2))
    return long(part.df)


@query
def vector_sources(spark, sf):
    """The readers a space can come from."""
    from orrery.operators.space import READERS

    return spark.createDataFrame([(n,) for n in READERS], "reader string")


# -- transforms


@query
def identity_and_inverse(spark, sf):
    """Centred rows brought back by the inverse transform, and rows as the identity leaves them."""
    c = t.Centering().fit(x(spark, sf))
    back = t.InverseTransform(c).transform(c.transform(x(spark, sf)))
    centred = t.InverseTransform(t.InverseTransform(c)).transform(x(spark, sf))
    first = lambda d, name: d.select(F.col("offset").alias("id"), num(F.get("vector", F.lit(0))).alias(name))
    return first(back, "back").join(first(centred, "centred"), "id").join(first(t.Identity().transform(x(spark, sf)), "same"), "id")


@query
def simple_transform(spark, sf):
    double = t.SimpleTransform(lambda v, shift, by: F.transform(v, lambda e: (e - shift) * by), lambda df, vector: {"shift": float(df.agg(F.max(F.array_max(vector))).first()[0])}, lambda v, shift, by: F.transform(v, lambda e: e / by + shift), by=2.0)
    return long(double.fit_transform(x(spark, sf)))


def _plane(values: np.ndarray):
    """Largest absolute entry, as 0 where it is rounding noise."""
    return float(np.abs(values).max())


@query
def random_isometry_certified(spark, sf):
    """Norms stay, rows change: what a transform that does nothing fails."""
    iso = t.RandomIsometry(3).fit(x(spark, sf))
    turned = iso.transform(x(spark, sf)).select("offset", F.col("vector").alias("w"))
    both = x(spark, sf).join(turned, "offset")
    return both.select(F.col("offset").alias("id"), num(vec.norm("w"), 5).alias("norm"), (vec.l2_squared("vector", "w") > 0.01).alias("moved"))


@query
def random_permutation_certified(spark, sf):
    """Sorted elements stay, places change."""
    p = t.RandomDimensionPermutation(3).fit(x(spark, sf)).transform(x(spark, sf)).select("offset", F.col("vector").alias("w"))
    both = x(spark, sf).join(p, "offset")
    return both.select(F.col("offset").alias("id"), (F.sort_array("vector") == F.sort_array("w")).alias("same_elements"), (F.col("vector") != F.col("w")).alias("moved"))


# -- aligners, certified by the conditions that make them the best: a map that does nothing meets none of them


def _aligned(spark, sf, name: str, narrow: bool):
    left = width(x(spark, sf), 48) if narrow else x(spark, sf)
    pairs = align.pair(left, y(spark, sf))
    return align.MatrixAligner(name).fit_pairs(pairs).state["matrix"], align.moments(pairs, "x", "y")


@query
def certify_svd_align(spark, sf):
    """R is the best orthogonal map if R'R = 1 and R'X'Y is symmetric without a negative eigenvalue."""
    r, m = _aligned(spark, sf, "svd", True)
    c = r.T @ m.raw("x", "y")
    return state(spark, np.array([[_plane(r.T @ r - np.eye(48)), _plane(c - c.T) / np.abs(c).max(), min(0.0, np.linalg.eigvalsh((c + c.T) / 2).min() / np.abs(c).max())]]))


@query
def certify_lstsq_align(spark, sf):
    """X'(XW - Y) = 0, from the moments."""
    w, m = _aligned(spark, sf, "lstsq", False)
    rest = m.raw("x", "x") @ w - m.raw("x", "y")
    return state(spark, np.array([[_plane(rest) / np.abs(m.raw("x", "y")).max()]]))


@query
def certify_lstsq_ortho_align(spark, sf):
    """R'W is symmetric without a negative eigenvalue for the least-squares W, and R'R = 1: R is W's orthogonal part."""
    r, m = _aligned(spark, sf, "lstsq_ortho", False)
    w, _ = _aligned(spark, sf, "lstsq", False)
    c = r.T @ w
    return state(spark, np.array([[_plane(r.T @ r - np.eye(48)), _plane(c - c.T), min(0.0, np.linalg.eigvalsh((c + c.T) / 2).min())]]))


@query
def certify_sgd_affine_align(spark, sf):
    """Steps of gradient descent lower the error below that of the mean of y, and more steps lower it further."""
    pairs = align.pair(x(spark, sf), y(spark, sf)).cache()

    def error(steps: int) -> float:
        model = align.SGDAffineAligner(num_steps=steps, lr=0.01).fit_pairs(pairs)
        made = model.transform(pairs.select("offset", F.col("x").alias("vector")))
        return align.pair(made, pairs.select("offset", F.col("y").alias("vector"))).agg(F.avg(vec.l2_squared("x", "y"))).first()[0]

    m = align.moments(pairs, "x", "y")
    mean = float(np.trace(m.raw("y", "y") / m.n - np.outer(m.y_mean, m.y_mean)))
    few, many = error(20), error(600)
    pairs.unpersist()
    return spark.createDataFrame([(bool(many < few), bool(many < mean))], "falls boolean, better_than_mean boolean")


@query
def certify_procrustes(spark, sf):
    """A space turned, stretched and shifted comes back by the translator that is fitted on it."""
    iso = t.RandomIsometry(9).fit(x(spark, sf))
    other = iso.transform(x(spark, sf)).withColumn("vector", F.transform("vector", lambda e: e * 3 + 0.25))
    turned = align.Translator(align.MatrixAligner("svd"), t.Centering(), t.Centering()).fit(other, x(spark, sf)).transform(other)
    both = align.pair(turned, x(spark, sf))
    # the stretch by 3 stays: centred rows are 3 times as far from the mean
    mean = t.Centering().fit(x(spark, sf)).state["shift"]
    off = F.zip_with("y", F.array(*[F.lit(float(v)) for v in np.asarray(mean).ravel()]), lambda a, b: (a - b) * 3 + b)
    return both.select(F.col("offset").alias("id"), num(vec.l2_squared("x", off), 4).alias("error"))


@query
def unpaired_spaces(spark, sf):
    """Every offset of x stands once more, most at another row."""
    a, _ = align.unpaired(x(spark, sf), y(spark, sf), 5)
    return a.select("offset", "key")


@query
def svcca_invariance(spark, sf):
    """A space against itself turned and stretched."""
    turned = t.RandomIsometry(4).fit(x(spark, sf)).transform(x(spark, sf)).withColumn("vector", F.transform("vector", lambda e: e * 2 + 1))
    return spark.createDataFrame([("svcca", measures.SVCCA()(x(spark, sf), turned)), ("cka_linear", measures.CKA("linear")(x(spark, sf), turned))], "measure string, v double").select("measure", num("v", 3).alias("value"))


# -- pairings and the catalog


@query
def correspondence_stored(spark, sf):
    at = scratch(spark)
    n = x(spark, sf).count()
    Correspondence.identity(spark, n, {"name": "id"}).random_subset(n // 2, 42).save(at)
    return Correspondence.load(spark, at).df.select("pos", "x_id", "y_id")


@query
def correspondence_catalog(spark, sf):
    """A catalog of correspondences written in one call: the items it then holds."""
    grid = [r.asDict() for r in correspondence_grid(spark, ["trec", "imdb"], ["trec"], [0.0, 0.5], ["train", "test"]).collect()]
    held = DiskCatalog(spark, scratch(spark), "correspondence")
    held.add_items([(g, None) for g in grid])
    return held.frame().select("item_id", *[F.get_json_object("properties", f"$.{c}").alias(c) for c in ("x_dataset", "y_dataset", "split")])


@query
def catalog_changes(spark, sf):
    """Items of the catalog of spaces added, some removed by property, one added again."""
    held = DiskCatalog(spark, scratch(spark), "space")
    texts = [json.loads(r.properties) for r in _catalog(spark, sf).where("n_rows > 0 or item_id < '5'").select("properties").distinct().collect()]
    held.add_items([(p, None) for p in texts])
    held.remove_items(pool="mean")
    return held.frame().select("item_id", F.get_json_object("properties", "$.pool").alias("pool"))


@query
def json_stored(spark, sf):
    at = f"{scratch(spark)}/one.json"
    write_text(spark, at, json.dumps({"b": [1, 2], "a": None}, sort_keys=True))
    return spark.createDataFrame([(read_text(spark, at),)], "text string")


@query
def benchmark_stored(spark, sf):
    """The summary of a benchmark that was read from a file, planned, written and loaded."""
    at = scratch(spark)
    write_text(spark, f"{at}/config.json", json.dumps({"policies": [], "metrics": {}}))
    experiment.read_benchmark(spark, f"{at}/config.json")
    experiment.write_benchmark(_benchmark(spark, sf), f"{at}/benchmark.json")
    return experiment.benchmark_summary(spark, f"{at}/benchmark.json")


# -- datasets


def _raw(spark, sf, name: str) -> DataFrame:
    """Samples in the shape of the public source of a processor."""
    rows = _records(spark, sf)
    image = F.encode(F.coalesce("content", F.lit("")), "UTF-8")
    columns = {
        "trec": {"text": F.col("content"), "coarse_label": F.col("label") % 6, "fine_label": F.col("label")},
        "ag_news": {"text": F.col("content"), "label": F.col("label").cast("string")},
        "imdb": {"text": F.col("content"), "label": F.col("label").cast("string")},
        "mnist": {"image": image, "label": F.col("label")},
        "fashion_mnist": {"image": image, "label": F.col("label")},
        "cifar10": {"img": image, "label": F.col("label")},
        "cifar100": {"img": image, "coarse_label": F.col("label") % 20, "fine_label": F.col("label")},
    }[name]
    split = F.when((F.lit(name) == "imdb") & (F.col("split") == "val"), F.lit("unsupervised")).otherwise(F.col("split"))
    return rows.select("id", split.alias("split"), *[c.alias(n) for n, c in columns.items()])


def _processed(name: str):
    def run(spark, sf):
        df = datasets.process(name, _raw(spark, sf, name), 0.5).df
        sizes = {c: F.octet_length(c).alias("bytes") for c, k in df.dtypes if k == "binary"}
        return df.select("sample_id", "split", *[sizes.get(c, F.col(c)) for c in df.columns if c not in ("sample_id", "split")])

    return run


for _n in ("trec", "ag_news", "imdb", "mnist", "fashion_mnist", "cifar10", "cifar100"):
    query_fn = _processed(_n)
    query_fn.__name__ = f"process_{_n}"
    query(query_fn)


@query
def dataset_stored(spark, sf):
    """Rows and metadata of a data set that was saved and loaded."""
    at = scratch(spark)
    datasets.process("dbpedia_14", _records(spark, sf), 0.5).save(at)
    back = datasets.Dataset.load(spark, at)
    language = back.get_feature("x").properties[datasets.FeatureProperty.LANGUAGE.value]
    return back.df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x")).alias("chars")).select("split", "n", "chars", F.lit(back.name).alias("name"), F.lit(back.perc).alias("perc"), F.lit(language).alias("language"))


@query
def f_beta(spark, sf):
    """Of a prediction that is right for even ids and one too high for others."""
    rows = _records(spark, sf).select("label", (F.col("label") + F.col("id") % 2).alias("said"))
    got = measures.f_beta(rows, "said", "label", 2.0)
    return got.select("class", "support", num("precision").alias("precision"), num("recall").alias("recall"), num("f_beta").alias("f_beta"))


# -- encoders


@query
def encode_poolers(spark, sf):
    """Texts under two poolers in one pass."""
    got = encode.encode_poolers(_records(spark, sf).where("content is not null"), "content", encode.HashingEncoder(16), ["mean", "sum"], "id")
    return got.select("pooler", F.col("offset").alias("id"), F.size("vector").alias("dim"), num(vec.norm("vector"), 4).alias("norm"))


@query
def encode_images(spark, sf):
    """Bytes of texts as images: the mean of each half."""
    rows = _records(spark, sf).select("id", F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("image"))
    got = encode.encode_feature(rows, "image", encode.TileEncoder(2), id_column="id")
    return got.select(F.col("offset").alias("id"), F.size("vector").alias("dim"), F.forall("vector", lambda e: e.between(-1, 1)).alias("in_range"))


@query
def column_model(spark, sf):
    return long(encode.ColumnModel(lambda v: F.transform(v, lambda e: -e), {"name": "negated"}).predict(x(spark, sf)))
