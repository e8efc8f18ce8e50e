"""Similarity clusters of vectors by power-iteration spectral clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.vectors import sample_rows
from orrery.runtime import checked_broadcast, materialize

#: Rows per space that anchors are taken from, cosine from which two anchors are one, least cosine of an affinity, anchors a row
#: is tied to, vectors iterated and their steps, spaces per broadcast.
SAMPLE, SAME, NEAR, TIES, VECTORS, STEPS, SPACES = 2048, 0.85, 0.5, 3, 6, 16, 16
#: Rows without an anchor: least cosine of a link, links a row has per block, rows per block. In a cluster the mean cosine of a
#: member to the others is at least (0.75 * 0.75 * n - 1) / (n - 1), 0.453 for the smallest.
LINK, LINKS, BLOCK = 0.45, 8, 8192
#: Least cosines that the gathering of a label starts from, each by itself; how much they rise a round, and to where: between the
#: members of a cluster and all other vectors. Most rounds; cosine from which two mean directions are one.
STARTS, RISE, MIDDLE, ROUNDS, EQUAL = (0.35, 0.45, 0.55), 0.1, 0.625, 20, 1 - 1e-6
#: Mean directions per broadcast.
MEANS = 20_000
#: A cluster: least rows, least cosine of a member to the mean direction, cosine that no other vector reaches.
LEAST, INNER, OUTER = 5, 0.75, 0.5


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat, dtype=np.float64))[:, None].astype(np.float32)


def _by_space(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(space, vec_ids, unit vectors) of each space in a batch of (space_id, vec_id, vector)."""
    names = b.column(0).to_numpy(zero_copy_only=False)
    for space in pd.unique(names):
        take = pa.array(np.flatnonzero(names == space))
        yield space, b.column(1).take(take).to_numpy(), _units(b.column(2).take(take))


def _thin(rows: pd.DataFrame) -> pd.DataFrame:
    """Sample rows of a space of which none has a cosine of SAME or more to another: each stands for its surroundings."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    unit = np.array(rows["vector"].tolist(), np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    free, keep = np.ones(len(unit), bool), []
    for i in range(len(unit)):
        if free[i]:
            keep.append(i)
            free &= unit @ unit[i] < SAME
    return pd.DataFrame({"space_id": rows["space_id"].iloc[keep], "vec_id": rows["vec_id"].iloc[keep], "unit": list(unit[keep])})


def _groups(spark, spaces: list[str], size: int) -> list[list[str]]:
    return [spaces[i : i + size] for i in range(0, len(spaces), size)]


def _stacked(frame: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {s: (f["vec_id"].to_numpy(), np.array(f["unit"].tolist(), np.float32)) for s, f in frame.groupby("space_id")}


def affinities(vectors: DataFrame, anchors: DataFrame, spaces: list[str]) -> DataFrame:
    """(space_id, a, b, w, vector): the sparse affinities of anchors, and the rows that have no anchor near.

    Each row is tied to its TIES nearest anchors with a cosine over NEAR; a tie's affinity grows with the cosine and is divided
    by the row's sum, and anchors a <= b of one row gain the product: summed over rows this is A' D^-1 A, the normalised
    affinity of the anchors by way of all rows. Rows with no anchor near come out with b null and their unit vector.
    """
    spark = vectors.sparkSession
    parts = []
    for group in _groups(spark, spaces, SPACES):
        shared = spark.sparkContext.broadcast(_stacked(anchors.where(F.col("space_id").isin(group)).toPandas()))

        def tie(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[str, dict[int, float]] = {}
            for b in batches:
                for space, ids, unit in _by_space(b):
                    names, anchor = shared.value[space]
                    alone = []
                    for s in range(0, len(unit), 2048):
                        cos = unit[s : s + 2048] @ anchor.T
                        k = min(TIES, cos.shape[1])
                        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                        w = np.take_along_axis(cos, top, 1).astype(np.float64)
                        w = np.where(w >= NEAR, (w - NEAR) / (1 - NEAR) + 1e-3, 0)
                        total = w.sum(1)
                        alone.append(s + np.flatnonzero(total == 0))
                        top, w, total = top[total > 0], w[total > 0], total[total > 0]
                        own = sums.setdefault(space, {})
                        codes, gains = [], []
                        for i in range(k):
                            for j in range(i, k):
                                low, high = np.minimum(top[:, i], top[:, j]), np.maximum(top[:, i], top[:, j])
                                codes.append(low.astype(np.int64) * len(names) + high)
                                gains.append(w[:, i] * w[:, j] / total)
                        code, where = np.unique(np.concatenate(codes), return_inverse=True)
                        for c, g in zip(code.tolist(), np.bincount(where, np.concatenate(gains), minlength=len(code)).tolist()):
                            if g:
                                own[c] = own.get(c, 0.0) + g
                    lone = np.concatenate(alone)
                    if len(lone):
                        yield _rows([space] * len(lone), ids[lone], None, None, unit[lone])
            for space, own in sums.items():
                names, _ = shared.value[space]
                code = np.fromiter(own.keys(), np.int64, len(own))
                if len(code):
                    yield _rows([space] * len(code), names[code // len(names)], names[code % len(names)], np.fromiter(own.values(), float, len(own)), None)

        parts.append(vectors.where(F.col("space_id").isin(group)).mapInArrow(tie, "space_id string, a long, b long, w double, vector array<float>"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rows(space, a, b, w, unit) -> pa.RecordBatch:
    n = len(a)
    vector = pa.nulls(n, pa.list_(pa.float32())) if unit is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * unit.shape[1], pa.int32()), pa.array(unit.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(space, pa.string()), pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.float64()) if w is None else pa.array(w, pa.float64()), vector], names=["space_id", "a", "b", "w", "vector"])


def lone_links(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, w): affinities among rows without an anchor (space_id, vec_id, vector of length 1).

    Every such row meets every other of its space: blocks of about `block` rows are broadcast one after the other and multiplied
    with all rows. Pairs of a cosine of LINK or more are linked, of each row and block the LINKS best. In a group that is a
    cluster each member has such a partner, so none is lost whatever the size; the cost grows with the square of these rows.
    """
    spark, kinds = rows.sparkSession, "a long, b long, w double"
    blocks = -(-rows.count() // block)
    parts = [spark.createDataFrame([], kinds)]
    for i in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)) == i)
        shared = spark.sparkContext.broadcast(_stacked(own.select("space_id", "vec_id", F.col("vector").alias("unit")).toPandas()))

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for space, ids, unit in _by_space(b):
                    if space not in shared.value:
                        continue
                    names, other = shared.value[space]
                    for s in range(0, len(unit), 1024):
                        cos = unit[s : s + 1024] @ other.T
                        near = cos >= LINK
                        many = np.flatnonzero(near.sum(1) > LINKS + 1)  # a row is near itself
                        if len(many):
                            cut = near[many]
                            np.put_along_axis(cut, np.argpartition(-cos[many], LINKS, axis=1)[:, LINKS + 1 :], False, 1)
                            near[many] = cut
                        row, col = np.nonzero(near)
                        x, y = ids[s + row], names[col]
                        two = x != y
                        w = (cos[row, col].astype(np.float64) - LINK) / (1 - LINK) + 1e-3
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[two]), pa.array(np.maximum(x, y)[two]), pa.array(w[two])], names=["a", "b", "w"])

        parts.append(materialize(rows.select("space_id", "vec_id", "vector").mapInArrow(meet, kinds), "links"))
        shared.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("a", "b").agg(F.max("w").alias("w"))


def embed(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(a, mass, e0, e1, ..): power iteration of VECTORS random vectors with the row-normalised affinities of `edges` (a, b, w;
    each pair once). The vectors flatten inside a component and, stopped early, stay apart between weakly tied ones."""
    both = edges.unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    mass = both.groupBy("a").agg(F.sum("w").alias("mass"))
    walk = materialize(both.join(mass, "a").select("a", "b", "mass", (F.col("w") / F.col("mass")).alias("p")), "walk")
    at = [f"e{i}" for i in range(VECTORS)]
    start = [(F.pmod(F.xxhash64("a", F.lit(i)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(c) for i, c in enumerate(at)]
    v = walk.select("a", "mass").distinct().select("a", "mass", *start)
    for step in range(steps):
        right = v.select(F.col("a").alias("b"), *at)
        v = walk.join(right, "b").groupBy("a").agg(F.first("mass").alias("mass"), *[F.sum(F.col("p") * F.col(c)).alias(c) for c in at])
        if step % 4 == 3 or step == steps - 1:
            v = materialize(v, "embedding")
    return v


def _kmeans(points: pd.DataFrame, rounds: int = 5) -> pd.DataFrame:
    """k-means of embedded vertices, weighted by mass; k is the number of seeds that lie over a small distance apart."""
    points = points.sort_values(["mass", "a"], ascending=[False, True], ignore_index=True)
    x, mass = points[[f"e{i}" for i in range(VECTORS)]].to_numpy(float), points["mass"].to_numpy(float)
    free, seeds = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            seeds.append(i)
            free &= ((x - x[i]) ** 2).sum(1) > 1e-4
    centre = x[seeds]
    for _ in range(rounds):
        label = np.concatenate([((x[s : s + 512, None] - centre[None]) ** 2).sum(2).argmin(1) for s in range(0, len(x), 512)])
        total = np.bincount(label, mass, minlength=len(centre))
        moved = np.column_stack([np.bincount(label, mass * x[:, j], minlength=len(centre)) for j in range(x.shape[1])]) / np.maximum(total, 1e-300)[:, None]
        centre = np.where(total[:, None] > 0, moved, centre)
    first = pd.Series(points["a"].to_numpy()).groupby(label).min()
    return pd.DataFrame({"space_id": points["space_id"], "a": points["a"], "mass": mass, "label": first.loc[label].to_numpy()})


def _merge(means: pd.DataFrame) -> pd.DataFrame:
    """Clusters of a space whose mean directions have a cosine of INNER or more are one, named by the smallest label."""
    means = means.sort_values(["n", "label"], ascending=[False, True], ignore_index=True)
    total = np.array(means["total"].tolist(), np.float64)
    unit = total / np.maximum(np.linalg.norm(total, axis=1), 1e-300)[:, None]
    free, rows = np.ones(len(means), bool), []
    for i in range(len(means)):
        if free[i]:
            own = free & (unit @ unit[i] >= INNER)
            own[i] = True
            free &= ~own
            mean = total[own].sum(0)
            rows.append((means["space_id"].iloc[0], int(means["label"][own].min()), list(mean / max(np.linalg.norm(mean), 1e-300)), float(means["n"][own].sum())))
    return pd.DataFrame(rows, columns=["space_id", "label", "unit", "n"])


def _mean_directions(sums: DataFrame) -> DataFrame:
    """(space_id, label, unit, n) of (space_id, label, total, n) rows summed by label."""
    summed = sums.groupBy("space_id", "label").agg(Summarizer.sum(array_to_vector("total")).alias("t"), F.sum("n").alias("n"))
    return summed.select("space_id", "label", vector_to_array("t").alias("total"), "n").groupBy("space_id").applyInPandas(_merge, "space_id string, label long, unit array<double>, n double")


def _distinct(means: pd.DataFrame) -> pd.DataFrame:
    """Of gathered labels of a space with one mean direction, the one with the largest threshold, then the smallest label.
    Different directions stay apart, for they may still come to different clusters."""
    means = means.sort_values(["least", "label"], ascending=[False, True], ignore_index=True)
    unit = np.array(means["total"].tolist(), np.float64)
    unit /= np.maximum(np.linalg.norm(unit, axis=1), 1e-300)[:, None]
    free, keep = np.ones(len(means), bool), []
    for i in range(len(means)):
        if free[i]:
            keep.append(i)
            free &= unit @ unit[i] < EQUAL
    return pd.DataFrame({"space_id": means["space_id"].iloc[keep], "label": means["label"].iloc[keep], "unit": list(unit[keep]), "n": means["n"].iloc[keep], "least": means["least"].iloc[keep]})


def gather(vectors: DataFrame, means: DataFrame, spaces: list[str]) -> DataFrame:
    """(space_id, label, unit, n, least): the stable mean directions that labels (space_id, label, unit) come to.

    A label takes the mean of all vectors within a cosine of its direction, again and again. The cosine rises from each of
    STARTS to MIDDLE: a low start reaches loose members from a seed that is one of them, a high one keeps strangers out.
    Labels of any size stay, except such that hold one row alone, as that row has no other to rise with.
    """
    kinds = "space_id string, label string, unit array<double>, n double, least double"
    starts = F.array(*[F.lit(float(x)) for x in STARTS])
    now = means.select("space_id", F.col("label").cast("string").alias("label"), "unit", F.posexplode(starts).alias("start", "least")).withColumn("label", F.concat_ws(":", "label", "start"))
    now = materialize(now.select("space_id", "label", "unit", F.lit(0.0).alias("n"), "least"), "means")
    for step in range(ROUNDS):
        sums = _recruit(vectors, now, spaces, None).groupBy("space_id", "label").agg(Summarizer.sum(array_to_vector("total")).alias("t"), F.sum("n").alias("n")).where("n > 1")
        risen = now.select("space_id", "label", F.least(F.col("least") + RISE, F.lit(MIDDLE)).alias("least"))
        new = sums.join(checked_broadcast(risen), ["space_id", "label"]).select("space_id", "label", vector_to_array("t").alias("total"), "n", "least")
        new = materialize(new.groupBy("space_id").applyInPandas(_distinct, kinds), "means")
        if step * RISE + STARTS[0] >= MIDDLE:
            was = now.select("space_id", "label", F.col("unit").alias("was"))
            same = F.aggregate(F.zip_with("unit", "was", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            if new.join(was, ["space_id", "label"]).where(same < 1 - 1e-9).isEmpty():
                return new
        now = new
    return now


def _recruit(vectors: DataFrame, means: DataFrame, spaces: list[str], outer: float | None) -> DataFrame:
    """With `outer` null: (space_id, label, total, n), the sums of the vectors with a cosine of `least` or more to each mean.
    Else (space_id, label, vec_id, cos) of all vectors with a cosine of `outer` or more to a mean."""
    spark = vectors.sparkSession
    parts, blocks = [], []
    held = {r.space_id: r["count"] for r in means.groupBy("space_id").count().toLocalIterator()}
    for group in _groups(spark, spaces, SPACES):
        n = -(-sum(held.get(s, 0) for s in group) // MEANS)
        blocks += [(group, n, i) for i in range(n)]
    kinds = "space_id string, label string, total array<double>, n double" if outer is None else "space_id string, label string, vec_id long, cos double"
    if not blocks:
        return spark.createDataFrame([], kinds)
    for group, n, i in blocks:
        some = means.where(F.col("space_id").isin(group)).where(F.pmod(F.xxhash64("label"), F.lit(n)) == i)
        frame = some.toPandas().rename(columns={"label": "vec_id"})
        shared = spark.sparkContext.broadcast({s: (n, u.astype(np.float64), frame["least"].to_numpy()[frame["space_id"] == s]) for s, (n, u) in _stacked(frame).items()})
        own = vectors.where(F.col("space_id").isin(list(frame["space_id"].unique())))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for space, _, unit in _by_space(b):
                    names, mean, least = shared.value[space]
                    if space not in sums:
                        sums[space] = (np.zeros_like(mean), np.zeros(len(names)))
                    in_ = (unit @ mean.T.astype(np.float32) >= least.astype(np.float32)).astype(np.float32)
                    sums[space][0][:] += in_.T @ unit
                    sums[space][1][:] += in_.sum(0)
            for space, (total, n) in sums.items():
                some = np.flatnonzero(n)
                if len(some):
                    arr = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32()), pa.array(total[some].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([space] * len(some)), pa.array(shared.value[space][0][some]), arr, pa.array(n[some])], names=["space_id", "label", "total", "n"])

        def close(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for space, ids, unit in _by_space(b):
                    names, mean, _ = shared.value[space]
                    cos = unit.astype(np.float64) @ mean.T
                    row, label = np.nonzero(cos >= outer)
                    yield pa.RecordBatch.from_arrays([pa.array([space] * len(row), pa.string()), pa.array(names[label]), pa.array(ids[row]), pa.array(cos[row, label])], names=["space_id", "label", "vec_id", "cos"])

        part = own.mapInArrow(add if outer is None else close, kinds)
        if len(blocks) > 1:  # one block of means is held at a time
            part = materialize(part, "gathered")
            shared.unpersist()
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similarity_clusters(valid: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(space_id, cluster_id, vec_id, cos): the clusters of the vectors that valid_vectors gives.

    Power-iteration spectral clustering on sparse affinities. Anchors are taken from `sample` rows per space, every row is
    tied to its nearest anchors (see affinities), rows far from all anchors are linked among themselves in exact blocks (see
    lone_links), so that clusters too small for the sample are found as well. Several random vectors are iterated over the
    normalised affinities as a table, and the embedding of the anchors is clustered by k-means. From the mean direction of
    each k-means cluster the members are then gathered from all rows until the mean is stable (see gather), and the
    definition is checked exactly: a cluster has LEAST or more members with a cosine of INNER or more to their mean, and no other vector of the space reaches OUTER.

    cluster_id is the smallest vec_id. `cos` ranks the members by internal affinity: the sum of a member's cosines to all
    members is in proportion to its cosine to their mean. Vectors of no cluster have no row. Vectors are never shuffled but written once to the
    shared folder; the anchors and means of SPACES spaces are broadcast at a time. Empty in,
    empty out; nulls and invalid vectors: see valid_vectors.
    """
    spark = valid.sparkSession
    vectors = materialize(valid.select("space_id", "vec_id", "vector"), "vectors")  # read in every round
    spaces = [r.space_id for r in vectors.select("space_id").distinct().orderBy("space_id").toLocalIterator()]
    if not spaces:
        return spark.createDataFrame([], "space_id string, cluster_id long, vec_id long, cos double")
    anchors = materialize(sample_rows(vectors, sample).groupBy("space_id").applyInPandas(_thin, "space_id string, vec_id long, unit array<double>"), "anchors")
    tied = materialize(affinities(vectors, anchors, spaces), "affinities")
    lone = tied.where("b is null").select("space_id", F.col("a").alias("vec_id"), "vector")
    links = materialize(lone_links(lone), "lone")
    ends = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).distinct()
    edges = tied.where("b is not null").groupBy("a", "b").agg(F.sum("w").alias("w")).unionByName(links).unionByName(ends.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("w")))
    points = embed(edges)
    units = anchors.unionByName(lone.join(checked_broadcast(ends.withColumnRenamed("v", "vec_id")), "vec_id", "left_semi").select("space_id", "vec_id", F.col("vector").cast("array<double>").alias("unit")))
    units = materialize(units, "vertices")
    placed = points.join(units.select("space_id", F.col("vec_id").alias("a")), "a")
    slices = placed.groupBy("space_id").agg(F.greatest(F.lit(16), F.ceil(F.count(F.lit(1)) / 256)).alias("slices"))
    placed = placed.join(F.broadcast(slices), "space_id").withColumn("slice", F.floor((F.col("e0") + 1) / 2 * F.col("slices")))  # one row per space
    named = placed.groupBy("space_id", "slice").applyInPandas(lambda points: _kmeans(points), "space_id string, a long, mass double, label long")
    weighted = named.join(units.select(F.col("vec_id").alias("a"), "unit"), "a").select("space_id", "label", F.transform("unit", lambda x: x * F.col("mass")).alias("total"), F.col("mass").alias("n"))
    means = gather(vectors, materialize(_mean_directions(weighted), "means"), spaces)
    if means.isEmpty():
        return spark.createDataFrame([], "space_id string, cluster_id long, vec_id long, cos double")
    found = materialize(_recruit(vectors, means, spaces, OUTER), "members")
    good = found.groupBy("space_id", "label").agg(F.min("cos").alias("worst"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("cluster_id")).where((F.col("worst") >= INNER) & (F.col("n") >= LEAST))
    good = good.groupBy("space_id", "cluster_id").agg(F.min(F.struct(-F.col("n"), "label")).alias("r")).select("cluster_id", "r.label")
    return found.join(checked_broadcast(good), "label").select("space_id", "cluster_id", "vec_id", "cos").distinct()


def describe_clusters(members: DataFrame, valid: DataFrame, typical: int = 5) -> DataFrame:
    """(space_id, cluster_id, size, n_labels, main_label, main_share, typical): each cluster of similarity_clusters with its
    size, its labels (null and negative ones do not count) and the ids of its `typical` most typical members, ties to the
    smaller id. Members are not ranked in one task: each of 64 slices gives its best first."""
    slice_ = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    order = [F.desc(F.round("cos", 6)), F.asc("vec_id")]
    first = members.withColumn("slice", slice_).withColumn("n", F.row_number().over(Window.partitionBy("cluster_id", "slice").orderBy(*order))).where(F.col("n") <= typical)
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("n") <= typical)
    most = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id"))).alias("t")).select("cluster_id", F.col("t.vec_id").alias("typical"))  # `typical` rows
    labels = members.join(valid.select("vec_id", "label"), "vec_id").groupBy("space_id", "cluster_id", "label").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("label") >= 0, F.struct(F.col("n"), -F.col("label")))
    per = labels.groupBy("space_id", "cluster_id").agg(F.sum("n").alias("size"), F.count(F.when(F.col("label") >= 0, 1)).alias("n_labels"), F.max(known).alias("m"))
    return per.join(most, "cluster_id").select("space_id", "cluster_id", "size", "n_labels", (-F.col("m.col2")).alias("main_label"), (F.col("m.n") / F.col("size")).alias("main_share"), "typical")
