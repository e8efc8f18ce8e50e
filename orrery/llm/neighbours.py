"""Most similar vectors by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.vectors import sample_rows
from orrery.runtime import checked_broadcast, materialize

#: Rows per space that the codes are fitted on, most bits of a code, standard deviations of slack of a radius, queries per
#: broadcast, spaces per broadcast, rows indexed at once in a task.
SAMPLE, BITS, SLACK, BLOCK, SPACES, ROWS = 2048, 128, 5.0, 8192, 16, 262_144
METRICS = ("cosine", "l2", "inner_product")


def fit_codes(unit: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A rotation (dim, bits) whose signs lose little of the unit vectors' directions: principal axes, then alternating
    between codes and the best rotation for them (iterative quantisation, Gong and Lazebnik 2011). No centring, so that the
    Hamming distance of two codes follows the angle between the vectors."""
    bits = min(unit.shape[1], BITS)
    values, axes = np.linalg.eigh(unit.T @ unit)
    axes = axes[:, np.argsort(values)[::-1][:bits]]
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((bits, bits)))[0]
    flat = unit @ axes
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return axes @ turn


def encode(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Signs of the rotated vectors, one byte per bit."""
    return (unit @ rotation >= 0).astype(np.uint8)


def pack(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, padded with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def fit_radius(unit: np.ndarray, rotation: np.ndarray, steps: int = 64) -> np.ndarray:
    """The Hamming radius for each of `steps` + 1 cosines from -1 to 1: mean and SLACK deviations over the sample's pairs of
    about that cosine, and no less than for any greater cosine."""
    code = encode(unit, rotation).astype(np.float32)
    bits = code.shape[1]
    cos = unit @ unit.T
    far = code @ (1 - code.T)
    far = far + far.T
    step = np.clip(((cos + 1) / 2 * steps).round().astype(int), 0, steps)
    n = np.bincount(step.ravel(), minlength=steps + 1)
    mean = np.bincount(step.ravel(), far.ravel(), minlength=steps + 1) / np.maximum(n, 1)
    square = np.bincount(step.ravel(), far.ravel() ** 2, minlength=steps + 1) / np.maximum(n, 1)
    angle = np.arccos(np.linspace(-1, 1, steps + 1)) / np.pi
    by_chance = bits * angle + SLACK * np.sqrt(bits * np.maximum(angle * (1 - angle), 1 / bits))
    seen = mean + SLACK * np.sqrt(np.maximum(square - mean**2, 1.0))
    radius = np.where(n >= 200, seen, np.maximum(by_chance, seen * (n > 0)))
    return np.minimum(np.maximum.accumulate(radius[::-1])[::-1], bits).astype(np.int64)


def least_cosine(metric: str, bound: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least cosine at which a vector with a norm in [low, high] can be as good as `bound` for a query of norm q. bound:
    a cosine, a squared L2 distance or an inner product. Over 1: no vector can."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            return bound + np.zeros_like(low)
        if metric == "inner_product":
            return np.where(bound > 0, bound / (q * high), bound / (q * low))
        f = lambda x: (q * q + x * x - bound) / (2 * q * x)
        turn = np.clip(np.sqrt(np.maximum(q * q - bound, 0)), low, high)
        return np.minimum(np.minimum(f(low), f(high)), f(turn))


def scores(metric: str, rows: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Greater is better; rounded to 9 decimals, so that equal vectors tie whatever their place in a batch."""
    dots = np.einsum("ij,j->i", rows, query)
    if metric == "cosine":
        return np.round(dots / (norms * np.sqrt(query @ query)), 9)
    if metric == "l2":
        return np.round(-np.einsum("ij,ij->i", rows - query, rows - query), 9)
    return np.round(dots, 9)


class MultiIndex:
    """Codes cut into substrings of about log2(rows) bits, each with a table from its values to the rows that hold them.

    Of all codes within Hamming distance r of a query, each agrees with it in some of the m substrings to within r // m bits
    (pigeonhole), so that looking up every value that near finds them all.
    """

    def __init__(self, bits: np.ndarray) -> None:
        n, total = bits.shape
        self.words = pack(bits)
        width = int(np.clip(np.ceil(np.log2(max(n, 2))), 6, 16))
        self.cuts = np.array_split(np.arange(total), -(-total // width))
        self.tables = []
        for cut in self.cuts:
            value = bits[:, cut] @ (1 << np.arange(len(cut)))
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << len(cut)))])))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def _near(self, width: int, most: int) -> np.ndarray:
        if (width, most) not in self.masks:
            self.masks[width, most] = np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64)
        return self.masks[width, most]

    def distances(self, word: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return np.bitwise_count(self.words[rows] ^ word).sum(axis=1)

    def within(self, bit: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of every code within the radius. Where there would be more look-ups than rows, the same codes are
        found by passing over all of them."""
        most = radius // len(self.cuts)
        looks = sum(_choices(len(c), most) for c in self.cuts)
        if looks >= len(self.words):
            far = self.distances(word, slice(None))
            rows = np.flatnonzero(far <= radius)
            return rows, far[rows]
        found = []
        for cut, (order, starts) in zip(self.cuts, self.tables):
            value = int(bit[cut] @ (1 << np.arange(len(cut)))) ^ self._near(len(cut), most)
            begin, size = starts[value], starts[value + 1] - starts[value]
            begin, size = begin[size > 0], size[size > 0]
            found.append(order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        hit = np.zeros(len(self.words), bool)
        hit[np.concatenate(found)] = True
        rows = np.flatnonzero(hit)
        far = self.distances(word, rows)
        return rows[far <= radius], far[far <= radius]


def _choices(width: int, most: int) -> int:
    from math import comb

    return sum(comb(width, k) for k in range(min(most, width) + 1))


def _units(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    return flat / norms[:, None], norms


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


class _Queries:
    """Queries of one space with their codes and what a vector must reach to be among the k best."""

    def __init__(self, queries: pd.DataFrame, sample: np.ndarray, sample_ids: np.ndarray) -> None:
        self.vectors = np.array(queries["vector"].tolist(), np.float64)
        self.ids, self.own, self.k, self.metric = (queries[c].to_numpy() for c in ("query_id", "vec_id", "k", "metric"))
        unit, self.norms = _units(self.vectors)
        seen, seen_norms = _units(sample)
        self.rotation = fit_codes(seen)
        self.radius = fit_radius(seen, self.rotation)
        self.bits = encode(unit, self.rotation)
        self.words = pack(self.bits)
        # the k-th best of the sample is no better than the k-th best of all
        self.bound = np.full(len(queries), -np.inf)
        for i in range(len(queries)):
            s = scores(self.metric[i], sample, seen_norms, self.vectors[i])[sample_ids != self.own[i]]
            if len(s) >= self.k[i] > 0:
                self.bound[i] = np.partition(s, -self.k[i])[-self.k[i]]

    def search(self, ids: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the best of these rows for every query."""
        unit, norms = _units(rows)
        index = MultiIndex(encode(unit, self.rotation))
        low, high = norms.min(), norms.max()
        out = []
        for i in range(len(self.ids)):
            metric, q, bound, k = self.metric[i], self.norms[i], self.bound[i], self.k[i]
            bound = bound - 2e-9 * max(1.0, abs(bound)) if np.isfinite(bound) else bound
            if metric == "l2":
                bound = -bound
            need = lambda lo, hi: np.nan_to_num(least_cosine(metric, bound, q, lo, hi), nan=-1.0)  # noqa: B023, E731
            whole = float(need(np.array(low), np.array(high)))
            if whole > 1 or k <= 0:
                continue
            near, far = index.within(self.bits[i], self.words[i], self._radius(np.array(whole)))
            least = need(norms[near], norms[near])
            near = near[(least <= 1 + 1e-12) & (far <= self._radius(least)) & (ids[near] != self.own[i])]
            if not len(near):
                continue
            s = scores(metric, rows[near], norms[near], self.vectors[i])
            best = np.lexsort((ids[near], -s))[:k]
            out += zip([int(self.ids[i])] * len(best), ids[near][best].tolist(), s[best].tolist())
        return out

    def _radius(self, cos: np.ndarray) -> np.ndarray:
        steps = len(self.radius) - 1
        return self.radius[np.clip(np.floor((np.clip(cos, -1, 1) + 1) / 2 * steps), 0, steps).astype(int)]


def _prepare(queries: pd.DataFrame, sample: pd.DataFrame) -> dict[str, _Queries]:
    made = {}
    for space, own in queries.groupby("space_id"):
        rows = sample[sample["space_id"] == space].sort_values("vec_id")
        made[space] = _Queries(own.reset_index(drop=True), np.array(rows["vector"].tolist(), np.float64), rows["vec_id"].to_numpy())
    return made


def nearest(valid: DataFrame, queries: DataFrame, sample: int = SAMPLE, block: int = BLOCK, spaces: int = SPACES) -> DataFrame:
    """(query_id, vec_id, rank_no, score): the k best other vectors of the space for each query, ties to the smaller vec_id.

    `valid` is what valid_vectors gives; `queries` has (query_id, space_id, vec_id, k, metric), the vec_id being that of a
    stored vector, which is left out itself. score: cosine, negated squared L2 distance or inner product.

    Codes are fitted on `sample` rows per space, chosen by a hash; every row is indexed. In each task the rows of a space get
    a MultiIndex, every query retrieves all codes within its Hamming radius and reranks them by their floats, and only its k
    best leave the task; vectors are not shuffled. The radius follows from the k-th best of the sample, which bounds the
    result, by way of the least cosine a vector of the given norm needs, so that one index serves all metrics; the Hamming
    distance at a cosine is bounded by the mean and SLACK standard deviations seen in the sample. Queries are broadcast in
    blocks of `block` rows and `spaces` spaces, whatever their number.

    Queries with nulls, an unknown metric or k, or without a valid vector give no rows; repeated query ids count once; fewer
    than k others give all there are. Empty in, empty out.
    """
    spark = valid.sparkSession
    kinds = "query_id long, vec_id long, score double"
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "space_id", F.col("vec_id").cast("long").alias("vec_id"), F.col("k").cast("int").alias("k"), F.lower(F.trim("metric")).alias("metric"))
    asked = asked.where(F.col("metric").isin(*METRICS) & (F.col("k") > 0)).dropna().groupBy("query_id").agg(F.min(F.struct("space_id", "vec_id", "k", "metric")).alias("r")).select("query_id", "r.*")
    asked = materialize(valid.select("space_id", "vec_id", "vector").join(checked_broadcast(materialize(asked, "asked")), ["space_id", "vec_id"]), "queries")
    sampled = sample_rows(valid, sample)
    sampled = materialize(sampled.join(asked.select("space_id").distinct(), "space_id", "left_semi"), "sample")

    parts = []
    plan = [(r.space_id, r["count"]) for r in asked.groupBy("space_id").count().orderBy("space_id").toLocalIterator()]
    groups: list[list[str]] = []
    size = 0
    for space, n in plan:
        if not groups or size + n > block or len(groups[-1]) >= spaces:
            groups.append([])
            size = 0
        groups[-1].append(space)
        size += n
    for group in groups:
        some = asked.where(F.col("space_id").isin(group))
        total = sum(n for s, n in plan if s in group)
        chosen = sampled.where(F.col("space_id").isin(group)).toPandas()
        slices = -(-total // block)
        for i in range(slices):
            own = some if slices == 1 else some.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
            frame = own.toPandas()
            if len(frame):
                shared = spark.sparkContext.broadcast(_prepare(frame, chosen))
                part = valid.where(F.col("space_id").isin(group)).select("space_id", "vec_id", "vector").mapInArrow(_searcher(shared), kinds)
                if slices > 1 or len(groups) > 1:  # one block of queries is held at a time
                    part = materialize(part, "block")
                    shared.unpersist()
                parts.append(part)
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, rank_no int, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    limits = checked_broadcast(asked.select("query_id", "k"))
    return found.withColumn("rank_no", F.row_number().over(order)).join(limits, "query_id").where("rank_no <= k").select("query_id", "vec_id", (F.col("rank_no") - 1).cast("int").alias("rank_no"), "score")


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            out = []
            names = t.column("space_id").to_numpy()
            for space in pd.unique(names):
                rows = t.filter(pa.array(names == space))
                out += asked[space].search(rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks()))
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n * max(len(b.column(2).flatten()) // max(b.num_rows, 1), 1) >= ROWS * BITS // 4:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return search
