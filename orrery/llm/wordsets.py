"""Word sets of records: exact Jaccard links, classes of equal sets and connected groups, shared by the overlap operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.words import words
from orrery.runtime import checked_broadcast, materialize

#: Least similarity, least number of distinct words, and the share of records from which a word counts as common.
SIMILARITY, MIN_WORDS, COMMON = 0.8, 8, 0.05
_KNOWN = 1_000_000


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each 64-bit value under a seed (splitmix64's finaliser, public constants)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Hasher:
    """Turns texts into flat arrays of their distinct words' 64-bit hashes. Known words are kept up to a bound."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.hashes: list[int] = []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, sizes): the distinct words of all texts in a row, and how many each text has (0 for null)."""
        if len(self.ids) > _KNOWN:
            self.ids, self.hashes = {}, []
        ids, hashes, flat, sizes = self.ids, self.hashes, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = set(words(text))
                sizes[i] = len(own)
                try:
                    flat.extend([ids[w] for w in own])
                except KeyError:
                    for w in own:
                        if w not in ids:
                            ids[w] = len(hashes)
                            hashes.append(xxhash.xxh64_intdigest(w))
                    flat.extend([ids[w] for w in own])
        return np.array(hashes, np.uint64)[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64), sizes


def segments(ok: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each kept element, kept elements of each row) for flat values of which `ok` says which are kept."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    take = ok & keep[row]
    return row[take], np.bincount(row[take], minlength=len(sizes))


def texts_of(records: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    return records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *extra).where("id is not null and text is not null")


def common_words(texts: DataFrame, share: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shares), sorted by hash: the words that at least `share` of all records hold, counted over all of them.

    There are at most (mean distinct words / share) such words whatever the size, so the driver may hold them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows, totals = Hasher(), 0, {}
        for b in batches:
            h, _ = hasher(b.column(0).to_pylist())
            rows += b.num_rows
            for word, n in zip(*(x.tolist() for x in np.unique(h.view(np.int64), return_counts=True))):
                totals[word] = totals.get(word, 0) + n
            if len(totals) > _KNOWN:
                yield pa.RecordBatch.from_pydict({"word": pa.array(totals.keys(), pa.int64()), "n": pa.array(totals.values(), pa.int64())})
                totals = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array([*totals.keys(), None], pa.int64()), "n": pa.array([*totals.values(), rows], pa.int64())})

    counted = materialize(texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.where("word is null").select(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    held = counted.where((F.col("n") >= max(2.0, share * total)) & F.col("word").isNotNull()).select("word", "n").toPandas()
    hashes = held["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], held["n"].to_numpy(float)[order] / max(total, 1)


def is_common(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return common[at] == h


def set_hash(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set of words, independent of their order."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(mix(h, 77), starts) ^ mix(sizes[full].astype(np.uint64), 78)
    return out.view(np.int64)


def one_version(prints: DataFrame) -> DataFrame:
    """`prints` (id, set_hash, ..) with one set for each id: where rows of an id differ, the set with the smallest hash counts."""
    ends = prints.groupBy("id").agg(F.min("set_hash").alias("keep"), F.max("set_hash").alias("last"))
    several = materialize(ends.where("keep <> last").select("id", "keep"), "versions")
    if several.isEmpty():
        return prints
    return prints.join(checked_broadcast(several), "id", "left").where("keep is null or keep = set_hash").drop("keep")


def word_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, words): the sorted distinct word hashes of the records whose id is in `wanted` (id)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            h, sizes = hasher(b.column(1).to_pylist())
            arr = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(set_hash(h, sizes)), arr], names=["id", "set_hash", "words"])

    return texts.join(checked_broadcast(wanted), "id", "left_semi").select("id", "text").mapInArrow(hashed, "id long, set_hash long, words array<long>").groupBy("id").agg(F.min_by("words", "set_hash").alias("words"))


def exact_links(texts: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `pairs` (a, b, record ids, no repeats) whose word sets have a Jaccard index of at least `similarity`."""
    wanted = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = materialize(word_sets(texts, wanted), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    return both.where(F.col("common") >= similarity * (F.size("wa") + F.size("wb") - F.col("common")) - 1e-9).select(*pairs.columns)


def connected_groups(edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id reachable from every id in `edges` (a, b).

    Large-star and small-star steps (Kiveris et al. 2014) over the distributed edge list until it is stable, each round's
    result written to the shared folder. Nothing but a count comes to the driver.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour points to the smallest neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour and the node itself point to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "edges")
        # neither has repeats, so that as many rows and none that is new are the same rows
        if new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty():
            break
        e = new
    roots = new.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct()
    return new.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(roots)
