"""Near-duplicate records with small edits: BK-trees over Hamming fingerprints of word sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.wordsets import MIN_WORDS, SIMILARITY, Hasher, common_words, connected_groups, exact_links, mix, one_version, set_hash, texts_of
from orrery.runtime import checked_broadcast, materialize

#: Bits of a fingerprint, records beyond which a shard is cut by one more word, words of a shard key at most, and the share of
#: records from which words are ordered by how many hold them (rarer ones come before them, in hash order).
BITS, HOT, DEPTH, COUNTED = 128, 512, 4, 0.0002


class BKForest:
    """BK-trees of many shards at once: a child is filed under its Hamming distance to the parent, and a search follows only the
    edges within the radius of its own distance (triangle inequality).

    Rows stand shard by shard; those with `stored` make up the tree of their shard, in their order, the first one being the
    root. All trees grow and are searched together, a level of each at a time, so that thousands of small shards cost a few
    array operations.
    """

    def __init__(self, shard: np.ndarray, codes: np.ndarray, stored: np.ndarray | None = None) -> None:
        self.codes, n = codes, len(shard)
        self.shard_of = np.cumsum(np.concatenate([[0], np.diff(shard) != 0])) if n else np.zeros(0, np.int64)
        stored = np.ones(n, bool) if stored is None else stored
        rows = np.flatnonzero(stored)
        self.root = np.full(int(self.shard_of[-1]) + 1 if n else 0, -1)
        first, at = np.unique(self.shard_of[rows], return_index=True)
        self.root[first] = rows[at]
        todo = np.setdiff1d(rows, rows[at], assume_unique=True)
        node = self.root[self.shard_of[todo]]
        edges, children = [], []
        while len(todo):
            edge = node * 256 + self.distance(todo, node)
            # the first row of each edge becomes the child, the others go on from it
            key, at, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(key)
            children.append(todo[at])
            stay = np.ones(len(todo), bool)
            stay[at] = False
            todo, node = todo[stay], todo[at][which][stay]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[x] ^ self.codes[y]).sum(axis=1).astype(np.int64)

    def within(self, queries: np.ndarray, radius: np.ndarray, earlier: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, distance) of rows in the queries' shards within their radius, level by level; with `earlier` only rows
        that stand before the query, whose subtrees hold later rows alone."""
        node = self.root[self.shard_of[queries]]
        keep = (node >= 0) & ((node < queries) | (not earlier))
        query, node, most = queries[keep], node[keep], radius[keep]
        while len(query):
            d = self.distance(query, node)
            near = d <= most
            yield query[near], node[near], d[near]
            low = np.searchsorted(self.edges, node * 256 + np.maximum(d - most, 0))
            size = np.searchsorted(self.edges, node * 256 + np.minimum(d + most, 255), side="right") - low
            child = self.children[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            query, most = np.repeat(query, size), np.repeat(most, size)
            keep = (child < query) | (not earlier)
            query, node, most = query[keep], child[keep], most[keep]


def radius(na: int, nb: int, similarity: float = SIMILARITY) -> int:
    """The most words by which two sets of these sizes can differ at this similarity; fingerprints differ by no more."""
    return int((na + nb) * (1 - similarity) / (1 + similarity) + 1e-9)


def width(n, similarity: float = SIMILARITY):
    """Among how many of the first words of a set of size n the first word shared with a similar set stands."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def prefix_keys(h: np.ndarray, sizes: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many each row has): the first words of every row in one order of all words, the rarest first.

    Sets of sizes na and nb share at least `similarity` * max(na, nb) words, so the first word they share stands among the
    first n - ceil(similarity * n) + 1 of either, and the i-th one among the first n - ceil(similarity * n) + i: DEPTH - 1
    words more are given.
    """
    words, shares = order
    row = np.repeat(np.arange(len(sizes)), sizes)
    share = np.zeros(len(h))
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        share = np.where(words[at] == h, shares[at], 0.0)
    place = np.lexsort((mix(h, 7), share, row))
    count = np.minimum(np.where(sizes > 0, width(sizes, similarity) + DEPTH - 1, 0), sizes)
    rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return h[place][rank < count[row]].view(np.int64), count


def fingerprints(texts: DataFrame, order: tuple[np.ndarray, np.ndarray], min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, set_hash, n, f0, f1, keys) of the records with at least `min_words` distinct words.

    f0, f1: a fingerprint of BITS bits, each word flipping the bit it hashes to (an odd sketch), so that the Hamming
    distance of two fingerprints never exceeds the number of words in which the sets differ. keys: see prefix_keys; `order`
    has the hashes and shares of the words that are counted.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(order)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            h, sizes = hasher(b.column(1).to_pylist())
            keep = sizes >= min_words
            rows = np.flatnonzero(keep)
            row = np.repeat(np.arange(len(sizes)), sizes)
            bit = mix(h, 101) % np.uint64(BITS)
            flips = np.zeros((len(sizes), BITS), np.uint8)
            np.bitwise_xor.at(flips, (row, bit.astype(np.int64)), 1)
            code = np.packbits(flips, axis=1).view(np.int64)
            flat, count = prefix_keys(h[keep[row]], np.where(keep, sizes, 0), shared.value, similarity)
            ends = np.cumsum(count[rows])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(set_hash(h, sizes)[rows]), pa.array(sizes[rows], pa.int32()), pa.array(np.ascontiguousarray(code[rows, 0])), pa.array(np.ascontiguousarray(code[rows, 1])), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))],
                names=["id", "set_hash", "n", "f0", "f1", "keys"],
            )

    return texts.select("id", "text").mapInArrow(prints, "id long, set_hash long, n int, f0 long, f1 long, keys array<long>")


_ROWS = ("key", "a", "n", "f0", "f1", "place", "stored")
_KINDS = "a long, b long, key long, n int, f0 long, f1 long, place int"


def _forest_links(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the records of whole shards (the columns _ROWS, sorted by key) that lie within the radius.

    place: where the last word of the key stands in the record, less the words before it in the key: from there on two
    records share as many words as the shorter rest holds, if they share none before but those of the key.
    """
    key, item, n, place, stored = (rows[:, i] for i in (0, 1, 2, 5, 6))
    ratio = (1 - similarity) / (1 + similarity)
    forest = BKForest(key, np.ascontiguousarray(rows[:, 3:5]).view(np.uint64), stored > 0)
    whole = bool((stored > 0).all())
    queries = np.arange(len(rows)) if whole else np.flatnonzero(stored == 0)
    most = np.minimum(np.floor(n * (1 + 1 / similarity) * ratio + 1e-9), BITS).astype(np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for x, y, far in forest.within(queries, most[queries], earlier=whole):
        both = n[x] + n[y]
        ok = (far <= both * ratio + 1e-9) & (item[x] != item[y])
        if whole:
            ok &= np.minimum(n[x] - place[x], n[y] - place[y]) >= both * (similarity / (1 + similarity)) - 1e-9
        found.append(np.column_stack([np.minimum(item[x[ok]], item[y[ok]]), np.maximum(item[x[ok]], item[y[ok]])]))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _shard_links(batches: Iterator[pa.RecordBatch], similarity: float, hot: int) -> Iterator[pa.RecordBatch]:
    """Reads _ROWS sorted by key; gives (a, b) of all in a key that lie within the radius, by BK-trees. Rows of keys with more
    than `hot` records are not held but come out as (a, null, key, ..) for another treatment."""

    def emit(**cols):
        n = len(cols["a"])
        kinds = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "n": pa.int32(), "f0": pa.int64(), "f1": pa.int64(), "place": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in kinds.items()], names=[*kinds])

    def links(runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # shards are taken together until they may have some millions of pairs
        low, pairs = 0, 0
        for i, run in enumerate(runs):
            pairs += len(run) ** 2
            if pairs > 4_000_000 or i == len(runs) - 1:
                a, b = _forest_links(np.concatenate(runs[low : i + 1]), similarity)
                if len(a):
                    yield emit(a=a, b=b)
                low, pairs = i + 1, 0

    left = np.zeros((0, len(_ROWS)), np.int64)
    open_hot: int | None = None
    for b in batches:
        now = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(_ROWS))])
        rows = np.concatenate([left, now])
        if not len(rows):
            continue
        cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
        last = int(starts[-1])
        use = (ends - starts > 1) | (starts == last)
        if open_hot is not None:
            use |= rows[starts, 0] == open_hot
        runs, passed = [], []
        for s, e in zip(starts[use].tolist(), ends[use].tolist()):
            if e - s > hot or rows[s, 0] == open_hot:
                passed.append(rows[s:e])
                open_hot = int(rows[s, 0])
            elif s != last:
                runs.append(rows[s:e])
        left = rows[:0] if open_hot == rows[last, 0] else rows[last:]
        yield from links(runs)
        if passed:
            p = np.concatenate(passed)
            yield emit(a=p[:, 1], key=p[:, 0], n=p[:, 2], f0=p[:, 3], f1=p[:, 4], place=p[:, 5])
    if len(left) > 1:
        yield from links([left])


def _trees(rows: DataFrame, similarity: float, hot: int, name: str = "links") -> DataFrame:
    """_shard_links of rows (key, id, n, f0, f1, place[, stored])."""
    stored = F.col("stored") if "stored" in rows.columns else F.lit(1)
    keyed = rows.select("key", F.col("id").alias("a"), "n", "f0", "f1", "place", stored.alias("stored"))
    return materialize(keyed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(lambda it: _shard_links(it, similarity, hot), _KINDS), name)


def _finer(classes: DataFrame, crowded: DataFrame, level: int) -> DataFrame:
    """The rows of hot shards of `level` words (id, key, place) under keys of one word more: each of those behind the last one
    of the key at which a similar set can go on."""
    own = crowded.join(classes, "id")
    spot = F.col("place") + (level - 1)  # place is less the words before it
    words = F.slice("keys", spot + 2, F.greatest(F.col("width") + (level - 1) - spot, F.lit(0)))
    return own.select("id", "n", "f0", "f1", F.col("key").alias("old"), F.col("place"), F.posexplode(words).alias("i", "word")).select(F.xxhash64("old", "word").alias("key"), "id", "n", "f0", "f1", (F.col("place") + F.col("i")).cast("int").alias("place"))


def _crowd_links(texts: DataFrame, hot: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Exact links of shards that no further word cuts up: every record with the shard's first, then those not linked to it
    with all of the shard, through BK-trees over chunks of it.

    Records linked to the first are connected already and need no links among themselves. A chunk's tree is met by as many
    of the others at a time as it holds itself, so that no task holds a shard.
    """
    ratio = (1 - similarity) / (1 + similarity)
    pivot = hot.groupBy("key").agg(F.min(F.struct("id", "n", "f0", "f1")).alias("p")).select("key", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.f0").alias("pf0"), F.col("p.f1").alias("pf1"))
    far = F.bit_count(F.col("f0").bitwiseXOR(F.col("pf0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("pf1")))
    pivots = checked_broadcast(materialize(pivot, "pivots"))
    near = hot.join(pivots, "key").where(F.col("id") > F.col("pid")).where(far <= (F.col("n") + F.col("pn")) * ratio + 1e-9)
    first = materialize(exact_links(texts, materialize(near.select(F.col("pid").alias("a"), F.col("id").alias("b")).distinct(), "crowdpairs"), similarity), "crowdfirst")
    done = first.select(F.col("a").alias("pid"), F.col("b").alias("id"))
    rest = materialize(hot.join(pivots, "key").where("id > pid").join(done, ["pid", "id"], "left_anti").select("key", "id", "n", "f0", "f1"), "crowdrest")
    parts = lambda d, name: d.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))
    sizes = checked_broadcast(materialize(parts(hot, "chunks").join(parts(rest, "askers"), "key"), "crowdsizes"))
    salt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    stored = hot.join(sizes, "key").select("key", "id", "n", "f0", "f1", salt("chunks", 1).alias("s"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("t"), F.lit(1).alias("stored"))
    asked = rest.join(sizes, "key").select("key", "id", "n", "f0", "f1", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("s"), salt("askers", 2).alias("t"), F.lit(0).alias("stored"))
    rows = stored.unionByName(asked).withColumn("key", F.xxhash64("key", "s", "t")).withColumn("place", F.lit(0))
    pairs = _trees(rows, similarity, 1 << 40, "crowdlinks").where("b is not null").select("a", "b").distinct()
    return first.unionByName(exact_links(texts, materialize(pairs, "crowdpairs"), similarity))


def similar_groups(records: DataFrame, id_col: str = "sample_id", text_col: str = "x", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(group_id, sample_id): records whose word sets have a Jaccard index of at least `similarity` to another's.

    Records with equal sets form a class, of which one stands for all; classes are linked when they share a shard key, lie
    within the radius in the shard's BK-tree and pass the exact check; linked classes form one group, named by its smallest
    id. No pair is lost: fingerprints are exact lower bounds of the difference, and similar sets share one of their rarest
    words, which are the shard keys. Trees are built where a shard's rows are gathered and not broadcast, as they grow with
    the data. A shard of more than `hot` records is cut up by the next word that its similar records share (see _finer), up
    to DEPTH words; what is then still crowded shares its rarest words and is mostly one group (see _crowd_links). Records with
    a null id or text or fewer than `min_words` distinct words belong to no group, which covers empty texts; texts count
    whole; repeated rows of an id are one record. No rows give no groups.
    """
    texts = texts_of(records, id_col, text_col)
    prints = materialize(fingerprints(texts, common_words(texts, COUNTED), min_words, similarity), "prints")
    prints = one_version(prints)
    members = prints.select("set_hash", "id").distinct()
    reach = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    classes = prints.groupBy("set_hash").agg(F.min(F.struct("id", "n", "f0", "f1", "keys")).alias("r")).select("r.*").withColumn("width", reach)
    classes = materialize(classes, "classes")
    rows = classes.select("id", "n", "f0", "f1", F.posexplode(F.slice("keys", F.lit(1), F.col("width"))).alias("place", "key"))
    depth = min(DEPTH, int(np.ceil(similarity * min_words - 1e-9)))  # similar sets share so many words at least
    parts = []
    for level in range(1, depth + 1):
        raw = _trees(rows, similarity, hot)
        parts.append(raw.where("b is not null").select("a", "b"))
        crowded = raw.where("b is null").select("key", F.col("a").alias("id"), "n", "f0", "f1", "place")
        if crowded.isEmpty():
            break
        if level < depth:
            rows = _finer(classes.drop("n", "f0", "f1"), crowded, level)
        else:
            parts.append(_crowd_links(texts, crowded, similarity, hot))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    links = exact_links(texts, materialize(pairs.distinct(), "pairs"), similarity)
    groups = materialize(connected_groups(links), "groups")
    reps = members.groupBy("set_hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    named = reps.join(groups.withColumnRenamed("id", "rep"), "rep", "left").where("size > 1 or group is not null").select("set_hash", F.coalesce("group", "rep").alias("group_id"))
    return members.join(named, "set_hash").select("group_id", F.col("id").alias("sample_id")).distinct()
