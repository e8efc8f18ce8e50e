"""Long exact spans shared between records: a log-structured index of window hashes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.wordsets import mix
from orrery.runtime import checked_broadcast, materialize, shared_dir
from orrery.sources.files import exists, read_text, remove, write_text

#: Characters of a span, of a hashed window and of the context hashed on either side; batches a collection is indexed in.
SPAN, WINDOW, SIDE, BATCHES = 300, 200, 50, 4
_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1_000_000


def rolling(chars: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of `size` characters, put together from windows of powers of two."""
    with np.errstate(over="ignore"):
        part = mix(chars.astype(np.uint64), 5)
        out, at, length, bits = None, 0, 1, size
        power = np.uint64(_BASE)
        while bits:
            if bits & 1:
                n = len(chars) - size + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                piece = part[at : at + n]
                out = piece.copy() if out is None else out * power + piece
                at += length
            bits >>= 1
            if bits:
                part = part[:-length] * power + part[length:] if len(part) > length else part[:0]
                power, length = power * power, length * 2
    return out


def _least(x: np.ndarray, size: int, op=np.minimum) -> np.ndarray:
    """op over every window of `size` values."""
    length = 1
    while length * 2 <= size:
        x, length = op(x[:-length], x[length:]), length * 2
    return op(x[: len(x) - (size - length)], x[size - length :]) if size > length else x


def selected(chars: np.ndarray, span: int = SPAN, window: int = WINDOW, side: int = SIDE) -> tuple[np.ndarray, ...]:
    """(place, hash, left, right) of the windows kept for a text, so that two texts that share `span` characters keep a common
    one: of any span - window + 1 windows in a row the least by hash, the last of equals (winnowing, Schleimer et al. 2003).
    left and right hash the `side` characters before and after, 0 where the text ends."""
    h = rolling(chars, window)
    run = span - window + 1
    if len(h) < run:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 3
    place = np.arange(len(h))
    key = (mix(h, 9) & np.uint64(2**64 - 2**20)) | (np.uint64(2**20 - 1) - (place & (2**20 - 1)).astype(np.uint64))
    least = _least(key, run)
    at = np.unique(np.searchsorted(place, np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))))
    low = least[at]
    # the place of each minimum: the last bits name it within its million
    spot = (np.uint64(2**20 - 1) - (low & np.uint64(2**20 - 1))).astype(np.int64) + (at >> 20 << 20)
    spot = np.where(spot < at, spot + 2**20, spot)
    spot = np.unique(spot)
    around = rolling(chars, side)
    left = np.where(spot >= side, around[np.maximum(spot - side, 0)], np.uint64(0))
    after = spot + window
    right = np.where(after + side <= len(chars), around[np.minimum(after, len(around) - 1)], np.uint64(0))
    return spot, h[spot], left, right


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(docs: DataFrame, span: int, window: int, side: int) -> DataFrame:
    """(hash, id, place, left, right) of the kept windows of every document (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = b.column(0).to_numpy(), []
            for i, text in enumerate(b.column(1).to_pylist()):
                kept = selected(_chars(text), span, window, side)
                parts.append((np.full(len(kept[0]), ids[i]), *kept))
            doc, place, h, left, right = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["hash", "id", "place", "left", "right"])

    return docs.mapInArrow(scan, "hash long, id long, place int, left long, right long")


class FingerprintIndex:
    """Immutable runs of window hashes, each a table bucketed and sorted by hash, so that joins with it need no exchange.

    `add` writes a batch as a run, merge-joins it with itself and every earlier run, and compacts: runs of one level are
    merged into one of the next, so that a collection of b batches has log2(b) runs. With `root` the runs lie there and stay,
    listed in its index.json, so that a later session opens the index and adds to it; else they lie in the shared folder
    and go with `close`. One writer at a time.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, root: str | None = None) -> None:
        self.spark, self.root, self.runs = spark, root, []
        self.places: dict[str, str] = {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if root and exists(spark, f"{root}/index.json"):
            held = json.loads(read_text(spark, f"{root}/index.json"))
            self.buckets = held["buckets"]
            self.runs = [(run["level"], self._open(run["folder"])) for run in held["runs"]]

    def _open(self, folder: str) -> str:
        """The table of a run that was written before, under a name of this session."""
        name = f"orrery_run_{uuid.uuid4().hex}"
        self.places[name] = folder
        self.spark.sql(f"CREATE TABLE {name} (hash BIGINT, id BIGINT, place INT, left BIGINT, right BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'")
        return name

    def _write(self, rows: DataFrame) -> str:
        name = f"orrery_run_{uuid.uuid4().hex}"
        self.places[name] = name
        rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.root or shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _list(self) -> None:
        if self.root:
            write_text(self.spark, f"{self.root}/index.json", json.dumps({"buckets": self.buckets, "runs": [{"level": level, "folder": self.places[name]} for level, name in self.runs]}))

    def add(self, rows: DataFrame) -> list[DataFrame]:
        """Index a batch; the candidates (a, b, at_a, at_b, sides) between it and everything indexed so far, itself included."""
        new = self._write(rows)
        found = []
        for _, run in [*self.runs, (0, new)]:
            a = self.spark.table(run).select("hash", F.col("id").alias("x"), F.col("place").alias("px"), F.col("left").alias("lx"), F.col("right").alias("rx"))
            b = self.spark.table(new).select("hash", F.col("id").alias("y"), F.col("place").alias("py"), F.col("left").alias("ly"), F.col("right").alias("ry"))
            sides = ((F.col("lx") == F.col("ly")) & (F.col("lx") != 0)).cast("int") + ((F.col("rx") == F.col("ry")) & (F.col("rx") != 0)).cast("int")
            pairs = a.hint("merge").join(b, "hash").where(F.col("x") < F.col("y") if run == new else F.col("x") != F.col("y")).withColumn("sides", sides).where("sides > 0")
            first = F.col("x") < F.col("y")
            found.append(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("px")).otherwise(F.col("py")).alias("at_a"), F.when(first, F.col("py")).otherwise(F.col("px")).alias("at_b"), "sides"))
        found = [materialize(f, "spans") for f in found]
        self.runs.append((0, new))
        gone = []
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, x), (_, y) = self.runs[-1], self.runs[-2]
            merged = self._write(self.spark.table(x).unionByName(self.spark.table(y)))
            self.runs = [*self.runs[:-2], (level + 1, merged)]
            gone += [x, y]
        self._list()  # before the merged runs go: a list always names runs that are whole
        for old in gone:
            self._drop(old)
        return found

    def _drop(self, name: str, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if files:
            remove(self.spark, f"{self.root or shared_dir(self.spark)}/{self.places[name]}")

    def close(self) -> None:
        """Forget the tables of this session; runs below a root of their own stay."""
        for _, run in self.runs:
            self._drop(run, files=self.root is None)
        self.runs = []


def _reach(x: str, y: str, most: int) -> int:
    """How many of the first `most` characters of x and y are equal."""
    low, high = 0, min(len(x), len(y), most)
    if x[:high] == y[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
    return low


def _contexts(docs: DataFrame, places: DataFrame, span: int, window: int) -> DataFrame:
    """(id, place, context, lead): the text around each wanted place, all that a span around its window can need."""
    per = materialize(places.distinct().groupBy("id").agg(F.collect_list("place").alias("places")), "places")  # of one document
    cut = F.expr(f"transform(places, p -> struct(p as place, substring(text, greatest(p - {span - window}, 0) + 1, p + {span} - greatest(p - {span - window}, 0)) as context, least(p, {span - window}) as lead))")
    return docs.join(checked_broadcast(per), "id").select("id", F.inline(cut))


def _verify(pairs: DataFrame, docs: DataFrame, span: int, window: int) -> DataFrame:
    """The rows of `pairs` whose texts share `span` characters around the two places, compared character by character."""
    where = pairs.select(F.col("a").alias("id"), F.col("at_a").alias("place")).unionByName(pairs.select(F.col("b").alias("id"), F.col("at_b").alias("place")))
    text = materialize(_contexts(docs, where, span, window), "contexts")
    left = text.select(F.col("id").alias("a"), F.col("place").alias("at_a"), F.col("context").alias("ta"), F.col("lead").alias("la"))
    right = text.select(F.col("id").alias("b"), F.col("place").alias("at_b"), F.col("context").alias("tb"), F.col("lead").alias("lb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for ta, la, tb, lb in zip(*(b.column(c).to_pylist() for c in ("ta", "la", "tb", "lb"))):
                ahead = _reach(ta[la:], tb[lb:], span)
                ok.append(ahead >= window and ahead + _reach(ta[:la][::-1], tb[:lb][::-1], span) >= span)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b", "at_a", "at_b")], names=["a", "b", "at_a", "at_b"])

    return pairs.select("a", "b", "at_a", "at_b").join(left, ["a", "at_a"]).join(right, ["b", "at_b"]).mapInArrow(compare, "a long, b long, at_a int, at_b int")


def _distinct_texts(documents: DataFrame, id_col: str, text_col: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(docs, members): (id, text) of one document of each text, and (rep, id) of all; texts under `span` characters left out."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").where(F.length("text") >= span)
    keys = materialize(docs.select("id", F.md5("text").alias("digest")).distinct(), "digests")
    reps = keys.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = materialize(keys.join(reps.where("n > 1"), "digest").select("rep", "id"), "copies")
    return docs.join(checked_broadcast(copies.where("id <> rep").select("id")), "id", "left_anti"), copies


def candidates(docs: DataFrame, span: int, window: int, side: int, batches: int) -> DataFrame:
    """(a, b, at_a, at_b, sides) of all kept windows that two documents have in common, indexed batch by batch."""
    index = FingerprintIndex(docs.sparkSession)
    hashes = materialize(window_hashes(docs, span, window, side), "hashes")
    cuts = hashes.approxQuantile("id", [i / batches for i in range(1, batches)], 0.05) if batches > 1 else []
    found, low = [], None
    for high in [*cuts, None]:
        part = hashes
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        found += index.add(part)
        low = high
    index.close()  # its results are written
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, window: int = WINDOW, side: int = SIDE, batches: int = BATCHES) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of documents that share a run of at least `span` characters, equal as stored.

    The kept windows of each text, about 2 in span - window + 2 characters, are certain to meet where a span is shared; what
    meets is compared character by character. Documents of one text form a class of which one is indexed; pairs are given out
    for all members, as the columns demand. Documents come in `batches` by id, each merge-joined with the runs before it.
    Null ids or texts and texts under `span` characters give no pairs; a repeated row of an id is not its own partner, and an
    id with several texts is taken with each of them. Empty in, empty out.
    """
    docs, copies = _distinct_texts(documents, id_col, text_col, span)
    found = candidates(docs, span, window, side, batches)
    best = materialize(found.groupBy("a", "b").agg(F.max(F.struct("sides", "at_a", "at_b")).alias("r")).select("a", "b", "r.*"), "best")
    sure = materialize(_verify(best, docs, span, window).select("a", "b").distinct(), "sure")
    doubt = materialize(best.join(sure, ["a", "b"], "left_anti").select("a", "b"), "doubt")
    links = sure
    if not doubt.isEmpty():
        again = materialize(found.join(doubt, ["a", "b"], "left_semi").select("a", "b", "at_a", "at_b").distinct(), "again")
        links = links.unionByName(_verify(again, docs, span, window).select("a", "b")).distinct()
    links = materialize(links, "spanlinks")
    left = copies.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = copies.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    apart = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    equal = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return apart.unionByName(equal).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_amounts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, window: int = WINDOW, side: int = SIDE, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part, n_spans) of every document that shares a span with another.

    Each common window is extended to the longest equal run in both texts; runs of at least `span` characters are merged per
    document. A document of which there are equal copies is shared whole. Otherwise as shared_spans.
    """
    docs, copies = _distinct_texts(documents, id_col, text_col, span)
    found = candidates(docs, span, window, side, batches)
    gap = span - window + 1  # kept windows of one run lie closer, so that one of each stretch is extended
    order = Window.partitionBy("a", "b", "shift").orderBy("at_a")
    lead = found.withColumn("shift", F.col("at_a") - F.col("at_b")).withColumn("prev", F.lag("at_a").over(order)).where(F.col("prev").isNull() | (F.col("at_a") - F.col("prev") > gap))
    lead = materialize(lead.select("a", "b", "at_a", "at_b"), "stretches")
    wanted = materialize(lead.select(F.col("a").alias("id")).unionByName(lead.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = materialize(docs.join(checked_broadcast(wanted), "id", "left_semi"), "texts")

    def extend(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches_:
            out = []
            for a, b, pa_, pb, ta, tb in zip(*(r.column(c).to_pylist() for c in ("a", "b", "at_a", "at_b", "ta", "tb"))):
                ahead = _reach(ta[pa_:], tb[pb:], len(ta))
                back = _reach(ta[:pa_][::-1], tb[:pb][::-1], len(ta))
                if ahead + back >= span:
                    out += [(a, pa_ - back, pa_ + ahead), (b, pb - back, pb + ahead)]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "begin", "end"])

    both = lead.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    runs = both.mapInArrow(extend, "id long, begin int, end int").distinct()
    whole = docs.join(checked_broadcast(copies.select(F.col("rep").alias("id")).distinct()), "id", "left_semi").select("id", F.lit(0).alias("begin"), F.length("text").alias("end"))
    at = Window.partitionBy("id").orderBy("begin", "end")
    seen = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    merged = runs.unionByName(whole).withColumn("seen", F.coalesce(seen, F.lit(0))).withColumn("own", F.greatest(F.col("end") - F.greatest("begin", "seen"), F.lit(0))).withColumn("new", (F.col("begin") > F.col("seen")) | (F.col("seen") == 0))
    per = merged.groupBy("id").agg(F.sum("own").alias("shared_chars"), F.sum(F.col("new").cast("int")).alias("n_spans"))
    sized = per.join(docs.select("id", F.length("text").alias("n_chars")), "id")
    every = sized.join(copies.select(F.col("rep").alias("id"), F.col("id").alias("copy")), "id", "left")
    return every.select(F.coalesce("copy", "id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_part"), "n_spans").dropDuplicates(["doc_id"])
