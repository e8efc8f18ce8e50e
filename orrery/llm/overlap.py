"""Records of evaluation splits that stand again in training: Aho-Corasick automata over sharded evaluation passages."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.wordsets import MIN_WORDS, SIMILARITY, Hasher, common_words, exact_links, mix, one_version, set_hash, texts_of
from orrery.runtime import checked_broadcast, materialize

#: A word is CODE letters of 6 bits; passages per automaton; training pieces that one automaton reads, about; words of a passage
#: at most; share of records from which a word's commonness is told apart; words from which a form is cut evenly.
CODE, SHARD, PIECES, LONGEST, COMMON, WIDE = 3, 150_000, 120_000, 6, 0.02, 512
_LETTERS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+-", np.uint8)
_SPAN = 64**CODE


def spell(codes: np.ndarray) -> np.ndarray:
    """Each code as CODE ASCII letters, in one flat byte array."""
    return _LETTERS[(codes[:, None] >> (6 * np.arange(CODE - 1, -1, -1))) & 63].ravel()


def normalised(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], min_words: int = MIN_WORDS) -> DataFrame:
    """(id, train, held, set_hash, n, sketch, codes): texts in normal form, the sorted codes of their distinct words.

    The order is that of a hash of the word and the same in every record, so that neither the order of the words nor their
    repetition matters: two records with nearly the same words have long runs of codes in common. The last 8 bits of a code
    are the share of records that hold the word in steps of 1/255, 0 where it is not common. Every word flips a bit of `sketch`,
    so that two sketches differ in no more bits than the sets do in words. Records with fewer than
    `min_words` distinct words are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        words, shares = shared.value
        steps = np.maximum(np.floor(shares * 255), 1).astype(np.uint64)
        for b in batches:
            h, sizes = hasher(b.column(1).to_pylist())
            level = np.zeros(len(h), np.uint64)
            if len(words):
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                level = np.where(words[at] == h, steps[at], level)
            row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            flat = np.sort(row << np.uint64(6 * CODE + 8) | (h % np.uint64(_SPAN)) << np.uint64(8) | level)
            new = np.concatenate([[True], np.diff(flat >> np.uint64(8)) > 0]) if len(flat) else np.zeros(0, bool)
            flat = flat[new]  # two words of a record with one code are one
            per = np.bincount((flat >> np.uint64(6 * CODE + 8)).astype(np.int64), minlength=len(sizes))
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array((flat & np.uint64(2 ** (6 * CODE + 8) - 1)).astype(np.int32)))
            rows = pa.array(np.flatnonzero(sizes >= min_words))
            sketch = np.zeros(len(sizes), np.uint64)
            np.bitwise_xor.at(sketch, np.repeat(np.arange(len(sizes)), sizes), np.uint64(1) << (mix(h, 101) & np.uint64(63)))
            cols = [b.column(0), b.column(2), b.column(3), pa.array(set_hash(h, sizes)), pa.array(sizes, pa.int32()), pa.array(sketch.view(np.int64)), codes]
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in cols], names=["id", "train", "held", "set_hash", "n", "sketch", "codes"])

    return texts.select("id", "text", "train", "held").mapInArrow(normal, "id long, train boolean, held boolean, set_hash long, n int, sketch long, codes array<int>")


def passages(levels: np.ndarray, sizes: np.ndarray, n: np.ndarray, similarity: float = SIMILARITY, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the passages of normal forms that stand one after another in `levels`, `sizes` codes each.

    A similar record differs in at most (1 / similarity - 1) * n words, and each of them, lacking or additional, can break
    one of several disjoint runs of words. From each form one run more than that is taken, so that some run stands whole in
    every similar record: those that give the fewest chance matches in all, by dynamic programming over the runs of up to
    LONGEST words (all forms of a chunk at once). A rare word divides the chance by 2**8.5, a common one by 4. Forms of over
    WIDE words are cut into runs of equal length.
    """
    found = []
    starts = np.cumsum(sizes) - sizes
    for r in np.flatnonzero(sizes > WIDE).tolist():
        want = min(int((1 / similarity - 1) * n[r] + 1e-9) + 1, int(sizes[r]))
        edges = np.arange(want + 1) * int(sizes[r]) // want
        found.append((np.full(want, r), edges[:-1], np.minimum(edges[1:], edges[:-1] + LONGEST)))
    narrow = np.flatnonzero(sizes <= WIDE)
    starts, sizes, n = starts[narrow], sizes[narrow], n[narrow]
    for low in range(0, len(sizes), chunk):
        size = sizes[low : low + chunk]
        rows, width = len(size), int(size.max(initial=0))
        want = np.minimum(np.floor((1 / similarity - 1) * n[low : low + chunk] + 1e-9).astype(np.int64) + 1, size)
        if not width:
            continue
        column = np.arange(width)
        inside = column < size[:, None]
        held = np.zeros((rows, width + 1), np.float32)
        told = np.where(levels[np.minimum(starts[low : low + chunk, None] + column, len(levels) - 1)] == 0, 8.5, 2.0)
        held[:, 1:] = np.cumsum(np.where(inside, told, 0), axis=1)
        ends = np.arange(width + 1)
        chances = [np.exp2(held[:, :-k] - held[:, k:]) for k in range(1, min(LONGEST, width) + 1)]
        cost = np.zeros((rows, width + 1), np.float32)
        last, length = [], []
        for _ in range(int(want.max())):
            best, size_of = np.full((rows, width + 1), np.inf, np.float32), np.zeros((rows, width + 1), np.int8)
            for k, chance in enumerate(chances, 1):
                one = cost[:, :-k] + chance
                np.copyto(size_of[:, k:], np.int8(k), where=one < best[:, k:])
                np.minimum(best[:, k:], one, out=best[:, k:])
            best = np.where(ends <= size[:, None], best, np.inf)
            least = np.minimum.accumulate(best, axis=1)
            fresh = np.concatenate([np.ones((rows, 1), bool), best[:, 1:] < least[:, :-1]], axis=1)
            last.append(np.maximum.accumulate(np.where(fresh, ends, 0), axis=1).astype(np.int16))
            length.append(size_of)
            cost = least
        at = size.astype(np.int64).copy()
        for k in range(len(last) - 1, -1, -1):
            row = np.flatnonzero(want > k)
            end = last[k][row, at[row]].astype(np.int64)
            begin = end - length[k][row, end]
            found.append((narrow[low + row], begin, end))
            at[row] = begin
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def copies_of(shards: int, common: tuple[np.ndarray, np.ndarray], records: int, mean: float, pieces: int = PIECES) -> np.ndarray:
    """By how many tasks the training pieces of each shard are read, each with a copy of its automaton: about one for every
    `pieces` records that hold a word of the shard's range. Common words are counted, the others spread by their hash."""
    words, shares = common
    held = np.bincount(((words % np.uint64(_SPAN)).astype(np.int64) * shards // _SPAN), shares, minlength=shards)
    held = np.minimum(held + max(mean - shares.sum(), 0.0) / shards, 1.0)
    return np.maximum(np.ceil(records * held / pieces), 1).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], copies: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Normal forms as (task, kind, ids, n, sketches, sizes, letters), one row per batch, task and kind with all its pieces.
    The tasks of a shard follow each other: passages go to all of them, the training pieces of a batch to one.

    A shard is a range of codes. Kind 0, held out: the passages that begin in the range. Kind 1, training: the codes in the
    range and the LONGEST - 1 after them, in which every passage of the shard that the text holds stands whole.
    """
    shards, task = len(copies), np.cumsum(copies) - copies
    for b in batches:
        codes = b.column("codes")
        off = codes.offsets.to_numpy()
        flat, sizes = codes.values.to_numpy().astype(np.int64)[off[0] : off[-1]], np.diff(off)
        if not len(flat):
            continue
        level, flat = flat & 255, flat >> 8
        row = np.repeat(np.arange(b.num_rows), sizes)
        first_of = np.cumsum(sizes) - sizes
        shard = flat * shards // _SPAN
        train, held = (b.column(c).to_numpy(zero_copy_only=False) for c in ("train", "held"))
        ids, n, sketch = (b.column(c).to_numpy() for c in ("id", "n", "sketch"))
        start = np.flatnonzero(np.concatenate([[True], (np.diff(row) > 0) | (np.diff(shard) > 0)]))
        end = np.concatenate([start[1:], [len(flat)]])
        pick = train[row[start]]
        start, end = start[pick], end[pick]
        end = np.minimum(end + LONGEST - 1, (first_of + sizes)[row[start]])
        turn = int(mix(ids[:1].astype(np.uint64), 55)[0] >> np.uint64(33))
        yield from _pack(flat, start, end, (task + turn % copies)[shard[start]], 1, ids[row[start]], n[row[start]], sketch[row[start]])
        own = np.flatnonzero(held)
        r, start, end = passages(level[held[row]], sizes[own], n[own], similarity)
        start, end = start + first_of[own][r], end + first_of[own][r]
        times = copies[shard[start]]
        start, end = np.repeat(start, times), np.repeat(end, times)
        nth = np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
        yield from _pack(flat, start, end, task[shard[start]] + nth, 0, ids[row[start]], n[row[start]], sketch[row[start]])


def _pack(flat: np.ndarray, start: np.ndarray, end: np.ndarray, shard: np.ndarray, kind: int, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) > 0, [True]])) if len(order) else []
    rows = []
    for s, e in zip(bounds[:-1], bounds[1:]):
        o = order[s:e]
        size = end[o] - start[o]
        which = np.repeat(start[o] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rows.append((int(shard[o[0]]), kind, ids[o].tobytes(), n[o].astype(np.int32).tobytes(), sketch[o].tobytes(), size.astype(np.uint32).tobytes(), spell(flat[which]).tobytes()))
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["shard", "kind", "ids", "n", "sketches", "sizes", "letters"])


class PassageAutomaton:
    """An Aho-Corasick automaton over the passages of the held-out records in one shard."""

    def __init__(self) -> None:
        self.places: dict[str, list[tuple[int, int, int]]] = {}
        self.machine: ahocorasick.Automaton | None = None

    def add(self, record: int, n: int, sketch: int, passage: str) -> None:
        self.places.setdefault(passage, []).append((record, n, sketch))

    def scan(self, ids: list[int], sizes: list[int], sketches: list[int], ends: np.ndarray, letters: str, similarity: float) -> list[tuple[int, int, int]]:
        """(training id, held-out id, words matched) of every passage found in the pieces that stand one after another in
        `letters`. Matches that don't begin at a word or run over the end of a piece don't count, nor records whose sketches
        show more words to differ than the similarity allows."""
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for passage, places in self.places.items():
                self.machine.add_word(passage, (len(passage), places))
            if self.places:
                self.machine.make_automaton()
        if not self.places:
            return []
        hits = [(end, size, places) for end, (size, places) in self.machine.iter(letters) if (end + 1) % CODE == 0]
        piece = np.searchsorted(ends, np.array([h[0] for h in hits], np.int64), side="right")
        begin = np.concatenate([[0], ends])[piece]
        out, ratio = [], (1 - similarity) / (1 + similarity)
        for (end, size, places), i, first in zip(hits, piece.tolist(), begin.tolist()):
            if end + 1 - size >= first:
                t, n, own = ids[i], sizes[i], sketches[i]
                for record, held_n, sketch in places:
                    if (own ^ sketch).bit_count() <= (n + held_n) * ratio + 1e-9 and record != t:
                        out.append((t, record, size // CODE))
        return out


def _scan(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads packed pieces sorted by shard and kind: fills each shard's automaton, then runs the training pieces through it."""
    shard, machine = None, PassageAutomaton()
    for b in batches:
        out = []
        for at, kind, ids, n, sketches, sizes, letters in zip(*(c.to_pylist() for c in b.columns)):
            if at != shard:
                shard, machine = at, PassageAutomaton()
            ids, n, sketches = np.frombuffer(ids, np.int64).tolist(), np.frombuffer(n, np.int32).tolist(), np.frombuffer(sketches, np.uint64).tolist()
            sizes = np.frombuffer(sizes, np.uint32).astype(np.int64) * CODE
            ends, text = np.cumsum(sizes), letters.decode("ascii")
            if kind == 0:
                for record, words, sketch, e, size in zip(ids, n, sketches, ends.tolist(), sizes.tolist()):
                    machine.add(record, words, sketch, text[e - size : e])
            else:
                out += machine.scan(ids, n, sketches, ends, text, similarity)
        if out:
            cols = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32())], names=["train_id", "held_id", "words"])


def coverage(forms: DataFrame, common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0)), shard_size: int = SHARD, similarity: float = SIMILARITY, pieces: int = PIECES) -> DataFrame:
    """(train_id, held_id, covered): held-out records of which a training record holds passages, and how many words of theirs
    the matched passages cover. Passages of a record are disjoint, so that merging their intervals adds up their words. The
    range of a word that nearly every text holds is read by several tasks (see copies_of)."""
    passages_of = F.when(F.col("held"), F.floor((1 / similarity - 1) * F.col("n")) + 1)
    number, records, mean = forms.agg(F.coalesce(F.sum(passages_of), F.lit(0)), F.count(F.when(F.col("train"), 1)), F.coalesce(F.avg(F.when(F.col("train"), F.col("n"))), F.lit(0.0))).first()
    shards = min(max(6, -(-number // shard_size)), _SPAN // 64)
    copies = copies_of(shards, common, records, float(mean), pieces)
    shards = int(copies.sum())
    packed = forms.mapInArrow(lambda it: _cut(it, copies, similarity), "shard int, kind int, ids binary, n binary, sketches binary, sizes binary, letters binary")
    found = packed.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda it: _scan(it, similarity), "train_id long, held_id long, words int")
    return found.groupBy("train_id", "held_id").agg(F.sum("words").alias("covered"))


def cross_split_overlaps(records: DataFrame, id_col: str = "sample_id", text_col: str = "x", split_col: str = "split", train: str = "train", held: tuple[str, ...] = ("val", "test"), similarity: float = SIMILARITY, min_words: int = MIN_WORDS, shard_size: int = SHARD, pieces: int = PIECES) -> DataFrame:
    """(sample_id_a, sample_id_b): pairs of a training and a held-out record with a Jaccard index of at least `similarity`.

    Texts are brought to a normal form (see normalised); the passages of the held-out forms are sharded by ranges of their
    first word, and the automaton of each shard scans the pieces of all training forms that lie in its range, so every
    text is scanned once in all whatever the number of shards. Matches are merged into coverage per held-out record, and
    what is covered is checked exactly.

    Every similar record holds at least one passage of a record whole (see passages), so that every pair is found.

    Equal word sets form a class of which one record is matched; its pairs are given out for all members, as the columns
    demand pairs. Splits compare trimmed and in lower case, other or null splits take no part. Records with a null id or
    text or fewer than `min_words` distinct words, so empty texts too, do not count; repeated rows of an id count once. A
    record with rows of several splits takes part in each, but is never paired with itself.
    """
    found = overlaps(records, id_col, text_col, split_col, train, held, similarity, min_words, shard_size, pieces)
    return found.select(F.least("train_id", "held_id").alias("sample_id_a"), F.greatest("train_id", "held_id").alias("sample_id_b")).distinct()


def held_coverage(records: DataFrame, **options) -> DataFrame:
    """(held_id, n_words, train_records, covered, covered_part): every held-out record that a training record repeats, by how
    many of them, and how many of its words the matched passages of one cover at most (all where the word sets are equal; a
    lower bound otherwise, as only passages count that stand whole). Options and cases: see cross_split_overlaps."""
    per = overlaps(records, **options).groupBy("held_id").agg(F.max("held_words").alias("n_words"), F.countDistinct("train_id").alias("train_records"), F.max("covered").alias("covered"))
    return per.select("held_id", "n_words", "train_records", "covered", (F.col("covered") / F.col("n_words")).alias("covered_part"))


def overlaps(records: DataFrame, id_col: str = "sample_id", text_col: str = "x", split_col: str = "split", train: str = "train", held: tuple[str, ...] = ("val", "test"), similarity: float = SIMILARITY, min_words: int = MIN_WORDS, shard_size: int = SHARD, pieces: int = PIECES) -> DataFrame:
    """(train_id, held_id, held_words, covered) of the pairs that cross_split_overlaps gives."""
    split = F.lower(F.trim(split_col))
    texts = texts_of(records, id_col, text_col, F.coalesce(split == train, F.lit(False)).alias("train"), F.coalesce(split.isin(*held), F.lit(False)).alias("held")).where("train or held")
    common = common_words(texts, COMMON)
    forms = materialize(normalised(texts, common, min_words), "forms")
    forms = one_version(forms)
    sides = [F.max(c).alias(c) for c in ("train", "held", "n")]
    ids = forms.groupBy("set_hash", "id").agg(*sides)
    classes = ids.groupBy("set_hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    copies = materialize(ids.join(classes, "set_hash").select("rep", "id", "train", "held", "n"), "copies")
    roles = copies.groupBy(F.col("rep").alias("id")).agg(F.max("train").alias("t"), F.max("held").alias("h"))
    own = forms.join(checked_broadcast(copies.where("id <> rep").select("id").distinct()), "id", "left_anti").join(checked_broadcast(roles), "id", "left")
    own = own.select("id", F.coalesce("t", "train").alias("train"), F.coalesce("h", "held").alias("held"), "n", "sketch", "codes")
    pairs = materialize(coverage(own, common, shard_size, similarity, pieces).select(F.col("train_id").alias("a"), F.col("held_id").alias("b"), "covered"), "pairs")
    links = materialize(exact_links(texts, pairs, similarity), "links")
    in_train = copies.where("train").select(F.col("rep").alias("a"), F.col("id").alias("x"))
    in_held = copies.where("held").select(F.col("rep").alias("b"), F.col("id").alias("y"), "n")
    apart = links.join(in_train, "a", "left").join(in_held.drop("n"), "b", "left").join(own.select(F.col("id").alias("b"), "n"), "b").select(F.coalesce("x", "a").alias("train_id"), F.coalesce("y", "b").alias("held_id"), F.col("n").alias("held_words"), F.col("covered").cast("int").alias("covered"))
    equal = in_train.join(in_held, F.col("a") == F.col("b")).select(F.col("x").alias("train_id"), F.col("y").alias("held_id"), F.col("n").alias("held_words"), F.col("n").alias("covered"))
    return apart.unionByName(equal).where("train_id <> held_id")
