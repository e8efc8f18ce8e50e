"""Cross-split overlaps and near-duplicate groups against brute force, and their edge cases."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from orrery.llm import edits, overlap
from orrery.llm.words import words
from orrery.llm.wordsets import connected_groups

KINDS = "sample_id long, split string, x string, id long, text string, train boolean, held boolean, a int, set_hash string, keys int, n int"


def table(spark, rows):
    """Samples with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, s, x, 9, "z", None, True, 5, "h", 1, 2) for i, s, x in rows], KINDS)


def word_set(x):
    return frozenset(re.findall("[a-z0-9]+", x.lower())) if x else frozenset()


def similar(a, b):
    return len(a) >= 8 and len(b) >= 8 and len(a & b) >= 0.8 * len(a | b) - 1e-9


def made(n=400, seed=0):
    """Records with template words, rare words, copies and edited copies."""
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(25)]
    rare = [f"rare{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.35:
            w = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, 9)):
                at, what = rng.randrange(len(w)), rng.random()
                if what < 0.3:
                    w.insert(at, rng.choice(rare))
                elif what < 0.6 and len(w) > 9:
                    w.pop(at)
                elif what < 0.8:
                    w[at] = w[at].upper()
                else:
                    w[at], w[-1] = w[-1], w[at]
        else:
            size = rng.randrange(8, 70)
            w = [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(size)]
        rows.append((i, rng.choice(["train", "train", " Train", "val", "TEST ", None]), " ".join(w)))
    return rows


EDGES = [
    (9001, "train", None), (9002, "val", ""), (9003, "val", "a b c"), (None, "val", "one two three four five six seven eight"),
    (9004, "train", "one two three four five six seven eight"), (9005, "test", "Eight seven SIX five, four three two one!"), (9005, "test", "Eight seven SIX five, four three two one!"),
    (9006, "train", "w" * 50 + " " + " ".join(f"long{i}" for i in range(40_000))), (9007, "test", " ".join(f"long{i}" for i in range(100, 40_000)) + " more"),
    (9008, "val", " ".join(["again"] * 1000)), (9009, None, "one two three four five six seven eight"), (9010, "other", "one two three four five six seven eight"),
]


def brute_pairs(rows):
    sets = {(i, (s or "").strip().lower()): word_set(x) for i, s, x in rows if i is not None and x is not None}
    out = set()
    for (i, s), (j, t) in combinations(sets, 2):
        if i != j and (s == "train") != (t == "train") and {s, t} <= {"train", "val", "test"} and similar(sets[i, s], sets[j, t]):
            out.add((min(i, j), max(i, j)))
    return out


def brute_groups(rows):
    sets = {i: word_set(x) for i, _, x in rows if i is not None and x is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = set()
    for i, j in combinations(sets, 2):
        if similar(sets[i], sets[j]):
            linked |= {i, j}
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {(root(i), i) for i in linked}


def test_words():
    assert words("Ab-c9 ÉK\ud800x") == [b"ab", b"c9", b"k", b"x"] and words("") == []


@pytest.mark.parametrize("seed", [0, 1])
def test_overlaps_equal_brute_force(spark, seed):
    rows = made(seed=seed) + EDGES
    got = [tuple(r) for r in overlap.cross_split_overlaps(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows) and len(got) > 20


def test_overlaps_over_many_shards(spark):
    rows = made(200, 5)
    got = {tuple(r) for r in overlap.cross_split_overlaps(table(spark, rows), shard_size=100).collect()}
    assert got == brute_pairs(rows)


def test_ranges_read_by_several_tasks(spark):
    rows = made(200, 5)
    got = {tuple(r) for r in overlap.cross_split_overlaps(table(spark, rows), shard_size=100, pieces=15).collect()}
    assert got == brute_pairs(rows)
    copies = overlap.copies_of(8, (np.array([5], np.uint64), np.array([0.9])), 1000, 20.9, 100)
    assert copies[0] == 10 and (copies[1:] == 10).all() and overlap.copies_of(1000, (np.array([5], np.uint64), np.array([0.9])), 1000, 20.9, 100)[:2].tolist() == [10, 1]


def test_coverage(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, "train", " ".join(words)), (2, "test", " ".join(words[::-1])), (3, "val", " ".join(words[:38] + ["new"])), (4, "val", " ".join(f"x{i}" for i in range(20))), (5, "train", " ".join(words[1:]))]
    got = {r.held_id: r for r in overlap.held_coverage(table(spark, rows)).collect()}
    assert set(got) == {2, 3} and got[2].covered == got[2].n_words == 40 and got[2].covered_part == 1.0 and got[2].train_records == 2
    assert got[3].n_words == 39 and 0 < got[3].covered <= 38
    assert overlap.held_coverage(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_equal_brute_force(spark, seed):
    rows = made(seed=seed) + EDGES
    got = [tuple(r) for r in edits.similar_groups(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_groups(rows)


@pytest.mark.parametrize("size,rare,replaced", [(20, 5, 2), (57, 15, 6)])
def test_edits_among_rare_words(spark, size, rare, replaced):
    """Pairs just over the threshold that differ in their rare words only, which are a quarter of all."""
    rng = random.Random(size)
    common = [f"common{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = rng.sample(common, size - rare)
        own = [f"own{i}x{j}" for j in range(rare)]
        rows += [(2 * i, "train", " ".join(w + own)), (2 * i + 1, "train", " ".join(w + own[replaced:] + [f"new{i}x{j}" for j in range(replaced)]))]
    got = {tuple(r) for r in edits.similar_groups(table(spark, rows)).collect()}
    assert got == brute_groups(rows) and len(got) >= 300


@pytest.mark.parametrize("hot", [edits.HOT, 40])
def test_a_shard_beyond_a_tree(spark, hot):
    """All records share their rarest words, so that one shard holds them all."""
    rng = random.Random(8)
    common = [f"common{i}" for i in range(60)]
    rows = [(i, "train", " ".join(w)) for i, w in enumerate(rng.sample(common, rng.randrange(8, 30)) for _ in range(300))]
    rows += [(1000 + i, "val", " ".join(x.split()[1:] + [f"new{i}"] * (i % 2))) for i, (_, _, x) in enumerate(rows) if len(x.split()) > 11]
    got = {tuple(r) for r in edits.similar_groups(table(spark, rows), hot=hot).collect()}
    assert got == brute_groups(rows)


def test_hot_shards(spark):
    """One group of edited copies holds most rows; two texts hang on it by one link each."""
    rng = random.Random(3)
    base = [f"base{i}" for i in range(40)]
    rows = [(0, "train", " ".join(base))]
    rows += [(i, "train", " ".join(base + [f"own{i}"])) for i in range(1, 120)]
    rows += [(200, "train", " ".join(base[:34] + [f"own{i}" for i in (1, 2)])), (201, "val", " ".join(f"far{i}" for i in range(20)))]
    rows += [(300 + i, "val", " ".join(rng.choice(base) + str(j) for j in range(20))) for i in range(20)]
    got = {tuple(r) for r in edits.similar_groups(table(spark, rows), hot=8).collect()}
    assert got == brute_groups(rows)


def test_empty_tables(spark):
    none = table(spark, [(1, "train", None)])
    assert overlap.cross_split_overlaps(none).count() == 0 and edits.similar_groups(none).count() == 0
    empty = none.limit(0)
    assert overlap.cross_split_overlaps(empty).columns == ["sample_id_a", "sample_id_b"] and overlap.cross_split_overlaps(empty).count() == 0
    assert edits.similar_groups(empty).columns == ["group_id", "sample_id"] and edits.similar_groups(empty).count() == 0


def test_versions_of_one_id(spark):
    """Rows of an id that differ in text count as one of them."""
    x, y = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(20))
    rows = [(1, "train", x), (1, "train", y), (2, "val", x), (3, "val", y)]
    got = {tuple(r) for r in overlap.cross_split_overlaps(table(spark, rows)).collect()}
    assert len(got) == 1 and got < {(1, 2), (1, 3)}
    assert len({r.group_id for r in edits.similar_groups(table(spark, rows)).collect()}) == 1


@pytest.mark.parametrize("bits", [3, 24, 128])
def test_bk_forest_equals_scan(bits):
    rng = np.random.default_rng(bits)
    shard = np.sort(rng.integers(0, 12, 400))
    bit = (rng.random((400, 128)) < 0.5) & (np.arange(128) < bits)
    codes = np.packbits(bit, axis=1).view(np.uint64)
    far = (bit[:, None] != bit[None]).sum(2)
    same = shard[:, None] == shard[None]
    radius = rng.integers(0, 40, 400)
    stored = rng.random(400) < 0.6
    for mask, queries, earlier in ((None, np.arange(400), True), (stored, np.flatnonzero(~stored), False)):
        forest = edits.BKForest(shard, codes, mask)
        got = {(x, y, d) for part in forest.within(queries, radius[queries], earlier) for x, y, d in zip(*(c.tolist() for c in part))}
        held = np.ones(400, bool) if mask is None else mask
        assert got == {(x, y, far[x, y]) for x in queries.tolist() for y in range(400) if same[x, y] and held[y] and far[x, y] <= radius[x] and (y < x or not earlier)}


def test_twenty_thousand_records_of_few_words(spark):
    """Sets of 12 of 45 words: every word's shard holds thousands of records, and few of them are similar."""
    rng = np.random.default_rng(2)
    sets = np.zeros((20_000, 45), np.float32)
    np.put_along_axis(sets, rng.random((20_000, 45)).argsort(axis=1)[:, :12], 1, axis=1)
    sets[10_000:10_400] = sets[:400]
    sets[np.arange(10_000, 10_200), sets[10_000:10_200].argmax(1)] = 0
    rows = [(i, "train", " ".join(f"w{j}" for j in np.flatnonzero(s))) for i, s in enumerate(sets)]
    size, links = sets.sum(1), []
    for low in range(0, len(sets), 2000):
        both = sets[low : low + 2000] @ sets.T
        x, y = np.nonzero(both >= 0.8 * (size[low : low + 2000, None] + size - both) - 1e-6)
        links += [(int(a + low), int(b)) for a, b in zip(x, y) if a + low < b]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    linked = {i for pair in links for i in pair}
    got = {tuple(r) for r in edits.similar_groups(table(spark, rows)).collect()}
    assert got == {(root(i), i) for i in linked} and len(got) >= 800


def test_crowd_of_edited_copies(spark):
    """Thousands of records that differ in a word or two are one group, and others beside them keep their own."""
    rng = random.Random(4)
    base = [f"base{i}" for i in range(30)]
    rows = [(i, "train", " ".join(base[: 28 + i % 3] + [f"own{i % 700}", f"more{i}"][: i % 3])) for i in range(3000)]
    rows += [(5000 + 2 * i + j, "val", " ".join(base[:20] + [f"o{i}x{k}" for k in range(12 + j)])) for i in range(40) for j in range(2)]
    rng.shuffle(rows)
    got = {tuple(r) for r in edits.similar_groups(table(spark, rows), hot=64).collect()}
    assert {g for g, i in got if i < 5000} == {0} and sum(i < 5000 for _, i in got) == 3000
    assert {(g, i) for g, i in got if i >= 5000} == {(5000 + 2 * i, 5000 + 2 * i + j) for i in range(40) for j in range(2)}


def test_passages_survive_every_similar_record():
    """Of the passages of a form at least one stands whole in any form that differs in as many words as the similarity allows."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(8, 80))
        codes = np.sort(rng.choice(10_000, n, replace=False))
        row, first, end = overlap.passages(rng.integers(0, 2, n) * 30, np.array([n]), np.array([n]))
        lost = int(rng.integers(0, n // 5 + 1))
        more = int((n - lost) / 0.8 - n + 1e-9)
        other = np.sort(np.concatenate([rng.choice(codes, n - lost, replace=False), rng.choice(np.arange(10_000, 20_000), more, replace=False) - 10_000]))
        other = np.unique(other)
        text = "," + ",".join(map(str, other)) + ","
        assert len(first) == n // 4 + 1 and (np.diff(np.sort(first)) > 0).all()
        assert any("," + ",".join(map(str, codes[s:e])) + "," in text for s, e in zip(first, end))


def test_connected_groups(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)]
    got = {(r.id, r.group) for r in connected_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
