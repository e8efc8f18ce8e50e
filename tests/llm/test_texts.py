"""Leaks, mixtures and shared spans against brute force, and their edge cases."""

import random
from itertools import combinations

import numpy as np
import pytest

from orrery.llm import leaks, mixing, spans
from orrery.llm.words import words

EXTRA = "hash string, id string, place int, a int, n_tokens string, item string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", "i", 1, 2, "n", "m") for i, t, s in rows], f"doc_id long, text string, source string, {EXTRA}")


def text(rng, n, vocabulary="w"):
    return " ".join(f"{vocabulary}{rng.randrange(5000)}" for _ in range(n))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(0)
    items = [(i, text(rng, rng.randrange(5, 40), "q")) for i in range(30)] + [(31, None), (None, "x"), (32, "")]
    docs = []
    for i in range(80):
        w = text(rng, 60).split()
        if i % 3 == 0:
            own = items[rng.randrange(30)][1].split()
            s = rng.randrange(len(own))
            w[20:20] = [x.upper() + "," for x in own[s : s + rng.randrange(1, 30)]]
        docs.append((i, " ".join(w), "s"))
    docs += [(200, None, None), (201, "", None), (None, items[3][1], None), (docs[0]), (202, " ".join(["a"] * 20), "s")]
    items.append((40, " ".join(["a"] * 13)))

    def grams(t, n=13):
        w = words(t or "")
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(d, i) for d, t, _ in docs for i, p in items if d is not None and i is not None and grams(t) & grams(p)}
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for block in (leaks.BLOCK, 7):
        got = leaks.leaked_spans(documents(spark, docs), frame, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len({tuple(r) for r in got}) == len(got)
    assert {(r.first_word, r.end_word) for r in got if r.doc_id == 202} == {(0, 20)}
    assert leaks.leaked_spans(documents(spark, docs), frame.limit(0)).count() == 0
    assert leaks.leaked_spans(documents(spark, docs).limit(0), frame).count() == 0


def test_removed_leaks(spark):
    rng = random.Random(1)
    item = text(rng, 20, "q")
    clean = text(rng, 100)
    docs = [(1, f"{clean[:300]} {item}! {clean[300:]}", "s"), (2, item, "s"), (3, clean, "s")]
    frame = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks.remove_leaks(documents(spark, docs), frame).collect()}
    assert set(got) == {1, 2} and got[2].action == "drop" and got[2].clean_text is None
    assert got[1].action == "cut" and got[1].leaked_words == 20 and got[1].clean_text.split() == f"{clean[:300]} ! {clean[300:]}".split()


def test_token_sizes_and_mixture(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randrange(1, 60)), rng.choice(["big"] * 9 + ["small"])) for i in range(600)]
    rows += [(700, None, "big"), (701, "", "big"), (702, "x", None), (None, "lost", "big"), rows[0], (703, "y" * 100_000, "big")]
    docs = documents(spark, rows)
    sizes = mixing.token_sizes(docs)
    got = {r.doc_id: r.n_tokens for r in sizes.collect()}
    path = f"{mixing.TOKENIZERS}/byte_bpe_50k.tiktoken"
    count = mixing.token_counter(path)
    whole, cut = mixing.token_counter(path, 10**9), mixing.token_counter(path, 7)
    pick = random.Random(1)
    for _ in range(100):
        t = "".join(pick.choice(["a", "Bc", " ", "\n", " " * 9, "\t" * 8, "\u3000" * 9, ".", "1", "\xa0" * 7, "\x1f" * 9]) for _ in range(60))
        assert whole(t) == cut(t)
    assert count(" " * 2_000_000 + "x" + "\n" * 100_000) > 100_000
    assert got[700] == 0 and got[701] == 0 and 702 not in got and got[703] > 1000
    assert all(got[i] == count(t) for i, t, _ in rows[:50])
    targets = spark.createDataFrame([(1, "big", 0.3, 1, 0.5), (1, "small", 0.7, 2, 0.5), (2, "big", 0.9, 2, 1.2), (2, "none", 0.1, 3, 1.2), (None, "big", 1.0, 1, 1.0), (3, "small", None, 1, 1.0)], "mix_id long, source string, weight double, max_repeats int, budget_share double")
    mix, report = mixing.mixture(sizes, targets)
    rep = {(r.mix_id, r.source): r for r in report.collect()}
    all_tokens = sum(n for i, n in got.items() if i is not None)
    per = {s: sum(n for i, n in got.items() if i is not None and next(x for x in rows if x[0] == i)[2] == s) for s in ("big", "small")}
    assert {k for k, r in rep.items() if r.capped} == {k for k, (w, m, b) in {(1, "big"): (0.3, 1, 0.5), (1, "small"): (0.7, 2, 0.5), (2, "big"): (0.9, 2, 1.2), (2, "none"): (0.1, 3, 1.2), (3, "small"): (0, 1, 1.0)}.items() if m * per.get(k[1], 0) < w * b * all_tokens}
    rows_ = mix.collect()
    most = {k: r.max_repeats for k, r in rep.items()}
    assert all(1 <= r.copies <= most[r.mix_id, r.source] for r in rows_) and len({(r.mix_id, r.doc_id) for r in rows_}) == len(rows_)
    for k, r in rep.items():
        assert r.actual_tokens == sum(x.n_tokens * x.copies for x in rows_ if (x.mix_id, x.source) == k)
        copies = [x.copies for x in rows_ if (x.mix_id, x.source) == k]
        if r.source_tokens and not r.capped and r.target_tokens:
            expected = min(r.max_repeats, r.target_tokens / r.source_tokens) * sum(1 for i, _, s in {x[0]: x for x in rows if x[0] is not None}.values() if s == r.source)
            assert abs(sum(copies) - expected) <= 1
        if r.capped and r.source_tokens:
            assert r.actual_tokens == r.max_repeats * r.source_tokens
    assert sum(r.actual_share or 0 for k, r in rep.items() if k[0] == 1) == pytest.approx(1)
    none, empty = mixing.mixture(sizes.limit(0), targets)
    assert none.count() == 0 and empty.where("actual_tokens > 0").count() == 0 and mixing.mixture(sizes, targets.limit(0))[1].count() == 0


def brute_spans(rows, size=300):
    held = {}
    for i, t, _ in rows:
        if i is not None and t is not None:
            for k in range(len(t) - size + 1):
                held.setdefault(t[k : k + size], set()).add(i)
    return {p for ids in held.values() if len(ids) > 1 for p in combinations(sorted(ids), 2)}


def spanned(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh \n\ré\U0001f600") for _ in range(n))
    rows = []
    for i in range(60):
        t = make(rng.randrange(0, 1200))
        if rows and i % 2:
            own = rng.choice(rows)[1]
            s = rng.randrange(max(len(own) - 200, 1))
            t = t[:200] + own[s : s + rng.choice([250, 299, 300, 301, 450])] + t[200:]
        rows.append((i, t, "s"))
    rows += [(100, rows[5][1] * 3, "s"), (101, rows[5][1] * 3, "s"), (102, None, "s"), (103, "", None), (None, rows[5][1] * 3, "s"), (104, "a" * 5000, "s"), (105, "b" + "a" * 320, "s"), (101, rows[5][1] * 3, "s")]
    return rows


@pytest.mark.parametrize("seed,batches", [(0, 4), (1, 1)])
def test_shared_spans_equal_brute_force(spark, seed, batches):
    rows = spanned(seed)
    got = [tuple(r) for r in spans.shared_spans(documents(spark, rows), batches=batches).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows)


def test_shared_amounts(spark):
    rows = [r for r in spanned(2) if r[0] is not None and r[0] < 100]
    got = {r.doc_id: r for r in spans.shared_amounts(documents(spark, rows)).collect()}
    held = {}
    for i, t, _ in rows:
        for k in range(len(t) - 299):
            held.setdefault(t[k : k + 300], set()).add(i)
    for i, t, _ in rows:
        covered = np.zeros(len(t), bool)
        for k in range(len(t) - 299):
            if len(held[t[k : k + 300]]) > 1:
                covered[k : k + 300] = True
        assert (got[i].shared_chars if i in got else 0) == covered.sum()


def test_spans_of_nothing(spark):
    none = documents(spark, [(1, None, None), (2, "short", None)])
    assert spans.shared_spans(none).count() == 0 and spans.shared_amounts(none).count() == 0
    assert spans.shared_spans(none.limit(0)).columns == ["doc_id_a", "doc_id_b"] and spans.shared_spans(none.limit(0)).count() == 0


def test_index_compacts_its_runs(spark):
    index = spans.FingerprintIndex(spark, 2)
    for i in range(5):
        index.add(spark.createDataFrame([(h, i, 0, 1, 1) for h in range(3)], "hash long, id long, place int, left long, right long"))
    assert [level for level, _ in index.runs] == [2, 0]
    found = index.add(spark.createDataFrame([(1, 9, 0, 1, 1)], "hash long, id long, place int, left long, right long"))
    assert sorted(r.a for f in found for r in f.collect()) == [0, 1, 2, 3, 4]
    index.close()


def test_rolling_hash_and_selection():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 100, 3000).astype(np.uint32)
    h = spans.rolling(x, 23)
    assert len(h) == 3000 - 22 and all((h[i] == h[j]) == (x[i : i + 23] == x[j : j + 23]).all() for i, j in rng.integers(0, 2900, (300, 2)))
    assert len(spans.rolling(x[:5], 23)) == 0
    for _ in range(50):
        a, b, s = rng.integers(97, 123, 700).astype(np.uint32), rng.integers(97, 123, 700).astype(np.uint32), rng.integers(0, 400)
        b[100:400] = a[s : s + 300]
        assert set(spans.selected(a)[1].tolist()) & set(spans.selected(b)[1].tolist())


def test_fingerprint_index_of_two_sessions(spark, tmp_path):
    """A second index opened on the folder of the first finds what its batch shares with the earlier ones."""
    pick = random.Random(2)
    long = lambda: "".join(pick.choice("abcdefgh \n") for _ in range(700))
    texts = [long() for _ in range(6)]
    later = [(10, texts[0][100:500] + long()), (11, long() + texts[3][:450]), (12, long())]
    hashes = lambda rows: spans.window_hashes(spark.createDataFrame(rows, "id long, text string"), 300, 200, 50)
    root = f"file://{tmp_path}/index"
    one = spans.FingerprintIndex(spark, 4, root)
    for part in (texts[:2], texts[2:4], texts[4:]):
        base = texts.index(part[0])
        assert sum(f.count() for f in one.add(hashes([(base + i, t) for i, t in enumerate(part)]))) == 0
    assert [level for level, _ in one.runs] == [1, 0]
    one.close()
    two = spans.FingerprintIndex(spark, root=root)
    assert two.buckets == 4 and [level for level, _ in two.runs] == [1, 0]
    found = {(r.a, r.b) for f in two.add(hashes(later)) for r in f.collect()}
    assert found == {(0, 10), (3, 11)} and [level for level, _ in two.runs] == [2]
    two.close()
    assert [level for level, _ in spans.FingerprintIndex(spark, root=root).runs] == [2]


def test_cut_keeps_case_where_lower_case_is_longer(spark):
    words_ = [f"Word{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "\u0130STANBUL Keep " + " ".join(words_[:14]) + " Stay " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words_[:14]))], "item_id long, text string")
    (r,) = leaks.remove_leaks(docs, items).collect()
    assert r.action == "cut" and r.clean_text == "\u0130STANBUL Keep  " + " Stay " * 20
