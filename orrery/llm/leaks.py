"""Evaluation passages inside training text: a broadcast hash set of n-grams scanned over token windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.words import words
from orrery.runtime import materialize

#: Words that must stand together, and items per broadcast: a set of items is scanned in blocks of this size, so that what is
#: broadcast stays bounded whatever their number.
WORDS, BLOCK = 13, 20_000


def _index(items: list[tuple[int, str]], n: int) -> tuple[dict[bytes, set[int]], set[bytes]]:
    grams, vocabulary = defaultdict(set), set()
    for item, text in items:
        w = words(text)
        for i in range(len(w) - n + 1):
            grams[b" ".join(w[i : i + n])].add(item)
            vocabulary.update(w[i : i + n])
    return dict(grams), vocabulary


def _hits(text: str, grams: dict, vocabulary: set, n: int) -> list[tuple[int, int, int]]:
    """(item, first word, end word) of every window of `n` words that is in `grams`, overlapping windows of an item merged."""
    w = words(text)
    spans: dict[int, list[list[int]]] = {}
    run = 0
    for i, word in enumerate(w):
        if word not in vocabulary:
            run = 0
            continue
        run += 1
        if run >= n:
            for item in grams.get(b" ".join(w[i + 1 - n : i + 1]), ()):
                own = spans.setdefault(item, [])
                if own and own[-1][1] >= i + 1 - n:
                    own[-1][1] = i + 1
                else:
                    own.append([i + 1 - n, i + 1])
    return [(item, a, b) for item, own in spans.items() for a, b in own]


def leaked_spans(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n_words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): runs of at least `n_words` consecutive words of an item in a document.

    The items' n-grams are exact word strings in a hash set, so that a hit needs no further check. Texts are scanned whole
    in Arrow batches and never shuffled; words outside the items' vocabulary are skipped at the cost of one look-up. Items
    are taken in blocks of `block`, each broadcast by itself. Null ids or texts and texts with fewer words give no rows;
    repeated rows of a document give its rows once; several rows of one item count as passages of that item.
    """
    spark = documents.sparkSession
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    kinds = "doc_id long, item_id long, first_word int, end_word int"
    at, parts = None, []
    while True:
        rest = own if at is None else own.where((F.col("item_id") > at[0]) | ((F.col("item_id") == at[0]) & (F.col("text") > at[1])))
        part = [(r.item_id, r.text) for r in rest.orderBy("item_id", "text").limit(block).collect()]
        if not part:
            break
        at = part[-1]
        shared = spark.sparkContext.broadcast(_index(part, n_words))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grams, vocabulary = shared.value
            for b in batches:
                out = [(doc, *hit) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in _hits(text, grams, vocabulary, n_words)]
                cols = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "first_word", "end_word"])

        parts.append(docs.mapInArrow(scan, kinds))
        if len(part) < block:
            break
    if not parts:
        return spark.createDataFrame([], kinds)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.distinct()


def remove_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.5, **options) -> DataFrame:
    """(doc_id, n_words, leaked_words, action, clean_text) of every document with a leak.

    Documents whose leaked words reach `max_share` of all words get the action "drop" and a null text; from the others the
    leaked spans are cut ("cut"), each span from its first word's first character to its last word's last, leaving a blank.
    Of repeated rows of a document the first by text counts. Rows: see leaked_spans.
    """
    import re

    spans = materialize(leaked_spans(documents, items, id_col, text_col, **options), "spans")
    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))  # of one document
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    hit = docs.join(per, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "spans")).alias("r")).select("doc_id", "r.text", "r.spans")
    word = re.compile("[a-z0-9]+")

    def cut(frames):
        for f in frames:
            rows = []
            for doc, text, own in zip(f["doc_id"], f["text"], f["spans"]):
                low = text.lower()
                at = [m.span() for m in word.finditer(low)]
                if len(low) != len(text):  # a few characters become two in lower case
                    place = [i for i, c in enumerate(text) for _ in c.lower()]
                    at = [(place[a], place[b - 1] + 1) for a, b in at]
                gone = sorted({i for s in own for i in range(s["first_word"], s["end_word"])})
                share = len(gone) / max(len(at), 1)
                clean = None
                if share < max_share:
                    clean, last, i = [], 0, 0
                    while i < len(gone):
                        j = i
                        while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
                            j += 1
                        clean += [text[last : at[gone[i]][0]], " "]
                        last, i = at[gone[j]][1], j + 1
                    clean = "".join([*clean, text[last:]])
                rows.append((doc, len(at), len(gone), "drop" if clean is None else "cut", clean))
            yield __import__("pandas").DataFrame(rows, columns=["doc_id", "n_words", "leaked_words", "action", "clean_text"])

    return hit.mapInPandas(cut, "doc_id long, n_words int, leaked_words int, action string, clean_text string")
