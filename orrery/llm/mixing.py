"""Mixtures of sources by target weight, with documents sized in tokens (systematic sampling)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.ranking import hash_order, spread_rank
from orrery.runtime import materialize

#: Vocabulary folder of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
#: The usual splitting pattern of byte-level BPE (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the splitting pattern knows it (fixed values).
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def token_counter(path: str, run: int = 5_000) -> Callable[[str], int]:
    """Counts tokens with a byte-level BPE vocabulary file, of texts of any length by one rule.

    Runs of `run` or more blanks overflow the stack of the matcher, so they are cut out as the pattern would: the whole run
    at the end of the text, else all but its last blank, is one piece, and the rest goes on from there. The counts are the same."""
    encoding = _encoding(path)
    encode, blanks = encoding.encode_ordinary, re.compile(f"{_BLANK}{{{run},}}")

    def count(text: str) -> int:
        n, at = 0, 0
        for m in blanks.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            n += len(encode(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
            at = end
        return n + len(encode(text[at:]))

    return count


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) of the rows of `documents` with a source. Null and empty texts have 0 tokens; the text
    is counted whole. No shuffle: texts go through Arrow batches and only the sizes come back."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for b in batches:
            n = [count(t) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.where("source is not null").mapInArrow(sizes, "doc_id long, source string, n_tokens long")


def mixture(sizes: DataFrame, targets: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(mix, report): documents and copies for every mixture of `targets` (mix_id, source, weight, max_repeats, budget_share).

    Each document of a source is expected `expected` = min(max_repeats, weight * budget / tokens of the source) times; the
    expected copies are prefix-summed along a random order of the source, one random offset per source and mixture is added
    and a document comes out once for each integer crossed, so that its copies are `expected` rounded down or up and the
    source as a whole is within one copy of its target. The positions are exact ranks spread over slices, so that a source
    with a third of all documents is no single task.

    mix: (mix_id, doc_id, source, n_tokens, copies), copies > 0. report: (mix_id, source, weight, max_repeats,
    target_tokens, source_tokens, actual_tokens, actual_share, capped); `capped` where every document of the source came out
    max_repeats times and their tokens stay under the target. Documents repeat by id: the first by size is kept. Null ids are left out; a null weight or
    repeat count is 0; sources of `targets` without documents are reported with 0 tokens. Empty in, empty out.
    """
    docs = sizes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("n_tokens", "source")).alias("r")).select("doc_id", "r.source", "r.n_tokens").withColumn("at", hash_order(seed, "doc_id"))
    docs = materialize(docs, "sizes")
    per = materialize(docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    total = per.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).first()[0]
    asked = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("weight", "max_repeats", "budget_share")])
    plan = (
        asked.join(per, "source", "left")
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("target_tokens", F.col("weight") * F.col("budget_share") * F.lit(total))
        .withColumn("expected", F.least(F.col("max_repeats").cast("double"), F.coalesce(F.try_divide("target_tokens", "source_tokens"), F.when(F.col("target_tokens") > 0, F.col("max_repeats").cast("double")), F.lit(0.0))))
        .withColumn("offset", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "mix_id", "source")), 1, 12), 16, 10).cast("double") / float(16**12))
    )
    plan = materialize(plan, "plan")
    ranked = spread_rank(docs, ["source"], "at", "position", ["doc_id"])
    mix = (
        ranked.join(F.broadcast(plan.select("mix_id", "source", "expected", "offset")), "source")  # as many rows as `targets`
        .withColumn("copies", (F.floor(F.col("expected") * F.col("position") + F.col("offset")) - F.floor(F.col("expected") * (F.col("position") - 1) + F.col("offset"))).cast("long"))
        .where("copies > 0")
        .select("mix_id", "doc_id", "source", "n_tokens", "copies")
    )
    mix = materialize(mix, "mixture")
    got = mix.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("emitted"), F.min("copies").alias("least"))
    spent = (F.col("max_repeats") <= 0) | (F.coalesce("n_docs", F.lit(0)) == 0) | ((F.col("emitted") == F.col("n_docs")) & (F.col("least") == F.col("max_repeats")))
    report = (
        plan.join(got, ["mix_id", "source"], "left")
        .withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        .withColumn("capped", F.coalesce(spent, F.lit(False)) & (F.col("actual_tokens") < F.col("target_tokens")))
        .withColumn("actual_share", F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(Window.partitionBy("mix_id")).cast("double")))
        .select("mix_id", "source", "weight", "max_repeats", "target_tokens", "source_tokens", "actual_tokens", "actual_share", "capped")
    )
    return mix, report
