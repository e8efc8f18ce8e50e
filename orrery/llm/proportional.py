"""Samples that match target proportions of categories (divisor-method priorities)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.ranking import hash_order, spread_rank
from orrery.runtime import materialize


def labelled_pool(samples: DataFrame, split: str = "train", categories: tuple[int, int] = (0, 13)) -> DataFrame:
    """(sample_id, y): one row for each record of `split` (trimmed, lower case) whose label lies in `categories`.

    Rows of one id count once: the earliest by `ingested_at` (null last), then the smallest label, decides. Rows with a null
    id, split or label, or a label outside the range, are not in the pool. Other columns are ignored. Empty in, empty out.
    """
    rows = samples.select("sample_id", "y", F.lower(F.trim("split")).alias("split"), "ingested_at").where(F.col("sample_id").isNotNull())
    first = F.min(F.struct(F.col("ingested_at").isNull().alias("late"), "ingested_at", "y", "split"))
    one = rows.groupBy("sample_id").agg(first.alias("r"))
    return one.select("sample_id", F.col("r.y").alias("y"), F.col("r.split").alias("split")).where((F.col("split") == split) & F.col("y").between(*categories)).drop("split")


def _seats(request: pd.DataFrame, size: int) -> np.ndarray:
    """Rows each category of one request gets: the floors first, then the `size` smallest (rank - 0.5) / share.

    A category's priorities are known from its rank alone, so instead of sorting them the cut between the taken and the
    rest is found by bisection; seats of exhausted categories fall to the others. Equal priorities at the cut go to the
    smaller category. If the floors alone exceed `size`, they are all kept.
    """
    have = request["available"].to_numpy(np.int64)
    share = request["target_share"].fillna(0).to_numpy(float)
    share = np.where(np.isfinite(share) & (share > 0), share, 0.0)
    floor = np.minimum(have, np.maximum(request["min_rows"].fillna(0).to_numpy(np.int64), 0))
    room = np.where(share > 0, have, floor)

    def taken(cut: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            by_cut = np.floor(np.minimum(cut * share + 0.5, 9e15)).astype(np.int64)
        return np.clip(np.maximum(by_cut, floor), 0, room)

    if room.sum() <= size:
        return room
    if floor.sum() >= size:
        return floor
    low, high = 0.0, 1.0
    while taken(high).sum() < size:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if taken(mid).sum() <= size else (low, mid)
    seats, more = taken(low), taken(high)
    for i in np.argsort(request["y"].to_numpy(), kind="stable"):
        step = min(int(more[i] - seats[i]), int(size - seats.sum()))
        seats[i] += max(step, 0)
    return seats


def allocate(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """Seats of every requested category: (target_id, y, target_share, wanted, min_rows, available, seats, pool_rows, short).

    `counts` has (y, available), `requests` (target_id, y, target_share, pool_frac, min_rows). The sample of a request has
    floor(pool_frac * pool_rows) rows. `short` is true where the pool holds fewer rows of the category than the greater of
    `min_rows` and `wanted` = target_share * pool_frac * pool_rows. A null share, fraction or minimum counts as 0; requests
    with a null id or category are left out and repeated requests count once, the greatest kept. The work per request is
    bounded by its number of categories, not by rows.
    """
    asked = requests.where(F.col("target_id").isNotNull() & F.col("y").isNotNull()).groupBy("target_id", "y").agg(*[F.max(c).alias(c) for c in ("target_share", "pool_frac", "min_rows")])
    total = counts.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    full = (
        asked.join(counts, "y", "left")
        .select("target_id", "y", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("pool_frac", F.lit(0.0)).alias("pool_frac"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"), F.coalesce("available", F.lit(0)).cast("long").alias("available"), F.lit(total).cast("long").alias("pool_rows"))
        .withColumn("wanted", F.col("target_share") * F.col("pool_frac") * F.col("pool_rows"))
    )

    def solve(request: pd.DataFrame) -> pd.DataFrame:
        request = request.sort_values("y", ignore_index=True)
        size = math.floor(float(request["pool_frac"].max()) * int(request["pool_rows"].iloc[0]) + 1e-9)
        return request.assign(seats=_seats(request, size), short=request["available"] < np.maximum(request["min_rows"], request["wanted"]))

    kinds = "target_id long, y int, target_share double, pool_frac double, min_rows long, available long, pool_rows long, wanted double, seats long, short boolean"
    return full.groupBy("target_id").applyInPandas(solve, kinds)


def proportional_sample(samples: DataFrame, requests: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every request; see drawn."""
    return drawn(samples, requests, seed)[:2]


def unmet(samples: DataFrame, requests: DataFrame, seed: int = 17) -> DataFrame:
    """(target_id, y, asked, met): requested categories whose ranks run out before what is asked of them, the greater of
    `min_rows` and `wanted`. Every rank of a category has its priority in the draw; `met` counts those up to what is asked."""
    _, report, ranked = drawn(samples, requests, seed)
    asked = report.select("target_id", "y", F.greatest(F.col("min_rows").cast("double"), "wanted").alias("asked"))
    # no more ranks than are asked for take part, whatever the size of the category
    within = ranked.select("y", "rank_no").join(F.broadcast(asked), "y").where(F.col("rank_no") < F.col("asked") + 1)  # as many rows as categories are asked for
    met = within.groupBy("target_id", "y").agg(F.count(F.lit(1)).alias("met"))
    return asked.join(met, ["target_id", "y"], "left").withColumn("met", F.coalesce("met", F.lit(0))).where("met < asked")


def drawn(samples: DataFrame, requests: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, report, ranked) for every request, `ranked` being the records of the pool with their random rank in the category.

    Sample: (target_id, sample_id, y, rank_no, priority), the `seats` records of each category that come first in a random
    order fixed by `seed`. The rank inside a category is exact and spread over slices (see spread_rank), so that the
    largest category is never ranked in one task; only ids and labels are shuffled. The report is that of `allocate`.
    Empty pools and requests give empty results. Null and repeated rows: see labelled_pool and allocate.
    """
    pool = materialize(labelled_pool(samples).withColumn("at", hash_order(seed, "sample_id")), "pool")
    report = materialize(allocate(pool.groupBy("y").agg(F.count(F.lit(1)).alias("available")), requests), "seats")
    most = report.groupBy("y").agg(F.max("seats").alias("most"))
    every = spread_rank(pool, ["y"], "at", "rank_no", ["sample_id"])
    ranked = every.join(F.broadcast(most), "y").where("rank_no <= most")
    seats = report.select("target_id", "y", "target_share", "seats")
    sample = (
        ranked.join(F.broadcast(seats), "y")  # as many rows as categories are asked for
        .where("rank_no <= seats")
        .select("target_id", "sample_id", "y", "rank_no", F.try_divide(F.col("rank_no") - 0.5, F.col("target_share")).alias("priority"))
    )
    return sample, report, every
