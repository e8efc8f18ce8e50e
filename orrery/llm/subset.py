"""A varied subset by a multi-attribute grid taken round-robin (SQL only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.ranking import spread_rank
from orrery.llm.vectors import valid_vectors
from orrery.runtime import checked_broadcast, materialize

#: Attributes: the quarters of a vector that each one looks at, first and last; grids; occupied cells of the grid for each record
#: asked for.
WINDOWS, GRIDS, ROOM = ((0, 2), (2, 4), (1, 3)), 6, 1.5


def grid_bins(rows: DataFrame) -> DataFrame:
    """`rows` (space_id, .., vector) without the vector and with `bins`: the bin of every grid and attribute, grids from coarse to fine.

    An attribute is the coordinate of the greatest magnitude among half of all coordinates, with its sign (the positive and
    first one of equals): a cross-polytope hash, which similar vectors mostly share whatever their norm. The halves overlap, so
    that every coordinate counts and the attributes split groups at different places. Coarser grids join the bins of
    neighbouring coordinates, two, four, .. into one. A bin is a number of its own in the space. Where some coordinates are
    the greatest in every vector, centre and scale the vectors first. All of this stays in generated code.
    """
    n = len(WINDOWS)
    keep = [c for c in rows.columns if c != "vector"]
    out = rows
    for j, (low, high) in enumerate(WINDOWS):
        first = f"cast(floor(size(vector) * {low} / 4) as int)"
        out = out.withColumn(f"__w{j}", F.expr(f"slice(vector, {first} + 1, greatest(cast(floor(size(vector) * {high} / 4) as int) - {first}, 1))"))
        out = out.withColumn(f"__h{j}", F.expr(f"array_max(__w{j})")).withColumn(f"__l{j}", F.expr(f"array_min(__w{j})"))
        place = f"coalesce({first} + cast(array_position(__w{j}, if(__h{j} >= -__l{j}, __h{j}, __l{j})) as int) - 1, 0)"
        out = out.withColumn(f"__b{j}", F.expr(f"2 * {place} + if(__h{j} >= -__l{j}, 1, 0)"))
    out = out.select(*keep, F.expr("2 * size(vector)").alias("__stride"), *[f"__b{j}" for j in range(n)])
    bins = [f"{g * n + j} * __stride + 2 * shiftright(__b{j}, {GRIDS - g}) + __b{j} % 2" for g in range(GRIDS) for j in range(n)]
    return out.select(*keep, F.array(*[F.expr(b) for b in bins]).alias("bins"))


def grid_cells(binned: DataFrame) -> DataFrame:
    """`binned` (space_id, .., bins) with `cells` in place of `bins`: the cell of every grid, from coarse to fine.

    A record belongs to the most crowded of its bins in the grid (the first one of equals), so that the members of a group
    come together in few cells although each attribute splits the group at another place. The counts of a space are one
    array whose length depends on its dim alone.
    """
    n = len(WINDOWS)
    counted = materialize(binned.select("space_id", F.explode("bins").alias("bin")).groupBy("space_id", "bin").agg(F.count(F.lit(1)).alias("n")), "bincounts")
    places = counted.groupBy("space_id").agg(F.max("bin").alias("top")).select("space_id", F.explode(F.sequence(F.lit(0), "top")).alias("bin"))
    dense = places.join(counted, ["space_id", "bin"], "left").groupBy("space_id").agg(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    counts = materialize(dense.select("space_id", F.col("c.n").alias("__counts")), "bincounts")
    best = f"transform(sequence(0, {GRIDS - 1}), g -> -array_max(transform(slice(bins, g * {n} + 1, {n}), b -> struct(__counts[b] as n, -b as b))).b)"
    return binned.join(checked_broadcast(counts), "space_id").select(*[c for c in binned.columns if c != "bins"], F.expr(best).alias("cells"))


def varied_subset(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """(space_id, vec_id, sample_id, cell, rank_no): `n_subset` records of each space, spread over its variety.

    Records are binned into the cells of several grids, from coarse to fine (see grid_bins and grid_cells), and each space
    uses the finest one of which at most ROOM * n_subset cells are occupied, or none (one cell) where all have more. Then
    records are ranked in their cell (in the order of md5(vec_id)) and the n_subset records that come first by rank, then by
    md5(cell), are kept. A cell gives a second record only when every cell gave one.

    Ranks are exact and spread over slices of a cell, and the last rank needed is computed from the sizes of the cells, so
    that neither a crowded cell nor a large space is sorted in one task. Only ids and cells are shuffled, no vectors; these are written to the shared folder once.
    Spaces whose n_subset is null or not positive give no rows, those with fewer valid vectors all of them. For nulls,
    invalid vectors and repeated rows see valid_vectors. Empty in, empty out.
    """
    asked = spaces.groupBy("space_id").agg(F.max("n_subset").alias("k")).where("k > 0")
    # written first: checks and bins in one stage are too much code for the JVM to compile
    rows = materialize(valid_vectors(vectors, spaces).join(checked_broadcast(asked), "space_id").select("space_id", "vec_id", "sample_id", "k", "vector"), "vectors")
    placed = materialize(grid_cells(materialize(grid_bins(rows), "bins")), "cells")
    grids = placed.select("space_id", "k", F.posexplode("cells").alias("grid", "cell")).groupBy("space_id", "k", "grid").agg(F.countDistinct("cell").alias("occupied"))
    chosen = materialize(grids.where(F.col("occupied") <= ROOM * F.col("k")).groupBy("space_id").agg(F.max("grid").alias("grid")), "grid")
    placed = placed.join(checked_broadcast(chosen), "space_id", "left").withColumn("cell", F.coalesce(F.get("cells", F.col("grid")), F.lit(-1)).cast("string")).drop("cells", "grid")

    # the last rank needed: sum over cells of min(n, last) reaches k
    sizes = placed.groupBy("space_id", "k", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("space_id", "k", "n").agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy("space_id").orderBy("n")
    down = Window.partitionBy("space_id").orderBy(F.desc("n"))
    steps = (
        sizes.withColumn("used", F.coalesce(F.sum(F.col("n") * F.col("m")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("used") + F.col("n") * F.col("open") >= F.col("k"))
        .groupBy("space_id", "k")
        .agg(F.min(F.struct("n", "used", "open")).alias("s"))
        .select("space_id", F.ceil((F.col("k") - F.col("s.used")) / F.col("s.open")).cast("long").alias("last"))
    )
    last = materialize(steps, "last")
    ranked = spread_rank(placed.withColumn("at", F.md5(F.col("vec_id").cast("string"))), ["space_id", "cell"], "at", "rank_no", ["vec_id"], digits=1)
    ranked = ranked.join(F.broadcast(last), "space_id", "left").where("last is null or rank_no <= last")
    ranked = materialize(ranked.select("space_id", "vec_id", "sample_id", "cell", "k", "rank_no", "last"), "ranked")
    sure = ranked.where("last is null or rank_no < last")
    before = F.broadcast(sure.groupBy("space_id").agg(F.count(F.lit(1)).alias("sure")))  # one row per space
    edge = spread_rank(ranked.where("rank_no = last").withColumn("at", F.md5("cell")), ["space_id"], "at", "turn", ["cell"])
    edge = edge.join(before, "space_id", "left").where(F.col("turn") <= F.col("k") - F.coalesce("sure", F.lit(0)))
    keep = ["space_id", "vec_id", "sample_id", "cell", "rank_no"]
    return sure.select(*keep).unionByName(edge.select(*keep))
