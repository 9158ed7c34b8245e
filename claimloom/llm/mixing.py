"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A document's key is an exponential variable divided by its quality weight; the documents of a
source with the smallest keys come first.  Whole epochs of a source are taken first, then the
documents in key order until the rest of the source's token budget is reached.

The prefix sum over a source isn't a window over the source: keys fall into cells of bounded row
count, cells are summed, and only the cell in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Rows that a cell of the key range has on average.
CELL_ROWS = 2_000
#: The smallest weight of a document; the largest is 1.
LEAST_WEIGHT = 0.25


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """A weight from 0.25 to 1: texts whose words are of usual length weigh most."""
    mean = (F.length(F.coalesce(F.col(text), F.lit(""))) + 1) / F.greatest(F.col(size), F.lit(1)) - 1
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.abs(mean - 6.0) / 12.0)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Targets share ``share`` of all sizes by weight; none is above ``cap`` times its source's size,
    and what is over goes to the others by weight.  With the sources in the order of size over
    weight, the first k are at their cap for the smallest k at which the rest need not be.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double")
    everything = Window.partitionBy()
    ranked = Window.orderBy("_ratio", F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("_w", w).withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = s.withColumn("_total", F.lit(share) * F.sum("source_size").over(everything))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    s = s.withColumn("_fits", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)["_level"])
    target = F.when(F.col("_fits").isNull() | (F.col("_ratio") < F.col("_fits")), F.col("_cap")).otherwise(F.col("_fits") * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


#: Broadcast a table of sources only below so many rows.
BROADCAST_ROWS = 50_000


def _if_small(df: DataFrame) -> DataFrame:
    """A stored table of sources, marked for broadcast if its size allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _unit(seed: int) -> Column:
    """A number between 0 and 1 that hangs on a row's doc_id and text alone."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text"))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _counted(docs: DataFrame, share: float, cap: float, weights: tuple[int, ...], seed: int, quality: Column | None = None) -> DataFrame:
    """(_row: the columns of ``docs``, size, source_size, target, _times)."""
    names = [f"`{c}`" for c in docs.columns]
    given = [] if quality is None else [F.least(F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(LEAST_WEIGHT)), F.lit(1.0)).alias("_quality")]
    d = docs.select(F.struct(*names).alias("_row"), "source", "doc_id", "text", *given).withColumn("size", word_count())
    d = d.withColumn("_key", -F.log(_unit(seed)) / (F.col("_quality") if given else quality_weight())).drop("text", "_quality")
    light = common.stored(d.select("doc_id", "source", "size", "_key"), "mix-keys")

    sums = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sums = common.stored(sums, "mix-sizes")
    rows = sums.select(F.col("source").alias("_s"), "_rows")
    plan = source_targets(sums.drop("_rows"), share, cap, weights).join(rows, F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("_epochs", whole).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = common.stored(plan.withColumn("_cells", F.ceil(F.col("_rows") / CELL_ROWS).cast("long")).drop("_rows"), "mix-plan")

    # 1 - exp(-key) is uniform for weight 1; smaller weights fill later cells more, by a factor of 4 at most
    cell = F.floor((1 - F.exp(-F.col("_key"))) * F.col("_cells"))
    in_cells = light.join(_if_small(plan), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_cell", cell)
    per_cell = in_cells.groupBy("_s", "_cell").agg(F.sum("size").alias("_in"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    last = per_cell.filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_in") > F.col("_rest")))
    edge = last.groupBy(F.col("_s").alias("_es")).agg(F.min("_cell").alias("_edge"), F.min_by("_before", "_cell").alias("_before"))
    edge = common.stored(edge, "mix-edges")

    within = Window.partitionBy("_s").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = in_cells.join(_if_small(edge), F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_cell") == F.col("_edge")))
    fits = at_edge.withColumn("_run", F.col("_before") + F.sum("size").over(within)).filter(F.col("_run") - F.col("size") / 2 <= F.col("_rest"))
    cuts = fits.groupBy(F.col("_s").alias("_cs")).agg(F.max(F.struct("_key", "doc_id")).alias("_cut"))
    ends = edge.join(cuts, F.col("_es").eqNullSafe(F.col("_cs")), "left").select("_es", "_edge", "_cut")
    rule = common.stored(plan.join(ends, F.col("_s").eqNullSafe(F.col("_es")), "left").drop("_es"), "mix-rule")

    out = d.join(_if_small(rule), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_cell", cell)
    in_edge = (F.col("_cell") == F.col("_edge")) & F.coalesce(F.struct("_key", "doc_id") <= F.col("_cut"), F.lit(False))
    chosen = (F.col("_rest") > 0) & (F.col("_edge").isNull() | (F.col("_cell") < F.col("_edge")) | in_edge)
    times = (F.col("_epochs") + chosen.cast("long")).alias("_times")
    return out.select("_row", "size", "source_size", "target", times)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 42, quality: Column | None = None) -> DataFrame:
    """The columns of ``docs`` and size, source_size, target, taken (words that the mix takes of the
    row, repeats counted); a column of ``docs`` with one of these four names gives way.

    Null text has size 0; null is a source of its own, the last.  A row's key hangs on its doc_id,
    text and ``seed`` alone, so that reruns agree; rows equal in both are taken together.
    ``quality`` is a document's weight, from a column of ``docs`` such as a classifier's score, taken as at least
    ``LEAST_WEIGHT`` and at most 1 (null: the least); without it the words' usual length decides.
    A source's taken words miss its target by about its largest fractional document at most.
    """
    made = {"size", "source_size", "target", "taken"}
    got = _counted(docs, share, cap, weights, seed, quality)
    keep = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return got.select(*keep, "size", "source_size", "target", (F.col("_times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 42, quality: Column | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    got = _counted(docs, share, cap, weights, seed, quality).filter(F.col("_times") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy")
    return got.select("_row", copies).select([F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
