"""Thermodynamic averages over a density of states.

A density of states is a table (keys..., bin, energy, entropy). Sums over bins
are grouped aggregates; weights are shifted by the largest exponent of their
group first, so that no exponential overflows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Boltzmann constants in eV/K of the heat capacity and of bin property mixing. Fixed values.
KB_CV = 8.617333262e-5
KB_MIX = 8.617333262145e-5
FLATNESS = 0.8
#: Most rows of a dimension or a grid that are broadcast.
BROADCAST_ROWS = 100_000


def bin_id(energy: Column, width: float) -> Column:
    """Index of the bin of an energy, anchored at 0; null for an infinite one."""
    return F.when(F.abs(energy) != float("inf"), F.floor(energy / F.lit(width)).cast("long"))


def bin_level(index: Column, width: float | Column) -> Column:
    """Representative energy: the bin's lower edge."""
    return index * (width if isinstance(width, Column) else F.lit(width))


def occurrences(rows: DataFrame, energy: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., bin, n): visits by bin."""
    return rows.groupBy(*keys, bin_id(F.col(energy), width).alias("bin")).agg(F.count("*").alias("n"))


def density_of_states(rows: DataFrame, energy: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., bin, n, energy, entropy) with entropy ln n."""
    n = occurrences(rows, energy, width, keys)
    return n.select(*keys, "bin", "n", bin_level(F.col("bin"), width).alias("energy"), F.log(F.col("n").cast("double")).alias("entropy"))


def normalised(dos: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both normalisations: ``g_min`` = exp(S - min S), ``g_max`` = exp(S - max S) / sum."""
    edge = dos.groupBy(*keys).agg(F.min("entropy").alias("low"), F.max("entropy").alias("high")) if keys else dos.agg(F.min("entropy").alias("low"), F.max("entropy").alias("high"))
    with_edge = dos.join(edge, list(keys)) if keys else dos.crossJoin(F.broadcast(edge))
    shifted = with_edge.withColumn("w", F.exp(F.col("entropy") - F.col("high")))
    total = shifted.groupBy(*keys).agg(F.sum("w").alias("total")) if keys else shifted.agg(F.sum("w").alias("total"))
    out = shifted.join(total, list(keys)) if keys else shifted.crossJoin(F.broadcast(total))
    return out.select(*keys, "bin", F.exp(F.col("entropy") - F.col("low")).alias("g_min"), (F.col("w") / F.col("total")).alias("g_max"))


def temperatures(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    """A grid of temperatures as a one-column table, of at most ``BROADCAST_ROWS``, since it is broadcast."""
    if len(values) > BROADCAST_ROWS:
        raise ValueError(f"{len(values)} temperatures; at most {BROADCAST_ROWS}")
    return spark.createDataFrame([(float(t),) for t in values], "temperature double")


def canonical_average(dos: DataFrame, prop: DataFrame, grid: Sequence[float], kb: float = KB_MIX, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(keys..., temperature, mean): softmax over bins of S - E/(kb T), applied to a property.

    ``prop`` is (keys..., bin, value) and ``dos`` (keys..., bin, energy, entropy);
    a key that one of them lacks holds for all of its rows. Bins without a
    property or an entropy play no part. Weights that all vanish give the plain
    mean.
    """
    spark = dos.sparkSession
    t = F.broadcast(temperatures(spark, grid))
    own = [k for k in keys if k in dos.columns]
    both = [k for k in own if k in prop.columns]
    rows = prop.join(dos.select(*own, "bin", "energy", "entropy"), [*both, "bin"]).crossJoin(t)
    rows = rows.withColumn("x", F.col("entropy") - F.col("energy") / (F.lit(kb) * F.col("temperature")))
    top = rows.groupBy(*keys, "temperature").agg(F.max("x").alias("top"))
    w = F.exp(F.col("x") - F.col("top"))
    sums = rows.join(top, [*keys, "temperature"]).groupBy(*keys, "temperature").agg(F.sum(w * F.col(value)).alias("a"), F.sum(w).alias("z"), F.avg(value).alias("plain"))
    return sums.select(*keys, "temperature", F.when(F.col("z") > 0, F.col("a") / F.col("z")).otherwise(F.col("plain")).alias("mean"))


def heat_capacity(dos: DataFrame, grid: Sequence[float], kb: float = KB_CV) -> DataFrame:
    """(temperature, z, u, u2, cv) with weights exp((S - max S) - (E - min E)/(kb T))."""
    edge = F.broadcast(dos.agg(F.max("entropy").alias("smax"), F.min("energy").alias("emin")))
    rows = dos.crossJoin(edge).crossJoin(F.broadcast(temperatures(dos.sparkSession, grid)))
    w = F.exp((F.col("entropy") - F.col("smax")) - (F.col("energy") - F.col("emin")) / (F.lit(kb) * F.col("temperature")))
    sums = rows.groupBy("temperature").agg(F.sum(w).alias("z0"), F.sum(w * F.col("energy")).alias("a"), F.sum(w * F.col("energy") * F.col("energy")).alias("b"))
    z = F.when(F.col("z0") == 0, F.lit(2.2250738585072014e-308)).otherwise(F.col("z0"))
    u, u2 = F.col("a") / z, F.col("b") / z
    return sums.select("temperature", z.alias("z"), u.alias("u"), u2.alias("u2"), ((u2 - u * u) / (F.lit(kb) * F.col("temperature") * F.col("temperature"))).alias("cv"))


def flatness(histogram: DataFrame, keys: Sequence[str], count: str = "n", threshold: float = FLATNESS) -> DataFrame:
    """(keys..., bins, flat): two bins or more and each above ``threshold`` of the mean."""
    agg = histogram.groupBy(*keys).agg(F.count("*").alias("bins"), F.min(count).alias("low"), F.avg(count).alias("mean"))
    return agg.select(*keys, "bins", ((F.col("bins") >= 2) & (F.col("low") > F.lit(threshold) * F.col("mean"))).alias("flat"))


def first_unique(rows: DataFrame, group: Sequence[str], item: str, order: str, k: int) -> DataFrame:
    """The first ``k`` distinct items of each group in capture order, with their rank.

    Distinct items are found by a grouped minimum, so that the ranking window
    sees each item once.
    """
    firsts = rows.groupBy(*group, item).agg(F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order, item))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= k)


def coverage(samples: DataFrame, group: Sequence[str], quota: int) -> DataFrame:
    """(group..., bins, full_bins, samples, mean): how far bins have their quota of samples."""
    per_bin = samples.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    return per_bin.groupBy(*group).agg(F.count("*").alias("bins"), F.count_if(F.col("n") >= quota).alias("full_bins"), F.sum("n").alias("samples"), F.avg("n").alias("mean"))


def cation_totals(counts: DataFrame) -> DataFrame:
    """(bin, sublattice, element, n_sites) -> summed count."""
    return counts.groupBy("bin", "sublattice", "element", "n_sites").agg(F.sum("count").alias("count"))


def composition_by_bin(counts: DataFrame) -> DataFrame:
    """x(E): an element's share of visited sites within (bin, sublattice); groups without any are left out."""
    site_visits = F.sum(F.col("n_sites") * F.col("count"))
    by_element = counts.groupBy("bin", "sublattice", "element").agg(site_visits.alias("num"))
    total = by_element.groupBy("bin", "sublattice").agg(F.sum("num").alias("den")).where("den > 0")
    return by_element.join(total, ["bin", "sublattice"]).select("bin", "sublattice", "element", (F.col("num") / F.col("den")).alias("x"))


def purity_by_bin(counts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Visit-weighted mean of max(n, N - n) / N by (bin, sublattice, element).

    N is the largest n_sites seen on the sublattice, which is too small if no
    visited bin is pure, unless ``sizes`` (sublattice, size) gives it.
    """
    if sizes is None:
        sizes = counts.groupBy("sublattice").agg(F.max("n_sites").alias("size"))
    rows = counts.join(sizes, "sublattice").where("size > 0")
    pure = F.greatest(F.col("n_sites"), F.col("size") - F.col("n_sites")) / F.col("size")
    sums = rows.groupBy("bin", "sublattice", "element").agg(F.sum(pure * F.col("count")).alias("a"), F.sum("count").alias("b"))
    return sums.where("b > 0").select("bin", "sublattice", "element", (F.col("a") / F.col("b")).alias("purity"))


def densified(counts: DataFrame, group: Sequence[str], item: str, items: DataFrame, count: str = "n") -> DataFrame:
    """A row for every (group, allowed item), 0 where it doesn't occur. ``items`` is a dimension:
    counted, and broadcast up to ``BROADCAST_ROWS`` of them; more are listed once a group after a shuffle."""
    allowed = items.select(item).distinct()
    if allowed.count() <= BROADCAST_ROWS:
        allowed = F.broadcast(allowed)
    grid = counts.select(*group).distinct().crossJoin(allowed)
    return grid.join(counts, [*group, item], "left").select(*group, item, F.coalesce(F.col(count), F.lit(0)).cast("long").alias(count))


def pieced(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with a column __piece: consecutive ranges of a numeric ``order``, about
    as many as there are shuffle partitions; rows without an order come first.

    A prefix over a group of any size then takes two windows, one over the rows
    of a piece and one over one row a piece.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not cuts:
        return rows.withColumn("__piece", F.lit(0.0))
    x = F.col(order).cast("double")
    wide = rows.withColumn("__x", x)
    out = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__x", outputCol="__piece", handleInvalid="keep").transform(wide)
    return out.withColumn("__piece", F.when(F.col("__x").isNull(), F.lit(-1.0)).otherwise(F.col("__piece"))).drop("__x")


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows of a piece behind the row that holds what comes before the piece."""
    return rows.withColumn("__own", F.lit(True)).unionByName(carry.withColumn("__own", F.lit(False)), allowMissingColumns=True)


def _before(group: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)


def _so_far(group: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*group, "__piece").orderBy("__own", order).rowsBetween(Window.unboundedPreceding, 0)


def running_mean(rows: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """The mean of all values so far within the group, in ``order`` (a number); null before the first value.

    Sums and counts of each piece of a group are carried to the next one, so that
    a group that holds most rows is spread over all tasks.
    """
    cut = pieced(rows, order).withColumn("__sum", F.col(value)).withColumn("__n", F.col(value).isNotNull().cast("long"))
    totals = cut.groupBy(*group, "__piece").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    w = _before(group)
    carry = totals.select(*group, "__piece", F.sum("__sum").over(w).alias("__sum"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__n"))
    w = _so_far(group, order)
    n = F.sum("__n").over(w)
    mean = F.when(n > 0, F.sum("__sum").over(w).cast("double") / n)
    return _with_carry(cut, carry).withColumn("running_mean", mean).where("__own").drop("__own", "__piece", "__sum", "__n")


def filled_forward(rows: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """``rows`` with missing values replaced by the last one before them in the group, in
    ``order`` (a number); null before the first value. Pieces as in ``running_mean``."""
    cut = pieced(rows, order)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value]
    tips = cut.groupBy(*group, "__piece").agg(last.alias(value))
    carry = tips.select(*group, "__piece", F.last(value, ignorenulls=True).over(_before(group)).alias(value))
    return _with_carry(cut, carry).withColumn(value, F.last(value, ignorenulls=True).over(_so_far(group, order))).where("__own").drop("__own", "__piece")


def mod_schedule(updates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chain, step, m): the modification factor's steps over a chain of blocks.

    ``updates``: (chain, step_end, pos, step, m); ``blocks``: (chain, step_end,
    mod_factor). Of updates at one step the last stays. The series starts at
    step 0 with the first block's end value, beside any recorded step 0; a
    chain without updates runs from 0 to its last step.
    """
    last = Window.partitionBy("chain", "step").orderBy(F.desc("step_end"), F.desc("pos"))
    kept = updates.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("chain", "step", "m")
    first = blocks.groupBy("chain").agg(F.min(F.struct("step_end", "mod_factor"))["mod_factor"].alias("m"), F.max("step_end").alias("tip"))
    start = first.select("chain", F.lit(0).cast("long").alias("step"), "m")
    bare = first.join(updates.select("chain").distinct(), "chain", "left_anti").select("chain", F.col("tip").alias("step"), "m")
    return start.unionByName(kept).unionByName(bare)


def extended(schedule: DataFrame, ends: DataFrame) -> DataFrame:
    """A tail row at each chain's right edge (chain, right), with the last m, where the series stops short of it."""
    tip = schedule.groupBy("chain").agg(F.max(F.struct("step", "m")).alias("t"))
    tail = tip.join(ends, "chain").where(F.col("t.step") < F.col("right"))
    return schedule.unionByName(tail.select("chain", F.col("right").alias("step"), F.col("t.m").alias("m")))


def bins_per_width(rows: DataFrame, energy: str, widths: Sequence[float]) -> DataFrame:
    """(width, bins): how many bins each width needs, in one pass."""
    t = F.explode(F.array(*(F.lit(float(w)) for w in widths)))
    wide = rows.select(F.col(energy).alias("e"), t.alias("width"))
    return wide.groupBy("width").agg(F.countDistinct(F.floor(F.col("e") / F.col("width"))).alias("bins"))


class Occupancy:
    """Occupied bins at the finest dyadic width that has at most ``cap`` of them.

    Bins of width w 2^k are the halves of those of width w 2^(k + 1), so that the
    set at one level gives all coarser ones; of finer levels it is known that they
    have more than ``cap``. Two sketches merge at the coarser level of both.
    """

    def __init__(self, level: int, cap: int):
        self.level, self.cap = level, cap
        self.bins = np.empty(0)

    def add(self, level: int, bins: np.ndarray) -> None:
        """Bins of ``level``, as whole floats: an index beyond 2^53 is as exact as the energy it comes from."""
        while self.level < level:
            self._coarsen()
        for _ in range(self.level - level):
            bins = np.floor(bins / 2)
        self.bins = np.union1d(self.bins, bins)
        while len(self.bins) > self.cap:
            self._coarsen()

    def _coarsen(self) -> None:
        self.bins, self.level = np.unique(np.floor(self.bins / 2)), self.level + 1

    def count(self, level: int) -> float:
        """How many bins ``level`` has; infinite for one that is too fine to tell."""
        if level < self.level:
            return float("inf")
        bins = self.bins
        for _ in range(level - self.level):
            bins = np.unique(np.floor(bins / 2))
        return len(bins)


def occupancy(rows: DataFrame, energy: str, width: float, finest: int, cap: int) -> Occupancy:
    """The sketch of all finite energies over widths ``width`` 2^k from k = ``finest`` on, by one job.

    Tasks emit at most ``cap`` bins each, which are merged in two stages.
    """

    def fold(batches: Iterator[pa.RecordBatch], raw: bool) -> Iterator[pa.RecordBatch]:
        held = Occupancy(finest, cap)
        for batch in batches:
            if raw and batch.num_rows:
                e = batch.column(0).to_numpy(zero_copy_only=False)
                held.add(finest, np.unique(np.floor(e[np.isfinite(e)] / (width * 2.0**finest))))
            elif batch.num_rows:
                levels, bins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for level in np.unique(levels).tolist():
                    held.add(level, bins[levels == level])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held.bins), held.level), pa.int32()), pa.array(held.bins, pa.float64())], names=["level", "bin"])

    schema = "level int, bin double"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select(F.col(energy).cast("double").alias("e")).where("e IS NOT NULL").mapInArrow(lambda b: fold(b, True), schema)
    merged = parts.repartition(n, F.floor(F.rand(0) * n)).mapInArrow(lambda b: fold(b, False), schema)
    out = Occupancy(finest, cap)
    for level, bins in merged.groupBy("level").agg(F.collect_set("bin").alias("bins")).collect():
        out.add(level, np.array(bins))
    return out


def adapted_width(rows: DataFrame, energy: str, width: float, least: int = 50, most: int = 200, rounds: int = 40) -> float:
    """Halve the width below ``least`` bins and double it above ``most``, until neither holds.

    One job gives the bins of all these widths. Raises after ``rounds`` steps, or
    when a width comes back.
    """
    bins = occupancy(rows, energy, width, -rounds, max(4_096, most + 1))
    level, seen = 0, set()
    for _ in range(rounds):
        if level in seen:
            break
        seen.add(level)
        n = bins.count(level)
        if n < least:
            level -= 1
        elif n > most:
            level += 1
        else:
            return width * 2.0**level
    raise ValueError(f"no width gives {least} to {most} bins")
