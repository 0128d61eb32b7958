"""Stored blocks of chains, made of recorded steps: cumulative states, samples, occupancy counts.

A recorded step is a row (wl_key, step, bin, occ). What a sampler would keep in
its state is grouped and summed over whole blocks of steps; nothing is stepped through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import json_double, json_list, json_object
from ..sources.catalogue import checkpointed
from .sampling import BLOCK_SCHEMA, GENESIS, state_bins
from .thermo import first_unique, pieced


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in their group by ``order``, of which the first is a number.

    Places are prefix sums over consecutive ranges, so that a group of any size is
    spread over all tasks.
    """
    cut = pieced(rows, order[0])
    sizes = cut.groupBy(*group, "__piece").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__piece", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*group, "__piece").orderBy(*order))
    out = cut.withColumn("__inside", inside).join(starts, [*group, "__piece"])
    return out.withColumn(name, F.col("__start") + F.col("__inside")).drop("__piece", "__inside", "__start")


def numbered(steps: DataFrame, per_block: int) -> DataFrame:
    """Steps with their place in the chain and the number of their block."""
    out = ranked(steps, ["wl_key"], ["step", "bin"], "place")
    return out.withColumn("number", F.floor((F.col("place") - 1) / F.lit(per_block)).cast("long"))


def block_states(placed: DataFrame) -> DataFrame:
    """(wl_key, number, bin, histogram, occurrences): a block's own visits and all so far, of every bin seen so far."""
    own = placed.groupBy("wl_key", "number", "bin").agg(F.count("*").alias("n"))
    seen = own.groupBy("wl_key", "bin").agg(F.min("number").alias("first"))
    last = own.groupBy("wl_key").agg(F.max("number").alias("last"))
    # A row for each later block of the chain, so that what isn't visited again is carried on.
    grid = seen.join(last, "wl_key").select("wl_key", "bin", F.explode(F.sequence("first", "last")).alias("number"))
    rows = grid.join(own, ["wl_key", "number", "bin"], "left").withColumn("histogram", F.coalesce("n", F.lit(0)).cast("long"))
    so_far = Window.partitionBy("wl_key", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("wl_key", "number", "bin", "histogram", F.sum("histogram").over(so_far).alias("occurrences"))


def recorded_blocks(steps: DataFrame, per_block: int, width: float, quota: int, factor: float = 0.5) -> DataFrame:
    """Blocks of ``per_block`` steps each, as a store keeps them (``BLOCK_SCHEMA``).

    ``steps``: (wl_key, step, bin, occ array<int>) of sampling at a fixed density, so that the entropy
    of a bin is the logarithm of its visits. Block n has the key of its chain and number,
    block n - 1 as parent and the factor ``factor`` ^ n. Samples are a bin's first ``quota`` distinct
    occupancies in the block; occupancy counts are by species of the one sublattice.
    """
    placed = checkpointed(numbered(steps, per_block))  # read by states, samples and counts
    key = F.sha2(F.concat_ws(":", "wl_key", F.col("number").cast("string")), 256)
    parent = F.when(F.col("number") == 0, F.lit(GENESIS)).otherwise(F.sha2(F.concat_ws(":", "wl_key", (F.col("number") - 1).cast("string")), 256))
    by_block = ["wl_key", "number"]
    ends = placed.groupBy(*by_block).agg(F.max("place").alias("step_end"))
    bins = F.array_sort(F.collect_list(F.struct("bin", "histogram", "occurrences")))
    states = block_states(placed).groupBy(*by_block).agg(bins.alias("b"))
    state = json_object({
        "version": F.lit("1"),
        "bin_size": json_double(F.lit(float(width))),
        "bin_indices": json_list(F.transform("b", lambda r: r["bin"])),
        "histogram": json_list(F.transform("b", lambda r: r["histogram"])),
        "occurrences": json_list(F.transform("b", lambda r: r["occurrences"])),
        "entropy": json_list(F.transform("b", lambda r: r["occurrences"]), lambda n: json_double(F.log(n.cast("double")))),
        "mod_factor": json_double(F.pow(F.lit(float(factor)), F.col("number"))),
    })
    text = placed.withColumn("said", json_list(F.col("occ")))
    samples = first_unique(text, [*by_block, "bin"], "said", "place", quota).groupBy(*by_block).agg(F.array_sort(F.collect_list(F.struct("bin", "said"))).alias("s"))
    species = placed.select(*by_block, "bin", F.col("place"), F.explode(F.array_distinct("occ")).alias("element"), "occ")
    sites = F.size(F.filter("occ", lambda o: o == F.col("element")))
    cations = species.groupBy(*by_block, "bin", "element", sites.alias("n_sites")).agg(F.count("*").alias("n"))
    cations = cations.groupBy(*by_block).agg(F.array_sort(F.collect_list(F.struct("bin", "element", "n_sites", "n"))).alias("c"))
    rows = ends.join(states, by_block).join(samples, by_block).join(cations, by_block)
    said = F.transform("s", lambda r: F.concat(F.lit("["), r["bin"].cast("string"), F.lit(","), r["said"], F.lit("]")))
    counted = F.transform("c", lambda r: F.concat(F.lit("["), F.concat_ws(",", r["bin"].cast("string"), F.lit("0"), r["element"].cast("string"), r["n_sites"].cast("string"), r["n"].cast("string")), F.lit("]")))
    updates = F.concat(F.lit("[["), F.col("step_end").cast("string"), F.lit(","), json_double(F.pow(F.lit(float(factor)), F.col("number"))), F.lit("]]"))
    columns = {
        "wl_key": F.col("wl_key"), "wl_block_key": key, "parent_wl_block_key": parent, "step_end": F.col("step_end"), "mod_factor": F.pow(F.lit(float(factor)), F.col("number")), "bins": F.size("b").cast("long"), "visits": F.col("step_end"),
        "state": state, "mod_updates": updates, "samples": json_list(said, lambda s: s), "cation_counts": json_list(counted, lambda s: s), "production_mode": F.lit(True),
    }
    return rows.select(*(columns[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in BLOCK_SCHEMA.split(", ")))


def resumed(tips: DataFrame, steps: DataFrame) -> DataFrame:
    """(wl_key, bin, occurrences) after ``steps`` more: what the tips' states hold and new visits."""
    held = state_bins(tips).select("wl_key", "bin", "occurrences")
    new = steps.groupBy("wl_key", "bin").agg(F.count("*").alias("occurrences"))
    return held.unionByName(new).groupBy("wl_key", "bin").agg(F.sum("occurrences").alias("occurrences"))
