"""Streaming density of states: each event adds to its chain's checkpointed state.

A chain's modification factor and histogram change at the ends of check periods
alone. So a first stream turns each micro-batch into counts by chain, check period and bin,
spread over all tasks whatever the share of a chain; a second stream applies these
counts, period by period, to a state keyed by bin.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import ranked
from ..operators.thermo import FLATNESS, bin_id

PERIODS = "chain string, period long, bin long, n long"
TOTALS = "chain string, steps long"
OUTPUT = "chain string, steps long, bins long, mod_factor double, state string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def period_counts(events: DataFrame, before: DataFrame, width: float, check_period: int) -> DataFrame:
    """(chain, period, bin, n) of a batch of (chain, energy, step).

    An event's place in its chain is ``before`` (chain, steps) plus its rank by
    step in the batch; a period holds ``check_period`` places. Ranks are prefix
    sums over consecutive ranges of steps, so that a chain with most
    events is spread over all tasks. Events without a step come first, equal ones in the order
    of energies; an energy that is no finite number has no bin and takes no place.
    """
    rows = events.select("chain", "step", bin_id(F.col("energy"), width).alias("bin"), "energy").where("bin IS NOT NULL")
    placed = ranked(rows, ["chain"], ["step", "energy"]).join(before.withColumnRenamed("steps", "__before"), "chain", "left")
    period = F.floor((F.coalesce("__before", F.lit(0)) + F.col("rank") - 1) / F.lit(check_period)).cast("long")
    return placed.groupBy("chain", period.alias("period"), "bin").agg(F.count("*").alias("n"))


class ChainState(StatefulProcessor):
    """Entropy and histogram by bin, steps and factor of each chain; a flat histogram halves the factor."""

    def __init__(self, check_period: int):
        self.check_period = check_period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "steps long, m double")
        self.by_bin = handle.getMapState("by_bin", "bin long", "entropy double, histogram long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps, m = self.totals.get() if self.totals.exists() else (0, 1.0)
        known = {int(k[0]): tuple(v) for k, v in self.by_bin.iterator()}
        counts = pd.concat(list(rows)).sort_values(["period", "bin"])
        bins = np.unique(np.concatenate([np.fromiter(known, dtype=np.int64, count=len(known)), counts["bin"].to_numpy()]))
        entropy, histogram, seen = np.zeros(len(bins)), np.zeros(len(bins), dtype=np.int64), np.zeros(len(bins), dtype=bool)
        for k, (s, h) in known.items():
            i = np.searchsorted(bins, k)
            entropy[i], histogram[i], seen[i] = s, h, True
        place, n = np.searchsorted(bins, counts["bin"].to_numpy()), counts["n"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(counts["period"].to_numpy())) + 1, len(counts)).tolist()
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            own = place[i:j]
            entropy[own] += m * n[i:j]
            histogram[own] += n[i:j]
            seen[own] = True
            steps += int(n[i:j].sum())
            if steps % self.check_period == 0:
                h = histogram[seen]
                if len(h) >= 2 and h.min() > FLATNESS * h.mean():
                    histogram[:] = 0
                    m /= 2
        for b, s, h in zip(bins.tolist(), entropy.tolist(), histogram.tolist(), strict=True):
            if known.get(b) != (s, h):
                self.by_bin.updateValue((b,), (s, h))
        self.totals.update((steps, m))
        state = pd.DataFrame({"bin": bins, "entropy": entropy, "histogram": histogram}).to_json(orient="records")
        yield pd.DataFrame([(key[0], steps, len(bins), m, state)], columns=["chain", "steps", "bins", "mod_factor", "state"])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _keyed_state(spark: SparkSession):
    """State of a stream started within is kept by key, in the store that map states need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _run(stream: DataFrame, mode: str, keep, checkpoint: str) -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()


def _begin(spark: SparkSession, path: str, schema: str) -> None:
    """An empty batch before the first, so that a stream without rows has readable results."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")


def stream_periods(spark: SparkSession, events: DataFrame, width: float, check_period: int, out: str, checkpoint: str) -> None:
    """The counts of a stream of (chain, energy, step), a folder a batch under ``out``/counts, and
    under ``out``/totals each chain's steps so far. A batch that comes again after a failure is written over."""

    _begin(spark, f"{out}/counts", PERIODS)
    _begin(spark, f"{out}/totals", TOTALS)

    def keep(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(TOTALS).parquet(f"{out}/totals/batch={batch_id - 1}")
        period_counts(batch, before, width, check_period).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        more = own.read.schema(PERIODS).parquet(f"{out}/counts/batch={batch_id}").groupBy("chain").agg(F.sum("n").alias("steps"))
        before.unionByName(more).groupBy("chain").agg(F.sum("steps").alias("steps")).write.mode("overwrite").parquet(f"{out}/totals/batch={batch_id}")

    _run(events, "append", keep, f"{checkpoint}/periods")


def chain_states(counts: DataFrame, check_period: int) -> DataFrame:
    """A stream of (chain, period, bin, n) as a stream of chain states, one row a chain and batch.

    A period may go on in the next batch, with counts of its own; no batch may
    hold an earlier period than the batches before it. A task holds a chain's
    counts of one batch: as many as its periods have bins, not events.
    """
    return counts.groupBy("chain").transformWithStateInPandas(ChainState(check_period), OUTPUT, "Update", "None")


def final_states(spark: SparkSession, events: DataFrame, width: float, check_period: int, out: str, checkpoint: str) -> DataFrame:
    """Run both streams over what ``events``, a stream of (chain, energy, step), has now; the last state of each chain.

    Called again with the same folders, only new events are read, and states go on from where they were.
    """
    stream_periods(spark, events, width, check_period, out, checkpoint)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/states/batch={batch_id}")

    _begin(spark, f"{out}/states", OUTPUT)
    counts = spark.readStream.schema(PERIODS + ", batch long").parquet(f"{out}/counts").drop("batch")
    with _keyed_state(spark):
        _run(chain_states(counts, check_period), "update", keep, f"{checkpoint}/states")
    written = spark.read.schema(OUTPUT + ", batch long").parquet(f"{out}/states")
    latest = written.groupBy("chain").agg(F.max(F.struct("steps", "bins", "mod_factor", "state")).alias("r"))
    return latest.select("chain", "r.*")


def counted_visits(spark: SparkSession, path: str, schema, width: float, out: str, checkpoint: str) -> DataFrame:
    """(chain, bin, n) of a stream of events: each batch adds its counts to those
    of its bins, so that the state is as large as the bins are many, whatever the
    share of one chain."""
    from ..operators.thermo import occurrences

    events = spark.readStream.schema(schema).parquet(path)
    counts = occurrences(events.withColumnRenamed("event_type", "chain"), "value", width, ["chain"])

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(counts, "update", keep, checkpoint)
    written = spark.read.schema("chain string, bin long, n long, batch long").parquet(out)
    return written.groupBy("chain", "bin").agg(F.max("n").alias("n"))
