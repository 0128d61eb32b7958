"""Design of experiments: metrics of a feature matrix and D-optimal selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import feature_matrix, gathered, gram_rows

EPS = 1e-12


@dataclass
class DesignMetrics:
    n_samples: int
    n_features: int
    rank: int
    sigma_max: float
    sigma_min: float
    condition_number: float
    logdet_xtx: float
    leverage_mean: float
    leverage_max: float
    leverage_p95: float
    zero_variance_features: int
    weighting_applied: bool
    standardized: bool


def design_metrics(rows: DataFrame, features: str, weight: str | None = None, standardize: bool = True, eps: float = EPS) -> DesignMetrics:
    """Metrics of the rows scaled by the root of their weights and, by column, standardised.

    Gram matrix and column sums come from one pass, leverages from a second.
    Singular values are roots of eigenvalues, so those below about 1e-8 of the
    largest aren't told from zero.
    """
    ones = F.concat(F.col(features).cast("array<double>"), F.array((F.lit(1.0) / F.sqrt(F.col(weight)) if weight else F.lit(1.0))))
    g = gathered(gram_rows(rows.withColumn("__x", ones), "__x", weight=weight))
    if not g:
        raise ValueError("no rows")
    g = g[0]
    n, p = round(g[-1, -1]), len(g) - 1
    xx = g[:p, :p]
    # Column sums of the scaled rows: sum of sqrt(w) x = sum of w x / sqrt(w).
    sums = g[:p, -1]
    mean = sums / n
    std = np.sqrt(np.maximum(np.diag(xx) / n - mean**2, 0))
    zero = std <= max(eps, 1e-9)
    centre, scale = (mean, np.where(zero, 1.0, std)) if standardize else (np.zeros(p), np.ones(p))
    z = (xx - n * np.outer(centre, mean) - n * np.outer(mean, centre) + n * np.outer(centre, centre)) / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(z)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values > max(eps**2, values[0] * 1e-14 if len(values) else 0)
    s = np.sqrt(values[kept])
    rank = int(kept.sum())
    projector = vectors[:, kept] / s if rank else np.zeros((p, 0))

    def leverages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = feature_matrix(batch.column(0))
                h = ((((x * np.sqrt(batch.column(1).to_numpy())[:, None]) - centre) / scale) @ projector) ** 2
                yield pa.RecordBatch.from_arrays([pa.array(h.sum(axis=1))], names=["h"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    h = rows.select(F.col(features).cast("array<double>").alias("x"), w.alias("w")).mapInArrow(leverages, "h double").agg(F.max("h"), F.percentile("h", 0.95)).first()
    return DesignMetrics(
        n, p, rank, float(s[0]) if rank else 0.0, float(s[-1]) if rank else 0.0, float(s[0] / s[-1]) if rank else float("inf"), float(2 * np.log(s).sum()) if rank else float("-inf"),
        rank / n if rank else float("nan"), float(h[0]) if rank else float("nan"), float(h[1]) if rank else float("nan"), int(zero.sum()), weight is not None, standardize,
    )


def metrics_frame(spark: SparkSession, m: DesignMetrics) -> DataFrame:
    kinds = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}
    values = asdict(m)
    return spark.createDataFrame([tuple(values.values())], T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()]))


def selection_sizes(candidates: DataFrame) -> DataFrame:
    """(pool, n_candidates, n_groups, p, seed_size): the sizes of each pool's choice."""
    return candidates.groupBy("pool").agg(F.count("*").alias("n_candidates"), F.count_distinct("grp").alias("n_groups"), F.max(F.size("x")).alias("p"), F.count_if("is_seed").alias("seed_size"))


def tie_key(bin_index: int | None, occ_hash: str) -> tuple[str, str]:
    """The order among equal gains: bins as text of twelve places, sign first, so
    that -5 comes before -10 and both before positive ones; no bin last."""
    return ("~~~~" if bin_index is None else str(int(bin_index)).zfill(12), occ_hash)


def _gain(x: np.ndarray, inverse: np.ndarray) -> float:
    """log1p(x A^-1 x') of one row: the same number wherever the row stands."""
    return float(np.log1p(x @ (inverse @ x)))


class _Held:
    """Candidates of one pool and group in memory: the best by gains that may be stale.

    The information matrix only grows, so gains never do: a stale gain is an upper
    bound, and so is ``bound`` for all candidates that aren't held.
    """

    def __init__(self, x: np.ndarray, gains: np.ndarray, ties: list[tuple[str, str]], rows: list, bound: float):
        order = np.argsort(-gains, kind="stable")
        self.x, self.stale, self.bound = x[order], gains[order], bound
        self.ties, self.rows = [ties[i] for i in order.tolist()], [rows[i] for i in order.tolist()]

    def best(self, inverse: np.ndarray, tolerance: float) -> int | None:
        """Place of the pick: the least tie key among the gains within ``tolerance`` of the greatest.
        None if a candidate that isn't held might come before it."""
        fresh: list[float] = []
        top = -np.inf
        # Stale gains come from matrix products, whose last digits depend on their shape.
        slack = tolerance + SLACK * max(1.0, abs(float(self.stale[0]))) if len(self.stale) else tolerance
        for i in range(len(self.stale)):
            if self.stale[i] < top - slack:
                break
            fresh.append(_gain(self.x[i], inverse))
            top = max(top, fresh[-1])
        if self.bound > top - slack:
            return None
        place = min((i for i, g in enumerate(fresh) if abs(g - top) <= tolerance), key=lambda i: self.ties[i])
        n = len(fresh)
        self.stale[:n] = np.minimum(self.stale[:n], fresh)
        return place

    def without(self, place: int) -> None:
        keep = np.arange(len(self.stale)) != place
        order = np.flatnonzero(keep)[np.argsort(-self.stale[keep], kind="stable")]
        self.x, self.stale = self.x[order], self.stale[order]
        self.ties, self.rows = [self.ties[i] for i in order.tolist()], [self.rows[i] for i in order.tolist()]


class _Pool:
    """The choice of one pool: its inverse, its picks, whose turn it is."""

    def __init__(self, budget: int, ridge: float, tolerance: float):
        self.budget, self.ridge, self.tolerance = budget, ridge, tolerance
        self.inverse: np.ndarray | None = None
        self.chosen: list = []
        self.groups: list = []
        self.turn = 0

    def take(self, x: np.ndarray, row) -> None:
        if self.inverse is None:
            self.inverse = np.eye(len(x)) / self.ridge
        v = self.inverse @ x
        self.inverse -= np.outer(v, v) / (1 + x @ v)
        self.chosen.append(row)

    def group_on_turn(self):
        """The group whose candidates the next pick is among, or None."""
        return self.groups[self.turn % len(self.groups)] if self.groups and len(self.chosen) < self.budget else None

    def advance(self, held: dict) -> None:
        """Picks by sweeps over the groups, as long as what is held decides them. ``held``: _Held by group."""
        while self.groups and len(self.chosen) < self.budget:
            self.turn %= len(self.groups)
            own = held.get(self.groups[self.turn])
            if own is None or (not len(own.stale) and own.bound == -np.inf):
                self.groups.pop(self.turn)
                continue
            if self.inverse is None:
                self.inverse = np.eye(own.x.shape[1]) / self.ridge
            place = own.best(self.inverse, self.tolerance)
            if place is None:
                return
            self.take(own.x[place], own.rows[place])
            own.without(place)
            self.turn += 1


def d_optimal(x: np.ndarray, seeds: np.ndarray, groups: list[str], ties: list[tuple[str, str]], budget: int, ridge: float = 1e-10, tolerance: float = 1e-15) -> list[int]:
    """Rows in the order chosen: all seeds, then sweeps of one pick a group.

    The pick has the greatest log1p(x A^-1 x'), the least tie key among those
    within the tolerance; A^-1 is kept up to date by rank-one corrections.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    if not len(x):
        raise ValueError("no candidates")
    if budget < int(seeds.sum()):
        raise ValueError("the budget is below the number of endpoints")
    pool = _Pool(budget, ridge, tolerance)
    for i in np.flatnonzero(seeds).tolist():
        pool.take(x[i], i)
    pool.groups = sorted(set(groups))
    held = {}
    for g in pool.groups:
        own = [i for i, h in enumerate(groups) if h == g and not seeds[i]]
        held[g] = _Held(x[own], np.full(len(own), np.inf), [ties[i] for i in own], own, -np.inf)
    pool.advance(held)
    return pool.chosen


def _best(found: list[dict], tolerance: float) -> list[dict]:
    """Those that may be the pick: each has a greater gain than all of lesser tie keys, and is near the greatest."""
    most = max((r["gain"] for r in found), default=0.0)
    out: list[dict] = []
    for r in sorted((r for r in found if r["gain"] >= most - tolerance), key=lambda r: tie_key(r["bin"], r["occ_hash"])):
        if not out or r["gain"] > out[-1]["gain"]:
            out.append(r)
    return out


@dataclass
class _Pass:
    """What a pass over the candidates needs: each pool's inverse, the group on its turn and
    the hashes taken from that group, and how many rows of a group are kept."""

    inverses: dict
    turns: dict
    taken: dict
    most: int
    ridge: float
    tolerance: float

    def gains(self, pool, x: np.ndarray) -> np.ndarray:
        a = self.inverses.get(pool)
        return np.log1p(np.einsum("ij,ij->i", x @ a, x) if a is not None else np.einsum("ij,ij->i", x, x) / self.ridge)

    def front(self, pool, rows: pa.RecordBatch, x: np.ndarray, gains: np.ndarray) -> list[dict]:
        """Of some rows of the group on turn those that may be the next pick, by exact gains."""
        a = self.inverses.get(pool, np.eye(x.shape[1]) / self.ridge)
        near = np.flatnonzero(gains >= gains.max() - self.tolerance - SLACK * max(1.0, abs(float(gains.max()))))
        found = [r | {"gain": _gain(x[i], a)} for i, r in zip(near.tolist(), rows.take(pa.array(near)).to_pylist(), strict=True)]
        return _best(found, self.tolerance)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``most`` rows of greatest gain of each pool and group in the task, and as
        rows with ``front`` those that may be the next pick of their pool."""
        kept: pa.Table | None = None
        fronts: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = feature_matrix(batch.column("x"))
            pools, hashes = batch.column("pool").dictionary_encode(), batch.column("occ_hash")
            of, gains = pools.indices.to_numpy(), np.empty(len(x))
            for k, pool in enumerate(pools.dictionary.to_pylist()):
                own = np.flatnonzero(of == k)
                gains[own] = self.gains(pool, x[own])
                on_turn = pa.compute.equal(batch.column("grp").take(pa.array(own)), self.turns[pool]).to_numpy(zero_copy_only=False)
                gone = pa.compute.is_in(hashes.take(pa.array(own)), value_set=pa.array(self.taken[pool], pa.string())).to_numpy(zero_copy_only=False)
                own = own[on_turn.astype(bool) & ~gone]
                if len(own):
                    fronts[pool] = _best(fronts.get(pool, []) + self.front(pool, batch.take(pa.array(own)), x[own], gains[own]), self.tolerance)
            part = pa.Table.from_batches([batch]).append_column("gain", pa.array(gains)).append_column("front", pa.array(np.zeros(len(x), dtype=bool)))
            kept = part if kept is None else pa.concat_tables([kept, part])
            names = pa.compute.binary_join_element_wise(kept.column("pool").cast(pa.string()), kept.column("grp").cast(pa.string()), "\x00")
            group = names.combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((-kept.column("gain").to_numpy(), group))
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            kept = kept.take(pa.array(order[place < self.most]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches(max_chunksize=10_000)
            yield pa.RecordBatch.from_pylist([r | {"front": True} for found in fronts.values() for r in found], schema=kept.schema)


#: Part of a gain by which matrix products of other shapes may differ in it.
SLACK = 1e-9
#: Bytes of candidates' features that the driver holds between two passes.
HELD_BYTES = 64 << 20


def select_d_optimal(pools: DataFrame, budget: int, ridge: float = 1e-10, tolerance: float = 1e-15, held_bytes: int = HELD_BYTES, passes: list | None = None) -> DataFrame:
    """(pool, place, id, is_seed): the D-optimal rows of each pool, as ``d_optimal`` has them.

    ``pools``: (pool, id, is_seed, grp, bin, occ_hash, x). Of equal hashes the
    first stays, seeds first. A greedy choice with stale gains: gains never grow as rows
    are taken, so one pass over all candidates where they are keeps the
    strongest of each pool and group, as many as ``held_bytes`` of features allow (64 at least), and the
    driver makes picks from them until one that isn't held might be better; then comes the
    next pass. A pass settles each pool's next pick whatever is equal. The driver holds these, a p x p inverse and the picks of each pool.
    ``passes``, if given, gets an entry a pass.
    """
    spark = pools.sparkSession
    if budget <= 0:
        raise ValueError("the budget must be positive")
    first = F.min_by(F.struct("id", "is_seed", "grp", "bin", "x"), F.struct(~F.col("is_seed"), "id")).alias("r")
    rows = pools.withColumn("x", F.col("x").cast("array<double>")).groupBy("pool", "occ_hash").agg(first)
    rows = rows.select("pool", "occ_hash", F.col("r.id").cast("long").alias("id"), "r.is_seed", "r.grp", F.col("r.bin").cast("long").alias("bin"), "r.x").persist()
    groups: dict = {}
    sizes, p = {}, 1
    for r in rows.groupBy("pool", "grp").agg(F.count_if("is_seed").alias("seeds"), F.count_if(~F.col("is_seed")).alias("others"), F.max(F.size("x")).alias("p")).collect():
        groups.setdefault(r["pool"], {})[r["grp"]] = r["seeds"]
        sizes[r["pool"], r["grp"]] = r["others"]
        p = max(p, r["p"])
    if any(sum(g.values()) > budget for g in groups.values()):
        raise ValueError("the budget is below the number of endpoints")
    states = {pool: _Pool(budget, ridge, tolerance) for pool in groups}
    for r in sorted(rows.where("is_seed").collect(), key=lambda r: r["id"]):
        states[r["pool"]].take(np.asarray(r["x"]), (r["id"], True, r["grp"], r["occ_hash"]))
    for pool, s in states.items():
        s.groups = sorted(groups[pool])
    candidates = rows.where(~F.col("is_seed")).select("pool", "occ_hash", "id", "grp", "bin", "x")
    schema = T.StructType([*candidates.schema.fields, T.StructField("gain", T.DoubleType()), T.StructField("front", T.BooleanType())])
    while wanted := {pool: s.group_on_turn() for pool, s in states.items() if s.group_on_turn() is not None}:
        taken: dict = {pool: {} for pool in wanted}
        for pool in wanted:
            for _, is_seed, grp, h in states[pool].chosen:
                if not is_seed:
                    taken[pool].setdefault(grp, []).append(h)
        each = max(64, held_bytes // (8 * p) // sum(len(states[pool].groups) for pool in wanted))
        # Rows that were taken may come back; they take none of the others' places.
        most = each + max((len(h) for of in taken.values() for h in of.values()), default=0)
        inverses = {pool: states[pool].inverse for pool in wanted if states[pool].inverse is not None}
        run = _Pass(inverses, wanted, {pool: taken[pool].get(grp, []) for pool, grp in wanted.items()}, most, ridge, tolerance).run
        best = candidates.where(F.col("pool").isin(list(wanted))).mapInArrow(run, schema)
        place = F.row_number().over(Window.partitionBy("pool", "grp", "front").orderBy(F.desc("gain"), "occ_hash"))
        found: dict = {}
        fronts: dict = {}
        for r in best.withColumn("place", place).where((F.col("place") <= most) | F.col("front")).collect():
            if r["front"]:
                fronts.setdefault(r["pool"], []).append(r.asDict())
            else:
                found.setdefault((r["pool"], r["grp"]), []).append(r)
        held: dict = {pool: {} for pool in wanted}
        next_of = {pool: _best(rows_of, tolerance)[0] for pool, rows_of in fronts.items()}
        for (pool, grp), own in found.items():
            bound = -np.inf if len(own) == sizes[pool, grp] else min(r["gain"] for r in own)
            gone = {*taken[pool].get(grp, ()), *([next_of[pool]["occ_hash"]] if pool in next_of and next_of[pool]["grp"] == grp else [])}
            new = [r for r in own if r["occ_hash"] not in gone]
            x, gains = np.array([r["x"] for r in new], dtype=float).reshape(len(new), p), np.array([r["gain"] for r in new], dtype=float)
            held[pool][grp] = _Held(x, gains, [tie_key(r["bin"], r["occ_hash"]) for r in new], [(r["id"], False, grp, r["occ_hash"]) for r in new], bound)
        for pool in wanted:
            s = states[pool]
            if pool in next_of:
                r = next_of[pool]
                s.take(np.asarray(r["x"]), (r["id"], False, r["grp"], r["occ_hash"]))
                s.turn = s.turn % len(s.groups) + 1
            s.advance(held[pool])
        if passes is not None:
            passes.append(len(found))
    rows.unpersist()
    out = [(pool, i, *row[:2]) for pool, s in states.items() for i, row in enumerate(s.chosen)]
    return spark.createDataFrame(out, "pool long, place long, id long, is_seed boolean")
