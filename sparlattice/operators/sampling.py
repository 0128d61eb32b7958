"""Wang-Landau chains: one chain a group, as many chains side by side as there are keys.

A chain is sequential by nature; its state is a JSON string that starts the
next block where the last one ended. Swap proposals are our own (two sites of
one sublattice with different species); no step-for-step agreement with any
other sampler is claimed.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import keys

GENESIS = "GENESIS"
FLATNESS = 0.8


def encode_u64(value):
    """Integers beyond a signed 64-bit column as tagged hex text, at any depth."""
    if isinstance(value, dict):
        return {k: encode_u64(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [encode_u64(v) for v in value]
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return {"__u64__": hex(value)}
    return value


def decode_u64(value):
    if isinstance(value, dict):
        return int(value["__u64__"], 16) if set(value) == {"__u64__"} else {k: decode_u64(v) for k, v in value.items()}
    return [decode_u64(v) for v in value] if isinstance(value, list) else value


@dataclass(frozen=True)
class SamplerSpec:
    """Settings of a chain; those that count must be positive."""

    bin_width: float
    steps: int
    check_period: int = 5_000
    update_period: int = 1
    seed: int = 0
    samples_per_bin: int = 0
    collect_cation_stats: bool = False
    production_mode: bool = False
    reject_cross_sublattice: bool = True
    divisor: float = 2.0

    def __post_init__(self):
        for name in ("bin_width", "steps", "check_period", "update_period"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.samples_per_bin < 0:
            raise ValueError("samples_per_bin must not be negative")


@dataclass(frozen=True)
class Lattice:
    """Sites with their sublattice, allowed species codes, and a pairwise energy:
    ``field`` by species and ``coupling`` between neighbours of equal species."""

    sublattice: tuple[int, ...]
    neighbours: tuple[tuple[int, ...], ...]
    fields: tuple[float, ...]
    coupling: float

    def __post_init__(self):
        object.__setattr__(self, "sublattice", tuple(self.sublattice))
        object.__setattr__(self, "neighbours", tuple(map(tuple, self.neighbours)))
        object.__setattr__(self, "fields", tuple(self.fields))

    @classmethod
    def ring(cls, n: int, fields: Sequence[float] = (0.0, 0.3), coupling: float = -0.5) -> Lattice:
        return cls(tuple(i % 2 for i in range(n)), tuple(((i - 1) % n, (i + 1) % n) for i in range(n)), tuple(fields), coupling)

    def features(self, occ: np.ndarray) -> np.ndarray:
        """(atoms by species..., bonds of equal species); the energy is their scalar product with the parameters."""
        bonds = sum(int(occ[i] == occ[j]) for i, own in enumerate(self.neighbours) for j in own) / 2
        return np.array([*np.bincount(occ, minlength=len(self.fields)), bonds], dtype=float)

    @property
    def parameters(self) -> np.ndarray:
        return np.array([*self.fields, self.coupling])

    def bond_change(self, occ: np.ndarray, swap: tuple[int, int]) -> float:
        """Change of the equal bonds when two sites trade species."""
        a, b = swap
        before = self._bonds(occ, a, b)
        occ[a], occ[b] = occ[b], occ[a]
        after = self._bonds(occ, a, b)
        occ[a], occ[b] = occ[b], occ[a]
        return after - before

    def _bonds(self, occ: np.ndarray, a: int, b: int) -> int:
        return sum(int(occ[a] == occ[j]) for j in self.neighbours[a]) + sum(int(occ[b] == occ[j]) for j in self.neighbours[b] if j != a)


@dataclass
class Chain:
    """The state of one Wang-Landau chain, with what its current block has gathered."""

    spec: SamplerSpec
    lattice: Lattice
    occ: np.ndarray
    rng: np.random.Generator
    shrink: Callable[[float], float] | None = None
    m: float = 1.0
    steps: int = 0
    entropy: dict[int, float] = field(default_factory=dict)
    histogram: dict[int, int] = field(default_factory=dict)
    occurrences: dict[int, int] = field(default_factory=dict)
    means: dict[int, np.ndarray] = field(default_factory=dict)
    updates: list[tuple[int, float]] = field(default_factory=list)
    samples: dict[int, dict[str, list[int]]] = field(default_factory=dict)
    cations: dict[tuple[int, int, int, int], int] = field(default_factory=dict)

    def __post_init__(self):
        self.features = self.lattice.features(self.occ)
        self.energy = float(self.features @ self.lattice.parameters)
        self.accepted_occ: np.ndarray | None = None
        if not self.steps:
            self.updates.append((0, self.m))

    def bin(self, energy: float) -> int:
        return math.floor(energy / self.spec.bin_width)

    def propose(self) -> tuple[int, int]:
        n = len(self.occ)
        return int(self.rng.integers(n)), int(self.rng.integers(n))

    def step(self) -> None:
        a, b = self.propose()
        spec, change = self.spec, 0.0
        crossing = spec.reject_cross_sublattice and self.lattice.sublattice[a] != self.lattice.sublattice[b]
        u = self.rng.random()
        if not crossing:
            if a != b and self.occ[a] != self.occ[b]:
                change = self.lattice.bond_change(self.occ, (a, b))
            new = self.energy + self.lattice.coupling * change
            x = self.entropy.get(self.bin(self.energy), 0.0) - self.entropy.get(self.bin(new), 0.0)
            if x >= 0 or (u > 0 and x > math.log(u)):
                self.occ[a], self.occ[b] = self.occ[b], self.occ[a]
                self.energy = new
                self.features = self.features.copy()
                self.features[-1] += change
                self.accepted_occ = self.occ.copy()
        self.after()

    def after(self) -> None:
        """Visits, means and samples; entropy and histogram at the update period; flatness at the check period.

        Bins count as visited once they have an entropy: those first reached
        in production, or off the cadence, are left out of the state.
        """
        spec, b = self.spec, self.bin(self.energy)
        n = self.occurrences.get(b, 0)
        self.occurrences[b] = n + 1
        self.means[b] = self.features if not n else (self.features + n * self.means[b]) / (n + 1)
        if spec.samples_per_bin and self.accepted_occ is not None:
            held = self.samples.setdefault(b, {})
            if len(held) < spec.samples_per_bin:
                held.setdefault(hashlib.sha1(self.accepted_occ.astype(np.int32).tobytes()).hexdigest(), self.accepted_occ.tolist())
        self.steps += 1
        if self.steps % spec.update_period == 0:
            if spec.collect_cation_stats and self.accepted_occ is not None:
                for s in sorted(set(self.lattice.sublattice)):
                    own = self.accepted_occ[[i for i, t in enumerate(self.lattice.sublattice) if t == s]]
                    for species in range(len(self.lattice.fields)):
                        key = (b, s, species, int((own == species).sum()))
                        self.cations[key] = self.cations.get(key, 0) + 1
            if not spec.production_mode:
                self.entropy[b] = self.entropy.get(b, 0.0) + self.m
                self.histogram[b] = self.histogram.get(b, 0) + 1
        if not spec.production_mode and self.steps % spec.check_period == 0:
            h = [self.histogram.get(k, 0) for k, s in self.entropy.items() if s > 0]
            if len(h) >= 2 and min(h) > FLATNESS * (sum(h) / len(h)):
                self.histogram.clear()
                self.m = self.shrink(self.m) if self.shrink else self.m / spec.divisor
                self.updates.append((self.steps, self.m))

    def run(self, steps: int) -> Chain:
        for _ in range(steps):
            self.step()
        return self

    def state(self) -> str:
        """Everything the next block needs, as canonical JSON."""
        bins = sorted(b for b, s in self.entropy.items() if s > 0)
        out = {
            "version": 1,
            "bin_indices": bins,
            "entropy": [self.entropy[b] for b in bins],
            "histogram": [self.histogram.get(b, 0) for b in bins],
            "occurrences": [self.occurrences.get(b, 0) for b in bins],
            "mean_features": [self.means[b].tolist() for b in bins],
            "mod_factor": self.m,
            "steps_counter": self.steps,
            "occupancy": self.occ.tolist(),
            "rng_state": encode_u64(self.rng.bit_generator.state),
            "bin_size": self.spec.bin_width,
        }
        return json.dumps(out, sort_keys=True, separators=(",", ":"))

    @classmethod
    def restored(cls, spec: SamplerSpec, lattice: Lattice, state: str) -> Chain:
        s = json.loads(state)
        if s["bin_size"] != spec.bin_width:
            raise ValueError(f"the state has bins of {s['bin_size']}, not {spec.bin_width}")
        rng = np.random.default_rng()
        rng.bit_generator.state = decode_u64(s["rng_state"])
        bins = s["bin_indices"]
        return cls(
            spec, lattice, np.array(s["occupancy"]), rng, m=s["mod_factor"], steps=s["steps_counter"],
            entropy=dict(zip(bins, s["entropy"], strict=True)), histogram={b: h for b, h in zip(bins, s["histogram"], strict=True) if h},
            occurrences=dict(zip(bins, s["occurrences"], strict=True)), means={b: np.array(f) for b, f in zip(bins, s["mean_features"], strict=True)},
        )


def initial_occupancy(counts: Sequence[Sequence[int]], lattice: Lattice, seed: int) -> np.ndarray:
    """A random occupancy with exactly ``counts[sublattice][species]`` atoms."""
    rng = np.random.default_rng(seed)
    occ = np.zeros(len(lattice.sublattice), dtype=int)
    for s, wanted in enumerate(counts):
        sites = [i for i, t in enumerate(lattice.sublattice) if t == s]
        if sum(wanted) != len(sites):
            raise ValueError(f"{sum(wanted)} atoms on {len(sites)} sites")
        occ[rng.permutation(sites)] = np.repeat(np.arange(len(wanted)), wanted)
    return occ


def block_key(wl_key: str, parent: str, state: str, occupancy: Sequence[int]) -> str:
    """The identity of a block by its chain, parent, state (JSON) and occupancy; ``columns.block_key`` gives the same in Spark."""
    return keys.digest({"wl_key": wl_key, "parent_wl_block_key": parent, "state": json.loads(state), "occupancy": [int(o) for o in occupancy]})


BLOCK_SCHEMA = "wl_key string, wl_block_key string, parent_wl_block_key string, step_end long, mod_factor double, bins long, visits long, state string, mod_updates string, samples string, cation_counts string, production_mode boolean"


def run_block(wl_key: str, spec: SamplerSpec, lattice: Lattice, counts: Sequence[Sequence[int]], parent: str | None, state: str | None) -> tuple:
    """One block of a chain, from its tip or from the start."""
    if state is None:
        chain = Chain(spec, lattice, initial_occupancy(counts, lattice, spec.seed), np.random.default_rng(spec.seed + 1))
    else:
        chain = Chain.restored(spec, lattice, state)
    chain.run(spec.steps)
    new = chain.state()
    samples = [[b, o] for b in sorted(chain.samples) for o in chain.samples[b].values()]
    cations = [[*k, n] for k, n in sorted(chain.cations.items())]
    parent = parent or GENESIS
    return (wl_key, block_key(wl_key, parent, new, chain.occ.tolist()), parent, chain.steps, chain.m, len(chain.entropy), sum(chain.occurrences.values()), new, json.dumps(chain.updates), json.dumps(samples), json.dumps(cations), spec.production_mode)


def run_blocks(chains: DataFrame, spec: SamplerSpec, lattice: Lattice, counts: Sequence[Sequence[int]] | dict) -> DataFrame:
    """The next block of every chain: (wl_key, seed, parent, state), parent and state null for a new one.

    ``counts``: atoms by sublattice and species, of all chains or by wl_key.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        own = SamplerSpec(**{**asdict(spec), "seed": int(r["seed"])})
        return pd.DataFrame([run_block(r["wl_key"], own, lattice, counts[r["wl_key"]] if isinstance(counts, dict) else counts, r["parent"], r["state"])], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return chains.groupBy("wl_key").applyInPandas(run, BLOCK_SCHEMA)


def extend(chains: DataFrame, spec: SamplerSpec, lattice: Lattice, counts: Sequence[Sequence[int]], repeats: int) -> DataFrame:
    """All blocks of ``repeats`` extensions, each starting at the tip of the last."""
    from pyspark.sql import functions as F

    from ..sources.catalogue import checkpointed

    if repeats <= 0:
        raise ValueError("repeats must be positive")
    tips, out = chains, None
    for _ in range(repeats):
        blocks = checkpointed(run_blocks(tips, spec, lattice, counts))
        out = blocks if out is None else out.unionByName(blocks)
        tips = blocks.join(chains.select("wl_key", "seed"), "wl_key").select("wl_key", "seed", F.col("wl_block_key").alias("parent"), "state")
    return out


def until_converged(chains: DataFrame, spec: SamplerSpec, lattice: Lattice, counts: Sequence[Sequence[int]], target: float = 1e-7, max_blocks: int = 100) -> DataFrame:
    """Tips of chains extended until every factor is at most ``target``; RuntimeError after ``max_blocks``."""
    from pyspark.sql import functions as F

    from ..sources.catalogue import checkpointed

    tips = chains
    for _ in range(max_blocks):
        blocks = checkpointed(run_blocks(tips, spec, lattice, counts))
        if blocks.where(F.col("mod_factor") > target).isEmpty():
            return blocks
        tips = blocks.join(chains.select("wl_key", "seed"), "wl_key").select("wl_key", "seed", F.col("wl_block_key").alias("parent"), "state")
    raise RuntimeError(f"not converged after {max_blocks} blocks")


def occupancy_counts(blocks: DataFrame) -> DataFrame:
    """(wl_key, bin, sublattice, element, n_sites, count) rows of blocks' cation statistics."""
    from pyspark.sql import functions as F

    rows = blocks.select("wl_key", F.explode(F.from_json("cation_counts", "array<array<bigint>>")).alias("r"))
    names = ("bin", "sublattice", "element", "n_sites", "count")
    return rows.select("wl_key", *(F.col("r")[i].alias(n) for i, n in enumerate(names)))


def sampled_occupancies(blocks: DataFrame) -> DataFrame:
    """(wl_key, wl_block_key, bin, occ, occ_hash, place): samples of blocks in the order of bin and hash."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions.columns import occ_hash

    pairs = F.from_json("samples", "array<string>")
    rows = blocks.select("wl_key", "wl_block_key", F.explode(pairs).alias("p"))
    rows = rows.select("wl_key", "wl_block_key", F.get_json_object("p", "$[0]").cast("long").alias("bin"), F.from_json(F.get_json_object("p", "$[1]"), "array<int>").alias("occ"))
    rows = rows.withColumn("occ_hash", occ_hash(F.col("occ")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("wl_block_key").orderBy("bin", "occ_hash")))


_STATE = "bin_indices array<bigint>, entropy array<double>, histogram array<bigint>, occurrences array<bigint>, bin_size double"


def state_bins(blocks: DataFrame) -> DataFrame:
    """(wl_key, wl_block_key, bin, energy, entropy, histogram, occurrences) of blocks'
    states; counts that a state's lists are too short for are 0."""
    from pyspark.sql import functions as F

    from .thermo import bin_level

    s = blocks.select("wl_key", "wl_block_key", F.from_json("state", _STATE).alias("s")).select("wl_key", "wl_block_key", "s.*")
    names = ("bin_indices", "entropy", "histogram", "occurrences")
    rows = s.select("wl_key", "wl_block_key", "bin_size", F.explode(F.arrays_zip(*names)).alias("r")).where("r.bin_indices IS NOT NULL")
    counts = (F.coalesce(F.col(f"r.{n}"), F.lit(0)).alias(n) for n in names[2:])
    return rows.select("wl_key", "wl_block_key", F.col("r.bin_indices").alias("bin"), bin_level(F.col("r.bin_indices"), F.col("bin_size")).alias("energy"), "r.entropy", *counts)


def production_tips(blocks: DataFrame) -> DataFrame:
    """The last block of each chain; one that isn't in production mode fails when it is read."""
    from pyspark.sql import functions as F

    from .store import tips

    sampled = F.assert_true(F.coalesce("production_mode", F.lit(False)), F.concat(F.lit("the last block isn't in production mode: "), F.col("wl_key")))
    return tips(blocks, "wl_key", "step_end").where(sampled.isNull())


def chain_report(blocks: DataFrame) -> DataFrame:
    """(wl_key, blocks, steps, updates, mod_factor, bins, visits): totals of each chain, the last three at its tip."""
    from pyspark.sql import functions as F

    updates = F.size(F.from_json("mod_updates", "array<array<double>>"))
    tip = F.max(F.struct("step_end", "mod_factor", "bins", "visits"))
    rows = blocks.groupBy("wl_key").agg(F.count("*").alias("blocks"), F.sum(F.greatest(updates, F.lit(0))).alias("updates"), tip.alias("t"))
    return rows.select("wl_key", "blocks", F.col("t.step_end").alias("steps"), "updates", "t.mod_factor", "t.bins", "t.visits")
