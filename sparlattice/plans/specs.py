"""Validated specs of the workflows, each with its content key."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import MISSING, asdict, dataclass, field, fields, is_dataclass
from typing import Any

from ..functions import keys, text
from ..operators import geometry, sampling

# The domains of the calculator settings.
CALCULATORS = ("MACE-MPA-0", "vasp-gga", "vasp-24")
RELAX_TYPES = ("static", "full")
#: What a refined model's key says of its making. Fixed values.
REFINED_ALGO = "refined-wl-dopt-v1"
DOPT_OPTIONS = {"ridge": 1e-10, "tie_breaker": "bin_then_hash"}
SPIN_TYPES = ("nonmagnetic", "ferromagnetic", "afm", "antialigned", "zero_init")


@dataclass(frozen=True)
class Mixture:
    composition_map: Mapping[str, Mapping[str, int]]
    K: int
    seed: int = 0

    def __post_init__(self):
        object.__setattr__(self, "composition_map", keys.comp_map(self.composition_map))
        if self.K <= 0:
            raise ValueError("K must be positive")

    @classmethod
    def parsed(cls, item: str, seed: int = 0) -> Mixture:
        """``seed``: where the item gives none."""
        return cls(**text.mixture(item, seed))

    def sort_key(self) -> tuple:
        return keys.comp_map_sig(self.composition_map), self.seed, self.K


@dataclass(frozen=True)
class CalcSpec:
    calculator: str
    relax_type: str
    spin_type: str
    max_force_eV_per_A: float
    frozen_sublattices: str = ""

    def __post_init__(self):
        if self.relax_type not in RELAX_TYPES or self.spin_type not in SPIN_TYPES or self.max_force_eV_per_A <= 0:
            raise ValueError(f"bad calculator settings {self}")
        text.frozen(self.frozen_sublattices)

    @property
    def name(self) -> str:
        return self.calculator.partition(";")[0].strip()

    @property
    def model(self) -> str | None:
        return self.calculator.partition(";")[2].strip() or None


@dataclass(frozen=True)
class PrototypeSpec:
    prototype: str
    params: Mapping[str, float]

    def __post_init__(self):
        object.__setattr__(self, "params", text.parameters(text.prototype(self.prototype)[0], dict(self.params)))

    @property
    def name(self) -> str:
        return text.prototype(self.prototype)[0]

    def active_sites(self, supercell: tuple[int, int, int]) -> dict[str, int]:
        n = supercell[0] * supercell[1] * supercell[2]
        return {s: k * n for s, k in geometry.ACTIVE_SITES[self.name].items()}


@dataclass(frozen=True)
class EnsureModel:
    """A model from random configurations of given compositions."""

    prototype: PrototypeSpec
    supercell: tuple[int, int, int]
    mixtures: tuple[Mixture, ...]
    calc: CalcSpec
    cutoffs: Mapping[int, float]
    regularization: Mapping[str, Any] = field(default_factory=lambda: {"type": "ols"})
    weighting: Mapping[str, Any] | None = None
    algo: str = "randgen-v1"
    cv_seed: int = 0
    basis: str = "sinusoid"

    def __post_init__(self):
        object.__setattr__(self, "mixtures", tuple(sorted(self.mixtures, key=Mixture.sort_key)))
        sites = self.prototype.active_sites(self.supercell)
        for m in self.mixtures:
            for s, c in m.composition_map.items():
                if s not in sites:
                    raise ValueError(f"{self.prototype.name} has no active sublattice {s}")
                geometry.checked_counts({k: n for k, n in c.items() if n}, sites[s])

    @property
    def basis_spec(self) -> dict:
        return {"basis": self.basis, "cutoffs": {str(k): v for k, v in self.cutoffs.items()}}

    @property
    def key(self) -> str:
        source = {"type": "composition", "mixtures": [asdict(m) for m in self.mixtures]}
        return keys.ce_key(asdict(self.prototype), self.supercell, [source], self.algo, asdict(self.calc), self.basis_spec, regularization=self.regularization, weighting=self.weighting)


@dataclass(frozen=True)
class EnsureRefined:
    """A model refined on a D-optimal choice among sampled configurations.

    The base model is trained on energies of its own calculator, the refined
    one on those of ``final``, or of the base's where that is None. The key holds
    both: the base's by the key of the base model.
    """

    base: EnsureModel
    endpoints: tuple[Mapping[str, Mapping[str, int]], ...]
    wl_policy: Mapping[str, Any]
    steps: int
    samples_per_bin: int
    budget: int
    min_partial_frac: float = 1.0
    final: CalcSpec | None = None
    reject_cross: bool = True

    @property
    def final_calc(self) -> CalcSpec:
        return self.final or self.base.calc

    @property
    def policy(self) -> dict:
        """All settings of the chains that their keys and the model's hold."""
        p = self.wl_policy
        return {"bin_width": p["bin_width"], "step_type": p.get("step_type", "swap"), "check_period": int(p.get("check_period", 5_000)), "update_period": int(p.get("update_period", 1)), "seed": int(p.get("seed", 0))}

    @property
    def sampled_mixtures(self) -> tuple[Mixture, ...]:
        """The base's mixtures that are no endpoints; endpoints aren't sampled."""
        ends = {keys.comp_map_sig(m) for m in self.endpoints}
        return tuple(m for m in self.base.mixtures if keys.comp_map_sig(m.composition_map) not in ends)

    def wl_key(self, composition: Mapping[str, Mapping[str, int]]) -> str:
        """The key of the chain of a composition."""
        return keys.wl_key(self.base.key, initial=composition, reject_cross=self.reject_cross, **self.policy)

    def chain_species(self, composition: Mapping[str, Mapping[str, int]]) -> tuple[dict[str, list[str]], list[list[int]]]:
        """(species of each sublattice's sites by number, atoms by sublattice and species).

        Where atoms may cross between sublattices all of them number all species alike.
        """
        return chain_species(composition, self.reject_cross)

    def key(self, partial: bool = False) -> str:
        if "seed" not in self.wl_policy:
            raise ValueError("the chains' policy needs a seed")
        source = {"type": "dopt_sampling_intent", "base_ce_key": self.base.key, "endpoints": list(self.endpoints), "wl_policy": self.policy, "ensure": {"steps_to_run": self.steps, "samples_per_bin": self.samples_per_bin}, "dopt": {"budget": self.budget} | DOPT_OPTIONS}
        return keys.ce_key(asdict(self.base.prototype), self.base.supercell, [source], REFINED_ALGO, asdict(self.final_calc), self.base.basis_spec, self.min_partial_frac if partial else 1.0, self.base.regularization, self.base.weighting)


def chain_species(composition: Mapping[str, Mapping[str, int]], reject_cross: bool) -> tuple[dict[str, list[str]], list[list[int]]]:
    every = sorted({e for c in composition.values() for e, n in c.items() if n})
    named = {s: sorted(e for e, n in c.items() if n) if reject_cross else every for s, c in sorted(composition.items())}
    return named, [[composition[s].get(e, 0) for e in own] for s, own in named.items()]


def swap_mixtures(a: str, b: str, es: int, fm: int, k_count: int, seed: int = 0) -> list[Mixture]:
    """Mixtures in which k atoms trade places between two sublattices, k from 1 to es - 1."""
    return [Mixture({"Es": {a: es - k, b: k}, "Fm": {a: k, b: fm - k}}, k_count, seed) for k in range(1, es)]


# ---- specs as documents

#: What may stand in a document, by the name in its field ``kind``.
DOCUMENTS = {c.__name__: c for c in (Mixture, CalcSpec, PrototypeSpec, EnsureModel, EnsureRefined, sampling.SamplerSpec)}


def document(spec: Any) -> Any:
    """A spec as JSON has it: a mapping with the name of its kind, specs inside it likewise."""
    if is_dataclass(spec):
        return {"kind": type(spec).__name__} | {f.name: document(getattr(spec, f.name)) for f in fields(spec)}
    if isinstance(spec, Mapping):
        return {str(k): document(v) for k, v in spec.items()}
    return [document(v) for v in spec] if isinstance(spec, list | tuple) else spec


def from_document(value: Any) -> Any:
    """The spec that ``document`` wrote, checked as any other; fields that are absent have their
    defaults. ValueError for an unknown kind or field, or one that lacks."""
    if isinstance(value, list | tuple):
        return tuple(from_document(v) for v in value)
    if not isinstance(value, Mapping):
        return value
    inner = {k: from_document(v) for k, v in value.items() if k != "kind"}
    if "kind" not in value:
        return inner
    kind = DOCUMENTS.get(value["kind"])
    if kind is None:
        raise ValueError(f"unknown kind {value['kind']!r}")
    known = {f.name for f in fields(kind)}
    needed = {f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING}
    if unknown := set(inner) - known:
        raise ValueError(f"{value['kind']} has no {', '.join(sorted(unknown))}")
    if absent := needed - set(inner):
        raise ValueError(f"{value['kind']} lacks {', '.join(sorted(absent))}")
    if "cutoffs" in inner:
        inner["cutoffs"] = {int(k): float(v) for k, v in inner["cutoffs"].items()}
    return kind(**inner)
