"""Command lines over a catalogue: make a model, a refined model, extend a chain, or print keys alone.

    python -m sparlattice.plans.cli ensure-model --store /shared/store --energies e.parquet --features my.module:features ...
    python -m sparlattice.plans.cli extend-wl --store /shared/store --ce-key K --composition-map Es:{Mg:2} --repeats 3 ...

Without ``--store`` the keys are printed and nothing runs.
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
from collections.abc import Callable, Sequence

from ..functions import keys, text
from ..operators.sampling import SamplerSpec
from .specs import CalcSpec, EnsureModel, EnsureRefined, Mixture, PrototypeSpec, chain_species


def _running(p: argparse.ArgumentParser, energies: bool = True) -> None:
    p.add_argument("--store", help="the catalogue's folder; keys alone are printed without it")
    p.add_argument("--lattice", help="JSON of the chains' lattice: sublattice, neighbours, fields, coupling")
    if energies:
        p.add_argument("--energies", help="Parquet of (occ_key, energy), or of tasks that the calculator settings choose from")
        p.add_argument("--features", metavar="MODULE:FUNCTION", help="turns configurations into (set_id, idx, x)")


#: Settings of calculators and samplers where the command line gives none.
DEFAULTS = {"relax_type": "full", "spin_type": "nonmagnetic", "max_force_eV_per_A": 0.02, "check_period": 5_000}
KINDS = {"int": int, "float": float, "str": str}
CHAIN = ("bin_width", "check_period", "update_period")


def _settings(p: argparse.ArgumentParser, spec: type, names: Sequence[str] | None = None, prefix: str = "", optional: bool = False) -> None:
    """An option for each field of a spec, or for those named; a switch for a truth value.

    With ``optional`` none is asked for, and what isn't given is None.
    """
    for f in dataclasses.fields(spec):
        if names is not None and f.name not in names:
            continue
        option = f"--{prefix}{f.name.replace('_', '-')}"
        if f.type == "bool":
            p.add_argument(option, action="store_true")
        elif f.type in KINDS:
            default = DEFAULTS.get(f.name, None if f.default is dataclasses.MISSING else f.default)
            p.add_argument(option, type=KINDS[f.type], default=None if optional else default, required=default is None and not optional)


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--prototype", required=True)
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--supercell", required=True, type=int, nargs=3)
    p.add_argument("--mix", action="append", default=[], required=True)
    p.add_argument("--seed", type=int, default=0, help="the seed of mixtures that give none")
    p.add_argument("--cutoffs", default="1:100,2:10,3:8,4:6")
    _settings(p, EnsureModel, ["basis"])
    _settings(p, CalcSpec)
    p.add_argument("--reg-type", default="ols", choices=("ols", "ridge", "lasso", "elasticnet"))
    p.add_argument("--alpha", type=float, default=1e-6)
    p.add_argument("--l1-ratio", type=float, default=0.5)
    p.add_argument("--balance-by-comp", action="store_true", help="weigh rows by how many their composition has")
    p.add_argument("--weight-alpha", type=float, default=1.0)


def _chain(p: argparse.ArgumentParser) -> None:
    p.add_argument("--ce-key", required=True)
    p.add_argument("--composition-map", required=True)
    _settings(p, SamplerSpec, [*CHAIN, "seed"])
    p.add_argument("--step-type", default="swap")
    p.add_argument("--reject-cross-sublattice-swaps", action="store_true")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparlattice")
    sub = out.add_subparsers(dest="command", required=True)
    model = sub.add_parser("ensure-model")
    refined = sub.add_parser("ensure-refined")
    for p in (model, refined):
        _common(p)
        _running(p)
    refined.add_argument("--endpoint", action="append", default=[], help="a bare composition map")
    _settings(refined, SamplerSpec, [*CHAIN, "steps", "samples_per_bin"])
    refined.add_argument("--wl-seed", type=int, default=0)
    refined.add_argument("--step-type", default="swap")
    refined.add_argument("--reject-cross-sublattice-swaps", action="store_true")
    _settings(refined, EnsureRefined, ["budget", "min_partial_frac"])
    _settings(refined, CalcSpec, prefix="final-", optional=True)
    refined.add_argument("--final-energies", help="as --energies, of the final calculator")
    extend = sub.add_parser("extend-wl")
    _chain(extend)
    _running(extend, energies=False)
    _settings(extend, SamplerSpec, ["steps", "samples_per_bin", "collect_cation_stats", "production_mode"])
    extend.add_argument("--repeats", type=int, default=1)
    _chain(sub.add_parser("chain-key"))
    return out


def model_spec(a: argparse.Namespace, extra: Sequence[Mixture] = ()) -> EnsureModel:
    params = {k: float(v) for k, v in (p.split("=", 1) for p in a.param)}
    calc = CalcSpec(a.calculator, a.relax_type, a.spin_type, a.max_force_eV_per_A, a.frozen_sublattices)
    weighting = {"scheme": "balance_by_comp", "alpha": a.weight_alpha} if a.balance_by_comp else None
    mixtures = (*(Mixture.parsed(m, a.seed) for m in a.mix), *extra)
    return EnsureModel(PrototypeSpec(a.prototype, params), tuple(a.supercell), mixtures, calc, text.cutoffs(a.cutoffs), {"type": a.reg_type, "alpha": a.alpha, "l1_ratio": a.l1_ratio}, weighting, basis=a.basis)


def refined_spec(a: argparse.Namespace) -> EnsureRefined:
    """The endpoints are mixtures of the base model too, one configuration each."""
    ends = tuple(text.composition_map(e) for e in a.endpoint)
    base = model_spec(a, [Mixture(e, 1, 0) for e in ends])
    policy = {"seed": a.wl_seed, "step_type": a.step_type} | {name: getattr(a, name) for name in CHAIN}
    given = {f.name: getattr(a, f"final_{f.name}") for f in dataclasses.fields(CalcSpec)}
    final = dataclasses.replace(base.calc, **{k: v for k, v in given.items() if v is not None})
    return EnsureRefined(base, ends, policy, a.steps, a.samples_per_bin, a.budget, a.min_partial_frac, None if final == base.calc else final, a.reject_cross_sublattice_swaps)


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _inputs(spark, a: argparse.Namespace):
    return spark.read.parquet(a.energies), _named(a.features)


def run(spark, a: argparse.Namespace) -> dict:
    """What the command makes in the catalogue, as a summary."""
    from ..operators import sampling
    from ..sources.catalogue import Catalogue
    from . import workflows

    store = Catalogue(a.store)
    lattice = sampling.Lattice(**json.loads(a.lattice)) if a.lattice else None
    if a.command == "extend-wl":
        composition = text.composition_map(a.composition_map)
        _, counts = chain_species(composition, a.reject_cross_sublattice_swaps)
        sampler = sampling.SamplerSpec(a.bin_width, a.steps, a.check_period, a.update_period, a.seed, a.samples_per_bin, a.collect_cation_stats, a.production_mode, a.reject_cross_sublattice_swaps)
        chains = spark.createDataFrame([(keyed(a)["wl_key"], a.seed)], "wl_key string, seed long")
        last = workflows.extend_chains(spark, store, chains, sampler, lattice, counts, a.repeats).first()
        return {"wl_block_key": last["wl_block_key"], "step_end": last["step_end"], "mod_factor": last["mod_factor"]}
    if a.command == "ensure-model":
        spec = model_spec(a)
        model = workflows.ensure_model(spark, store, spec, *_inputs(spark, a))
    else:
        final = spark.read.parquet(a.final_energies) if a.final_energies else None
        model = workflows.ensure_refined(spark, store, refined_spec(a), *_inputs(spark, a), lattice, final)
    return {"stored": model["ce_key"], "stats": json.loads(model["stats"])}


def keyed(a: argparse.Namespace) -> dict:
    if a.command in ("chain-key", "extend-wl"):
        return {"wl_key": keys.wl_key(a.ce_key, a.bin_width, a.step_type, text.composition_map(a.composition_map), a.reject_cross_sublattice_swaps, a.check_period, a.update_period, a.seed)}
    if a.command == "ensure-model":
        return {"ce_key": model_spec(a).key}
    spec = refined_spec(a)
    return {"base_ce_key": spec.base.key, "ce_key": spec.key(), "partial_ce_key": spec.key(partial=True), "sampled": len(spec.sampled_mixtures)}


def main(argv: Sequence[str] | None = None, spark=None) -> dict:
    a = parser().parse_args(argv)
    out = keyed(a)
    if getattr(a, "store", None):
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("sparlattice").getOrCreate()
        out |= run(spark, a)
    print(json.dumps(out, sort_keys=True))
    return out


if __name__ == "__main__":
    main()
