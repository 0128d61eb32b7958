"""End-to-end plans: from mixtures to a stored model, and a refined one.

Energies are an input table; whatever computes them is outside. Stages are
DataFrames over a catalogue; what is stored under its key is not made again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import design, geometry, joins, sampling, training
from ..operators import store as operators
from ..sources.catalogue import Catalogue, checkpointed
from .specs import EnsureModel, EnsureRefined, Mixture

MODEL_SCHEMA = "kind string, ce_key string, spec string, dataset_key string, coefficients array<double>, stats string, success boolean"


def requests(spark: SparkSession, spec: EnsureModel) -> DataFrame:
    """(set_id, idx, composition): one row for each configuration of each mixture.

    The set is named by its composition alone, so equal compositions give equal
    configurations whatever their seeds.
    """
    rows = []
    for m in spec.mixtures:
        parts = [(s, e, n) for s, c in m.composition_map.items() for e, n in c.items() if n]
        rows.append((keys.comp_map_sig(m.composition_map), m.K, parts))
    df = spark.createDataFrame(rows, "set_id string, k int, composition array<struct<sublattice:string,element:string,n:bigint>>")
    return df.select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("idx"), "composition")


def template_sites(spec: EnsureModel) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    for sublattice, n in spec.prototype.active_sites(spec.supercell).items():
        out += [(len(out) + i, sublattice) for i in range(n)]
    return out


def configurations(spark: SparkSession, spec: EnsureModel) -> DataFrame:
    """(set_id, idx, occ_key, occupation): configurations keyed by their content; duplicates stay."""
    placed = geometry.snapshots(requests(spark, spec), template_sites(spec))
    rows = placed.groupBy("set_id", "idx").agg(F.array_sort(F.collect_list(F.struct("site", "element"))).alias("occupation"))
    blob = F.to_json("occupation")
    return rows.select("set_id", "idx", F.sha2(blob, 256).alias("occ_key"), "occupation")


def to_compute(configs: DataFrame, energies: DataFrame) -> DataFrame:
    return joins.missing(configs, energies, ["occ_key"])


def accepted(energies: DataFrame, calc, wanted: DataFrame | None = None) -> DataFrame:
    """(occ_key, energy) under a calculator's settings.

    ``energies``: (occ_key, energy) as they are, or tasks with forces, of which each structure's converged
    one of least force counts. With ``wanted`` (occ_key) the tasks of these structures
    alone are looked at, so that ties among others don't matter.
    """
    if wanted is not None:
        energies = energies.join(wanted.select("occ_key").distinct(), "occ_key", "left_semi")
    return operators.energies_of(energies, calc) if "max_force" in energies.columns else energies.select("occ_key", "energy")


def lookup_model(spark: SparkSession, store: Catalogue, key: str):
    rows = store.read(spark, "ce_models", MODEL_SCHEMA).where(F.col("ce_key") == key).limit(2).collect()
    if len(rows) > 1:
        raise LookupError(f"two models with key {key}")
    return rows[0] if rows else None


def _predicted(x: str, b) -> Column:
    weights = F.array(*(F.lit(float(c)) for c in b))
    return F.aggregate(F.zip_with(x, weights, lambda a, c: a.cast("double") * c), F.lit(0.0), lambda s, v: s + v)


def _errors(rows: DataFrame, predicted: str, per_prim: float) -> tuple[dict, dict]:
    """(statistics of all rows, statistics by composition), per site."""
    scale = F.lit(float(per_prim))
    of_all = training.error_stats(rows, F.col("y"), F.col(predicted), scale=scale).first().asDict()
    by = {r["set_id"]: {k: r[k] for k in ("n", "mae", "rmse", "max_abs")} for r in training.error_stats(rows, F.col("y"), F.col(predicted), ["set_id"], scale).collect()}
    return of_all, by


def report(rows: DataFrame, b, per_prim: float, seed: int, how: dict) -> dict:
    """In-sample and five-fold statistics, also by composition, and design metrics of (set_id, idx, x, y, weight).

    Fewer than two rows, or rows that all fall in one fold, have the in-sample
    statistics for both; so has a row whose out-of-fold prediction is no number.
    """
    rows = rows.withColumn("__in", _predicted("x", b))
    in_sample, in_by = _errors(rows, "__in", per_prim)
    out, out_by = in_sample, in_by
    keyed = rows.withColumn("__key", F.concat_ws(":", "set_id", "idx"))
    folded = training.folds(keyed, "__key", 5, seed)
    if folded.select("fold").distinct().count() > 1:
        folded = training.cross_validated(folded, "x", "y", weight="weight", **how)
        folded = folded.withColumn("__out", F.when(F.isnan("predicted") | F.col("predicted").isNull(), F.col("__in")).otherwise(F.col("predicted")))
        out, out_by = _errors(folded, "__out", per_prim)
    return {"in_sample": in_sample, "in_sample_by_composition": in_by, "five_fold_cv": out, "five_fold_cv_by_composition": out_by, "design_metrics": asdict(design.design_metrics(rows, "x", "weight"))}


def dataset_identity(refs: DataFrame) -> str:
    """Order-free identity of a set of (set_id, occ_key): sums of parts of the rows'
    hashes, so that no task and no driver holds the rows."""
    digest = F.sha2(F.to_json(F.struct("set_id", "occ_key")), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = refs.select("set_id", "occ_key").distinct().agg(F.count("*"), *(F.sum(p) for p in parts)).first()
    return keys.digest([str(v) for v in sums])


def train_and_store(spark: SparkSession, store: Catalogue, key: str, spec: EnsureModel, described: dict, features: DataFrame, refs: DataFrame):
    """Fit, report and store a model under ``key``.

    ``features``: (set_id, idx, x); ``refs``: (set_id, idx, occ_key, energy).
    """
    n_prims = spec.supercell[0] * spec.supercell[1] * spec.supercell[2]
    rows = features.join(refs.select("set_id", "idx", "occ_key", (F.col("energy") / n_prims).alias("y")), ["set_id", "idx"])
    rows = checkpointed(rows)  # features are made once
    if training.balance_applies(spec.weighting):
        rows = rows.join(training.balance_weights(rows, ["set_id"], float((spec.weighting or {}).get("alpha", 1.0))).drop("n"), "set_id")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    how = {k: v for k, v in spec.regularization.items() if k in ("alpha", "l1_ratio")} | {"kind": spec.regularization.get("type", "ols")}
    b = training.fit(rows, "x", "y", "weight", **how)
    per_prim = max(1, sum(spec.prototype.active_sites(spec.supercell).values()) // n_prims)
    stats = report(rows, b, per_prim, spec.cv_seed, how)
    text = json.dumps(keys.canonical(described), sort_keys=True)
    model = spark.createDataFrame([("CEModelDoc", key, text, dataset_identity(rows), [float(c) for c in b], json.dumps(stats), True)], MODEL_SCHEMA)
    store.append_new(model, "ce_models", ["ce_key"], MODEL_SCHEMA)
    return lookup_model(spark, store, key)


def ensure_model(spark: SparkSession, store: Catalogue, spec: EnsureModel, energies: DataFrame, featurise: Callable[[DataFrame], DataFrame]):
    """The stored model of ``spec``, trained first if there is none.

    ``energies``: (occ_key, energy) of converged configurations, or tasks that
    the calculator's settings choose from; KeyError if any is missing. ``featurise`` turns (set_id, idx, occ_key, occupation) into
    (set_id, idx, x).
    """
    if (found := lookup_model(spark, store, spec.key)) is not None:
        return found
    configs = configurations(spark, spec)
    refs = joins.complete(configs, accepted(energies, spec.calc, configs), ["occ_key"])
    return train_and_store(spark, store, spec.key, spec, asdict(spec), featurise(configs), refs)


def mixtures_of(model) -> tuple[Mixture, ...]:
    """The mixtures that a stored model was trained on; ValueError if its spec has none."""
    found = json.loads(model["spec"]).get("mixtures") or []
    if not found:
        raise ValueError("the model's spec has no mixtures")
    return tuple(Mixture(m["composition_map"], int(m["K"]), int(m["seed"])) for m in found)


def stored_statistics(models: DataFrame) -> DataFrame:
    """(model, part, scope, grp, n, mae, rmse, max_abs) of the documents of stored models."""
    figures = "struct<n:bigint,mae:double,rmse:double,max_abs:double>"
    names = {"in_sample": "in_sample", "cv": "five_fold_cv"}
    fields = [f"{n}:{figures},{n}_by_composition:map<string,{figures}>" for n in names.values()]
    rows = models.select(F.col("ce_key").alias("model"), F.from_json("stats", f"struct<{','.join(fields)}>").alias("s"))
    out = None
    for part, name in names.items():
        whole = F.array(F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("grp"), F.col(f"s.{name}").alias("f")))
        by = F.transform(F.map_entries(F.col(f"s.{name}_by_composition")), lambda e: F.struct(F.lit("group").alias("scope"), e["key"].alias("grp"), e["value"].alias("f")))
        lines = rows.select("model", F.lit(part).alias("part"), F.inline(F.concat(whole, by))).select("model", "part", "scope", "grp", "f.*")
        out = lines if out is None else out.unionByName(lines)
    return out


def verified_models(models: DataFrame, rows: DataFrame, without: DataFrame | None = None, per_prim: float = 1.0) -> DataFrame:
    """The verdicts of ``training.verification`` on stored models, all in one pass.

    ``models``: documents of a catalogue's ce_models; ``rows``: (model, grp, fold, x, y),
    the rows that each was trained on; ``without``: (model, fold, coefficients) of the fits that left a
    fold out, if cross-validated figures are to be checked too.
    """
    own = models.select(F.col("ce_key").alias("model"), F.lit(None).cast("int").alias("fold"), "coefficients")
    stored = stored_statistics(models)
    if without is None:
        return training.verification(stored.where("part = 'in_sample'"), rows, own, per_prim)
    return training.verification(stored, rows, own.unionByName(without), per_prim)


def verified(model, rows: DataFrame, per_prim: float = 1.0, atol: float = training.ATOL, rtol: float = training.RTOL) -> bool:
    """Whether a stored model's in-sample statistics come out again from (x, y) rows."""
    now = training.error_stats(rows, F.col("y"), _predicted("x", model["coefficients"]), scale=F.lit(float(per_prim))).first()
    then = json.loads(model["stats"])["in_sample"]
    return now["n"] == then["n"] and all(abs(now[k] - then[k]) <= max(atol, rtol * abs(then[k])) for k in training.FIGURES)


ORBITS = "model string, orbit_id int, cluster_id int, site int"
COEFFICIENTS = "model string, orbit_id int, coefficient double"


def store_ensemble(store: Catalogue, orbits: DataFrame, coefficients: DataFrame) -> None:
    """Keep a model's clusters and coefficients beside its document; rows of stored models stay as they are."""
    store.append_new(orbits, "ce_orbits", ["model", "orbit_id", "cluster_id", "site"], ORBITS)
    store.append_new(coefficients, "ce_coefficients", ["model", "orbit_id"], COEFFICIENTS)


def stored_ensemble(spark: SparkSession, store: Catalogue, models: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(orbits, coefficients) of the stored models, or of those named; LookupError if one isn't stored."""
    orbits, coefficients = store.read(spark, "ce_orbits", ORBITS), store.read(spark, "ce_coefficients", COEFFICIENTS)
    if models is not None:
        orbits, coefficients = (t.where(F.col("model").isin(list(models))) for t in (orbits, coefficients))
        have = {r["model"] for r in coefficients.select("model").distinct().collect()}
        if absent := sorted(set(models) - have):
            raise LookupError(f"not stored: {', '.join(absent)}")
    return orbits, coefficients


def predict_structures(spark: SparkSession, store: Catalogue, structures: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """(model, structure_id, predicted) of (structure_id, site, value) under stored models."""
    return geometry.predicted(structures, *stored_ensemble(spark, store, models))


# ---- chains and the refined model


def chain_table(spark: SparkSession, spec: EnsureRefined) -> tuple[DataFrame, dict[str, list[list[int]]], dict[str, list[list[str]]]]:
    """The chains of the mixtures that are sampled: (wl_key, set_id, seed), the counts
    of each chain by sublattice and species, and the species of each of its sites."""
    sites = template_sites(spec.base)
    rows, counts, species = [], {}, {}
    for m in spec.sampled_mixtures:
        key = spec.wl_key(m.composition_map)
        named, counts[key] = spec.chain_species(m.composition_map)
        species[key] = [named.get(s, []) for _, s in sites]
        rows.append((key, keys.comp_map_sig(m.composition_map), int(spec.wl_policy.get("seed", 0))))
    return spark.createDataFrame(rows, "wl_key string, set_id string, seed long"), counts, species


def extend_chains(spark: SparkSession, store: Catalogue, chains: DataFrame, sampler, lattice, counts: dict, repeats: int = 1) -> DataFrame:
    """Append ``repeats`` blocks to each chain (wl_key, seed), each from its tip in the catalogue; the new blocks."""
    for _ in range(repeats):
        tips = operators.tips(store.read(spark, "wl_blocks", sampling.BLOCK_SCHEMA), "wl_key", "step_end")
        start = chains.select("wl_key", "seed").join(tips.select("wl_key", F.col("wl_block_key").alias("parent"), "state"), "wl_key", "left")
        blocks = checkpointed(sampling.run_blocks(start, sampler, lattice, counts))
        store.append_new(blocks, "wl_blocks", ["wl_block_key"], sampling.BLOCK_SCHEMA)
    return blocks


def ensure_blocks(spark: SparkSession, store: Catalogue, spec: EnsureRefined, lattice) -> tuple[DataFrame, dict]:
    """Of each sampled chain the first block of at least the wanted steps, run if there is none."""
    chains, counts, species = chain_table(spark, spec)
    sampler = sampling.SamplerSpec(bin_width=spec.wl_policy["bin_width"], steps=spec.steps, check_period=spec.policy["check_period"], update_period=spec.policy["update_period"], samples_per_bin=spec.samples_per_bin, reject_cross_sublattice=spec.reject_cross)

    def matching() -> DataFrame:
        blocks = store.read(spark, "wl_blocks", sampling.BLOCK_SCHEMA).join(chains.select("wl_key"), "wl_key", "left_semi")
        return operators.first_matching(blocks, "wl_key", "step_end", F.col("step_end") >= spec.steps)

    lacking = checkpointed(chains.join(matching(), "wl_key", "left_anti"))
    if not lacking.isEmpty():
        extend_chains(spark, store, lacking, sampler, lattice, counts)
    return checkpointed(matching().join(chains.select("wl_key", "set_id"), "wl_key")), species


def candidates(spark: SparkSession, blocks: DataFrame, species: dict, spec: EnsureRefined) -> tuple[DataFrame, DataFrame]:
    """(endpoints, samples): (pool, id, grp, bin, occ_hash, occ_key, occupation), one pool in all."""
    named = spark.createDataFrame([(k, v) for k, v in species.items()], "wl_key string, species array<array<string>>")
    rows = sampling.sampled_occupancies(blocks).join(named.join(blocks.select("wl_key", "set_id"), "wl_key"), "wl_key")
    place = F.sequence(F.lit(0), F.size("occ") - 1)
    occupation = F.transform(place, lambda i: F.struct(i.cast("long").alias("site"), F.get(F.get("species", i), F.get("occ", i)).alias("element")))
    rows = rows.select(F.lit(0).cast("long").alias("pool"), F.pmod(F.xxhash64("set_id", "occ_hash"), F.lit(1 << 62)).alias("id"), F.col("set_id").alias("grp"), "bin", "occ_hash", occupation.alias("occupation"))
    samples = rows.select("*", F.sha2(F.to_json("occupation"), 256).alias("occ_key"))
    ends = replace(spec.base, mixtures=tuple(Mixture(e, 1, 0) for e in spec.endpoints))
    first = configurations(spark, ends)
    endpoints = first.select(F.lit(0).cast("long").alias("pool"), (-1 - F.pmod(F.xxhash64("occ_key"), F.lit(1 << 62))).alias("id"), F.col("set_id").alias("grp"), F.lit(None).cast("long").alias("bin"), F.col("occ_key").alias("occ_hash"), "occupation", "occ_key")
    return endpoints, samples


def ensure_refined(spark: SparkSession, store: Catalogue, spec: EnsureRefined, energies: DataFrame, featurise: Callable[[DataFrame], DataFrame], lattice, final_energies: DataFrame | None = None):
    """The stored refined model of ``spec``, made first if there is none.

    The base model, a block of each mixture's chain that is no endpoint (found
    in the catalogue or run), the D-optimal choice among endpoints and samples,
    energies of the chosen, and the model trained on them. KeyError if less than
    ``min_partial_frac`` of the chosen have an energy; with some missing the
    model is stored under the partial key. ``lattice``: the chains' energy. Energies
    of the final calculator are matched on the chosen configurations alone: from ``final_energies``,
    or from ``energies`` if these are tasks or both calculators are one; ValueError if they can't be told apart.
    """
    if final_energies is None:
        if spec.final_calc != spec.base.calc and "max_force" not in energies.columns:
            raise ValueError("energies of the final calculator are wanted")
        final_energies = energies
    if (found := resolve_refined(spark, store, spec)) is not None:
        return found
    ensure_model(spark, store, spec.base, energies, featurise)
    blocks, species = ensure_blocks(spark, store, spec, lattice)
    endpoints, samples = candidates(spark, blocks, species, spec)
    both = checkpointed(endpoints.unionByName(samples))
    configs = both.select(F.col("grp").alias("set_id"), F.col("id").alias("idx"), "occ_key", "occupation")
    features = checkpointed(featurise(configs))
    x = features.select(F.col("set_id").alias("grp"), F.col("idx").alias("id"), "x")
    chosen = select_refined(endpoints.drop("occ_key", "occupation"), samples.drop("occ_key", "occupation"), lambda d: d.join(x, ["grp", "id"]), spec.budget)
    selected = checkpointed(configs.join(chosen.select(F.col("id").alias("idx")), "idx"))
    store.append_new(selected.select("set_id", "idx", "occ_key"), f"selected_{spec.key()[:16]}", ["occ_key"], "set_id string, idx long, occ_key string")
    refs = checkpointed(selected_references(selected, accepted(final_energies, spec.final_calc, selected), spec.min_partial_frac))
    partial = refs.count() < selected.count()
    described = {"base_ce_key": spec.base.key, "endpoints": list(spec.endpoints), "wl_policy": spec.policy, "reject_cross": spec.reject_cross, "base_calc": asdict(spec.base.calc), "final_calc": asdict(spec.final_calc), "steps": spec.steps, "samples_per_bin": spec.samples_per_bin, "budget": spec.budget}
    return train_and_store(spark, store, spec.key(partial=partial), spec.base, described, features.join(refs.select("set_id", "idx"), ["set_id", "idx"], "left_semi"), refs)


def resolve_refined(spark: SparkSession, store: Catalogue, spec: EnsureRefined):
    """The stored refined model under the full key or else the partial one; None if there is neither."""
    return lookup_model(spark, store, spec.key()) or lookup_model(spark, store, spec.key(partial=True))


def kept_enough(n_kept: int, n_selected: int, least: float) -> bool:
    """Whether the converged part of a selection is as large as a partial model needs."""
    return n_kept >= least * n_selected


def select_refined(endpoints: DataFrame, samples: DataFrame, featurise: Callable[[DataFrame], DataFrame], budget: int) -> DataFrame:
    """(pool, place, id, is_seed): the D-optimal choice among endpoints and sampled occupancies of each pool.

    Both tables: (pool, id, grp, bin, occ_hash, occ); endpoints come first
    and all of them are taken. ``featurise`` adds the column x.
    """
    both = endpoints.withColumn("is_seed", F.lit(True)).unionByName(samples.withColumn("is_seed", F.lit(False)))
    return design.select_d_optimal(featurise(both).select("pool", "id", "is_seed", "grp", "bin", "occ_hash", "x"), budget)


def selected_references(selected: DataFrame, energies: DataFrame, least: float = 1.0) -> DataFrame:
    """Selected configurations with their energies. Below a fraction of 1, those
    without one are left out as long as enough stay; else they are an error."""
    return joins.complete(selected, energies, ["occ_key"], least)
