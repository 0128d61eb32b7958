"""From mixtures to the refined model over a catalogue, the command line, and faults that had no test."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparlattice.functions import keys
from sparlattice.operators import design, geometry, sampling, store, thermo, training
from sparlattice.plans import cli, workflows
from sparlattice.plans.specs import CalcSpec, EnsureModel, EnsureRefined, Mixture, PrototypeSpec
from sparlattice.sources import catalogue

LATTICE = {"sublattice": [0, 0, 1, 1, 1, 1], "neighbours": [[1, 2, 3], [0, 4, 5], [0, 3], [0, 2], [1, 5], [1, 4]], "fields": [0.0, 0.3], "coupling": -0.5}
ENDS = ({"Es": {"Mg": 2}, "Fm": {"Al": 4}}, {"Es": {"Al": 2}, "Fm": {"Mg": 4}})
CALC = CalcSpec("vasp-gga", "full", "nonmagnetic", 0.02)


def features(configs):
    """A constant, and the site-weighted number of Al."""
    value = F.aggregate("occupation", F.lit(0.0), lambda s, o: s + F.when(o["element"] == "Al", o["site"] + 1.0).otherwise(0.0))
    return configs.select("set_id", "idx", F.array(F.lit(1.0), value).alias("x"))


def base():
    mixtures = (Mixture({"Es": {"Al": 1, "Mg": 1}, "Fm": {"Al": 3, "Mg": 1}}, 6), *(Mixture(e, 1) for e in ENDS))
    return EnsureModel(PrototypeSpec("spinel_Q0O", {"a": 8.1}), (1, 1, 1), mixtures, CALC, {2: 5.0}, {"type": "ridge", "alpha": 1e-9})


def every_energy(spark):
    """Energies of all 64 occupations: 3 + 2 times the second feature."""
    rows = [(i, [(s, "Al" if i >> s & 1 else "Mg") for s in range(6)]) for i in range(64)]
    df = spark.createDataFrame(rows, "idx long, occupation array<struct<site:bigint,element:string>>").withColumn("set_id", F.lit("x"))
    x = features(df)
    return df.join(x, ["set_id", "idx"]).select(F.sha2(F.to_json("occupation"), 256).alias("occ_key"), (3 + 2 * F.col("x")[1]).alias("energy"))


def refined(**changed):
    how = {"base": base(), "endpoints": ENDS, "wl_policy": {"bin_width": 0.2, "seed": 3, "check_period": 100}, "steps": 400, "samples_per_bin": 2, "budget": 5}
    return EnsureRefined(**(how | changed))


def test_from_mixtures_to_the_refined_model(spark, tmp_path):
    at = catalogue.Catalogue(f"file://{tmp_path}/store")
    spec, lattice, energies = refined(), sampling.Lattice(**LATTICE), every_energy(spark)
    assert len(spec.sampled_mixtures) == 1
    with pytest.raises(KeyError):
        workflows.ensure_refined(spark, at, spec, energies.limit(0), features, lattice)
    model = workflows.ensure_refined(spark, at, spec, energies, features, lattice)
    assert model.ce_key == spec.key() and model.coefficients == pytest.approx([3.0, 2.0], rel=1e-4)
    stats = json.loads(model.stats)
    assert stats["in_sample"]["n"] == 5 == stats["five_fold_cv"]["n"] == stats["design_metrics"]["n_samples"]
    assert {keys.comp_map_sig(e) for e in ENDS} < set(stats["in_sample_by_composition"]) == set(stats["five_fold_cv_by_composition"])
    blocks = at.read(spark, "wl_blocks", sampling.BLOCK_SCHEMA).collect()
    assert [b.step_end for b in blocks] == [400] and blocks[0].wl_key == spec.wl_key(spec.sampled_mixtures[0].composition_map)
    # What is stored isn't made again: no energies are needed now.
    assert workflows.ensure_refined(spark, at, spec, energies.limit(0), features, lattice).ce_key == model.ce_key
    # A longer chain goes on from the stored tip.
    workflows.ensure_refined(spark, at, refined(steps=500), energies, features, lattice)
    assert sorted(b.step_end for b in at.read(spark, "wl_blocks", sampling.BLOCK_SCHEMA).collect()) == [400, 900]


def test_a_partial_model_has_a_key_of_its_own(spark, tmp_path):
    at = catalogue.Catalogue(f"file://{tmp_path}/store")
    lattice, energies = sampling.Lattice(**LATTICE), every_energy(spark)
    workflows.ensure_model(spark, at, base(), energies, features)
    spec = refined(min_partial_frac=0.5)
    blocks, species = workflows.ensure_blocks(spark, at, spec, lattice)
    _, samples = workflows.candidates(spark, blocks, species, spec)
    one = samples.orderBy("occ_key").first().occ_key
    model = workflows.ensure_refined(spark, at, refined(min_partial_frac=0.5, budget=99), energies.where(F.col("occ_key") != one), features, lattice)
    assert model.ce_key == refined(min_partial_frac=0.5, budget=99).key(partial=True)


def test_stored_models_verify(spark, tmp_path):
    at = catalogue.Catalogue(f"file://{tmp_path}/store")
    spec, energies = base(), every_energy(spark)
    model = workflows.ensure_model(spark, at, spec, energies, features)
    assert workflows.mixtures_of(model) == spec.mixtures
    with pytest.raises(ValueError):
        workflows.mixtures_of({"spec": "{}"})
    rows = features(workflows.configurations(spark, spec)).join(workflows.configurations(spark, spec).join(energies, "occ_key").select("set_id", "idx", F.col("energy").alias("y")), ["set_id", "idx"])
    sites = sum(spec.prototype.active_sites(spec.supercell).values())
    assert workflows.verified(model, rows, sites) and not workflows.verified(model, rows.withColumn("y", F.col("y") + 1), sites)


def test_command_line_runs(spark, tmp_path, monkeypatch):
    every_energy(spark).write.parquet(f"{tmp_path}/e.parquet")
    shared = ["--store", f"file://{tmp_path}/store"]
    model = ["--prototype", "spinel_Q0O", "--param", "a=8.1", "--supercell", "1", "1", "1", "--cutoffs", "2:5", "--calculator", "vasp-gga", "--mix", "composition_map=Es:{Al:1,Mg:1},Fm:{Al:3,Mg:1};K=6;seed=0", "--reg-type", "ridge", "--alpha", "1e-9"]
    with_inputs = ["--energies", f"file://{tmp_path}/e.parquet", "--features", "tests.test_workflows:features"]
    ends = [x for e in ("Es:{Mg:2},Fm:{Al:4}", "Es:{Al:2},Fm:{Mg:4}") for x in ("--endpoint", e)]
    chain = ["--bin-width", "0.2", "--check-period", "100"]
    out = cli.main(["ensure-refined", *model, *shared, *with_inputs, *ends, *chain, "--wl-seed", "3", "--steps", "400", "--samples-per-bin", "2", "--budget", "5", "--lattice", json.dumps(LATTICE)], spark)
    assert out["stored"] == out["ce_key"] and out["stats"]["in_sample"]["max_abs"] < 1e-3
    extend = ["extend-wl", *shared, *chain, "--seed", "3", "--ce-key", out["base_ce_key"], "--composition-map", "Es:{Al:1,Mg:1},Fm:{Al:3,Mg:1}", "--steps", "200", "--repeats", "2", "--lattice", json.dumps(LATTICE)]
    assert cli.main(extend, spark)["step_end"] == 800
    at = catalogue.Catalogue(f"file://{tmp_path}/store")
    assert sorted(b.step_end for b in at.read(spark, "wl_blocks", sampling.BLOCK_SCHEMA).collect()) == [400, 600, 800]
    assert set(cli.main(["ensure-model", *model])) == {"ce_key"}


def test_energies_of_accepted_tasks(spark):
    schema = "occ_key string, calculator string, relax_type string, spin_type string, frozen_sublattices string, max_force double, is_force_converged boolean, energy double"
    rows = [("a", "vasp-gga", "full", "nonmagnetic", "", f, None, e) for f, e in ((0.01, 1.0), (0.015, 2.0), (0.02, 3.0), (0.001, None))]
    rows += [("b", "vasp-gga", "full", "afm", "", 0.01, True, 1.0), ("c", "vasp-gga", "static", "nonmagnetic", "", 0.01, True, 1.0), ("d", "vasp-gga", "full", "nonmagnetic", "Es", 0.01, True, 1.0)]
    learned = [("e", "MACE-MPA-0;m", "full", "nonmagnetic", "", 0.01, ok, float(ok)) for ok in (True, False)]
    tasks = spark.createDataFrame(rows + learned, schema)
    assert [tuple(r) for r in store.energies_of(tasks, CALC).collect()] == [("a", 1.0)]
    assert [tuple(r) for r in store.energies_of(tasks, CalcSpec("MACE-MPA-0;m", "full", "afm", 0.02)).collect()] == [("e", 1.0)]
    with pytest.raises(PySparkException):
        store.energies_of(tasks.union(tasks), CALC).collect()


def test_averages_keep_chains_apart(spark):
    dos = spark.createDataFrame([("p", 0, 0.0, 0.0), ("p", 1, 1.0, 0.0), ("q", 0, 0.0, 5.0), ("q", 1, 1.0, 9.0)], "chain string, bin long, energy double, entropy double")
    prop = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 3.0), ("q", 0, 10.0), ("q", 1, 30.0)], "chain string, bin long, value double")
    got = {r.chain: r.mean for r in thermo.canonical_average(dos, prop, [1000.0], kb=0.001, keys=["chain"]).collect()}
    w = np.exp([[0, -1], [5, 9 - 1]])
    want = (w * [[1, 3], [10, 30]]).sum(axis=1) / w.sum(axis=1)
    assert [got["p"], got["q"]] == pytest.approx(want)
    shared = thermo.canonical_average(dos, prop.where("chain = 'p'").drop("chain"), [1000.0], kb=0.001, keys=["chain"])
    assert {r.chain: r.mean for r in shared.collect()} == pytest.approx({"p": want[0], "q": (w[1] * [1, 3]).sum() / w[1].sum()})


@pytest.mark.parametrize("x", [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], None], [[1.0, 2.0], [1.0]], [[1.0, None], [1.0, 2.0]]])
def test_missing_and_ragged_features_fail(spark, x):
    df = spark.createDataFrame([(v, 1.0) for v in x], "x array<double>, y double").coalesce(1)
    with pytest.raises(PySparkException):
        training.gram_rows(df, "x").collect()
    with pytest.raises(PySparkException):
        design.design_metrics(df, "x")


def test_nothing_to_fit_and_nothing_left(spark):
    with pytest.raises(ValueError):
        training.fit(spark.createDataFrame([], "x array<double>, y double"), "x", "y")
    with pytest.raises(ValueError):
        geometry.without_placeholders(spark.createDataFrame([("X",)], "species string"))


def test_ties_have_one_outcome(spark):
    rows = [("c", 5, v) for v in "dbca"]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "chain string, step long, v string").repartition(3)
        assert store.tips(df, "chain", "step").first().v == store.first_matching(df, "chain", "step", F.lit(True)).first().v == "a"
        assert store.new_only(df, df.limit(0), ["chain"]).first().v == "a"


def test_dataset_identity_ignores_order_and_repeats(spark):
    df = spark.createDataFrame([("s", str(i)) for i in range(50)], "set_id string, occ_key string")
    want = workflows.dataset_identity(df)
    assert workflows.dataset_identity(df.union(df).repartition(7)) == want != workflows.dataset_identity(df.where("occ_key <> '7'"))


def test_shared_folder_must_be_set_off_a_local_master(monkeypatch):
    class Off:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    with pytest.raises(RuntimeError):
        catalogue.checkpoint_dir(Off)


def test_base_and_final_calculators_have_energies_of_their_own(spark, tmp_path):
    at = catalogue.Catalogue(f"file://{tmp_path}/store")
    lattice, final = sampling.Lattice(**LATTICE), CalcSpec("vasp-24", "static", "ferromagnetic", 0.5)
    settings = [F.lit(v).alias(n) for n, v in (("relax_type", "full"), ("spin_type", "nonmagnetic"), ("frozen_sublattices", ""), ("is_force_converged", True))]
    cheap = every_energy(spark).select("occ_key", "energy", F.lit("vasp-gga").alias("calculator"), F.lit(0.01).alias("max_force"), *settings)
    # The final settings accept larger forces, and give energies of another slope.
    dear = cheap.select("occ_key", (10 - F.col("energy")).alias("energy"), F.lit("vasp-24").alias("calculator"), F.lit(0.3).alias("max_force"), F.lit("static").alias("relax_type"), F.lit("ferromagnetic").alias("spin_type"), "frozen_sublattices", "is_force_converged")
    spec = refined(final=final)
    assert len({spec.key(), refined().key(), refined(final=CalcSpec("vasp-24", "static", "ferromagnetic", 0.4)).key()}) == 3 and spec.base.key == refined().base.key
    model = workflows.ensure_refined(spark, at, spec, cheap.unionByName(dear), features, lattice)
    assert model.ce_key == spec.key() and model.coefficients == pytest.approx([7.0, -2.0], rel=1e-4)
    assert workflows.lookup_model(spark, at, spec.base.key).coefficients == pytest.approx([3.0, 2.0], rel=1e-4)
    described = json.loads(model.spec)
    assert (described["base_calc"]["calculator"], described["final_calc"]["max_force_eV_per_A"]) == ("vasp-gga", 0.5)
    # Plain energies don't say whose they are.
    with pytest.raises(ValueError):
        workflows.ensure_refined(spark, at, refined(final=final, budget=4), every_energy(spark), features, lattice)
    # A tie among structures that weren't chosen is no fault.
    chosen = at.read(spark, f"selected_{spec.key()[:16]}", "set_id string, idx long, occ_key string")
    other = dear.join(chosen, "occ_key", "left_anti").limit(1)
    again = workflows.accepted(dear.unionByName(other), final, chosen)
    assert again.count() == chosen.count()
    with pytest.raises(PySparkException):
        workflows.accepted(dear.unionByName(other), final).collect()


def test_chains_with_swaps_across_sublattices_have_keys_and_species_of_their_own():
    across, within = refined(reject_cross=False), refined()
    m = within.sampled_mixtures[0].composition_map
    assert across.wl_key(m) != within.wl_key(m) and across.key() == within.key()
    assert across.chain_species({"Es": {"Mg": 2}, "Fm": {"Al": 4}}) == ({"Es": ["Al", "Mg"], "Fm": ["Al", "Mg"]}, [[0, 2], [4, 0]])
    assert within.chain_species({"Es": {"Mg": 2}, "Fm": {"Al": 4}}) == ({"Es": ["Mg"], "Fm": ["Al"]}, [[2], [4]])


def test_options_come_from_the_specs(capsys):
    shared = ["--prototype", "spinel_Q0O", "--param", "a=8.1", "--supercell", "1", "1", "1", "--calculator", "vasp-gga", "--mix", "composition_map=Es:{Al:1,Mg:1},Fm:{Al:3,Mg:1};K=6"]
    refine = ["ensure-refined", *shared, "--endpoint", "Es:{Mg:2},Fm:{Al:4}", "--bin-width", "0.2", "--steps", "9", "--samples-per-bin", "2", "--budget", "5"]
    keys_of = lambda *more: cli.main([*refine, *more])
    plain = keys_of()
    for more, base_changes in ((("--final-calculator", "vasp-24"), False), (("--final-max-force-eV-per-A", "0.5"), False), (("--basis", "chebyshev"), True), (("--seed", "3"), True), (("--balance-by-comp",), True), (("--update-period", "2"), False), (("--cutoffs", "1:9"), True)):
        got = keys_of(*more)
        assert got["ce_key"] != plain["ce_key"] and (got["base_ce_key"] != plain["base_ce_key"]) == base_changes
    assert keys_of("--final-calculator", "vasp-gga")["ce_key"] == plain["ce_key"]
    a = cli.refined_spec(cli.parser().parse_args([*refine, "--reject-cross-sublattice-swaps", "--final-relax-type", "static"]))
    assert a.reject_cross and a.final_calc.relax_type == "static" and a.final_calc.calculator == "vasp-gga"
    chain = ["chain-key", "--ce-key", "k", "--composition-map", "Es:{Mg:2}", "--bin-width", "0.1"]
    assert cli.main(chain) != cli.main([*chain, "--reject-cross-sublattice-swaps"])
    capsys.readouterr()


def test_stored_models_are_verified_and_predict_together(spark, tmp_path):
    at = catalogue.Catalogue(f"file://{tmp_path}/store")
    energies, models = every_energy(spark), []
    for k in range(2):
        spec = EnsureModel(base().prototype, (1, 1, 1), base().mixtures, CALC, {2: 5.0 + k}, {"type": "ridge", "alpha": 1e-9})
        models.append(workflows.ensure_model(spark, at, spec, energies, features))
    configs = workflows.configurations(spark, base())
    rows = features(configs).join(configs.join(energies, "occ_key").select("set_id", "idx", F.col("energy").alias("y")), ["set_id", "idx"])
    both = rows.crossJoin(spark.createDataFrame([(m.ce_key,) for m in models], "model string")).select("model", F.col("set_id").alias("grp"), F.lit(0).alias("fold"), "x", "y")
    docs = at.read(spark, "ce_models", workflows.MODEL_SCHEMA)
    # Every model has one line for all rows and one for each of its three compositions.
    verdicts = workflows.verified_models(docs, both, per_prim=6.0)
    assert [(r.model, r.verdict) for r in verdicts.orderBy("model").collect()] == [(k, "same") for k in sorted(m.ce_key for m in models) for _ in range(4)]
    off = both.withColumn("y", F.when(F.col("model") == models[0].ce_key, F.col("y") + 1e-4).otherwise(F.col("y")))
    assert {(r.model, r.verdict) for r in workflows.verified_models(docs, off, per_prim=6.0).collect()} == {(models[0].ce_key, "differs"), (models[1].ce_key, "same")}
    orbits = spark.createDataFrame([("m", 1, 1, 0), ("m", 1, 2, 1), ("m", 2, 1, 0), ("m", 2, 1, 1), ("n", 1, 1, 1)], workflows.ORBITS)
    coefficients = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 2.0), ("m", 2, 4.0), ("n", 1, 8.0)], workflows.COEFFICIENTS)
    workflows.store_ensemble(at, orbits, coefficients)
    workflows.store_ensemble(at, orbits, coefficients)
    structures = spark.createDataFrame([("a", 0, 1.0), ("a", 1, -1.0), ("b", 0, 1.0), ("b", 1, 1.0)], "structure_id string, site int, value double")
    got = sorted(map(tuple, workflows.predict_structures(spark, at, structures).collect()))
    assert got == [("m", "a", -3.0), ("m", "b", 7.0), ("n", "a", -8.0), ("n", "b", 8.0)]
    # The sparse join equals features laid out as rows and a product with the coefficients.
    phi = geometry.orbit_features(structures, orbits.where("model = 'm'").drop("model")).collect()
    dense = {s: 1.0 + sum({1: 2.0, 2: 4.0}[r.orbit_id] * r.phi for r in phi if r.structure_id == s) for s in "ab"}
    assert dense == {s: v for m, s, v in got if m == "m"}
    with pytest.raises(LookupError):
        workflows.stored_ensemble(spark, at, ["m", "nosuch"])
