import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparlattice.functions import columns as col
from sparlattice.operators import design, geometry, joins, sampling, store, thermo, training
from sparlattice.plans import workflows
from sparlattice.plans.specs import CalcSpec, EnsureModel, Mixture, PrototypeSpec
from sparlattice.sources import catalogue


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bins_and_flatness(spark):
    e = spark.createDataFrame([(-0.05,), (0.0,), (0.25,), (float("inf"),)], "e double")
    assert [r[0] for r in e.select(thermo.bin_id(F.col("e"), 0.1)).collect()] == [-1, 0, 2, None]
    h = spark.createDataFrame([("a", 10), ("a", 10), ("a", 9), ("b", 10), ("b", 0), ("c", 100)], "k string, n int")
    assert {r.k: r.flat for r in thermo.flatness(h, ["k"]).collect()} == {"a": True, "b": False, "c": False}


def test_composition_and_purity(spark):
    c = spark.createDataFrame([(0, "s", "A", 3, 2), (0, "s", "A", 1, 1), (0, "s", "B", 1, 2), (0, "s", "B", 3, 1)], "bin int, sublattice string, element string, n_sites int, count int")
    x = {r.element: r.x for r in thermo.composition_by_bin(c).collect()}
    assert x == pytest.approx({"A": 7 / 12, "B": 5 / 12})
    p = {r.element: r.purity for r in thermo.purity_by_bin(c).collect()}
    assert p["A"] == pytest.approx((1 * 2 + 2 / 3) / 3)
    sizes = spark.createDataFrame([("s", 4)], "sublattice string, size int")
    assert {r.purity for r in thermo.purity_by_bin(c, sizes).collect()} == {0.75}


def test_schedule_starts_twice_and_keeps_the_last(spark):
    u = spark.createDataFrame([("c", 10, 0, 0, 1.0), ("c", 10, 1, 5, 0.5), ("c", 20, 0, 5, 0.25)], "chain string, step_end long, pos long, step long, m double")
    b = spark.createDataFrame([("c", 10, 0.5), ("c", 20, 0.25), ("d", 7, 0.9)], "chain string, step_end long, mod_factor double")
    assert rows(thermo.mod_schedule(u, b)) == [("c", 0, 0.5), ("c", 0, 1.0), ("c", 5, 0.25), ("d", 0, 0.9), ("d", 7, 0.9)]


def test_adapted_width(spark):
    e = spark.range(1000).select((F.col("id") / 10).alias("e"))
    assert 50 <= thermo.bins_per_width(e, "e", [thermo.adapted_width(e, "e", 64.0)]).first().bins <= 200
    with pytest.raises(ValueError):
        thermo.adapted_width(e.where("id = 0"), "e", 1.0)


def test_store(spark):
    d = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 6.0), ("b", 1.0, 7.0), ("b", 1.0, 8.0), ("c", None, 1.0)], "k string, f double, e double")
    found = store.least_force(d, ["k"], "f", "e")
    assert rows(found.select("k", "ties")) == [("a", 1), ("b", 2)]
    assert {r.k: r.e for r in found.collect()} == {"a": 5.0, "b": None}
    with pytest.raises(PySparkException):
        store.without_ties(found).collect()
    assert store.lookup_unique(d, F.col("k") == "z") is None
    assert store.lookup_unique(d, F.col("k") == "c").e == 1.0
    with pytest.raises(LookupError):
        store.lookup_unique(d, F.col("k") == "a")
    assert store.deleted(d, F.col("f") > 1).count() == 4  # a null criterion deletes nothing


def test_anchor_is_null_where_absent(spark):
    d = spark.createDataFrame([("x/kfs/a/b",), ("x/y",)], "p string")
    assert [r[0] for r in d.select(store.after_anchor(F.col("p"), "/a/")).collect()] == ["/a/b", None]


@pytest.mark.parametrize("bad", ["Fe54", ":3", "Fe:1,Fe:2", "Fe:-1", ""])
def test_bad_counts_fail_in_columns_too(spark, bad):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(bad,)], "t string").select(col.parsed_counts(F.col("t"))).collect()


def test_joins(spark):
    refs = spark.createDataFrame([("a",), ("b",), ("b",)], "occ_key string")
    have = spark.createDataFrame([("a", 1.0)], "occ_key string, energy double")
    assert rows(joins.missing(refs, have, ["occ_key"])) == [("b",)]
    with pytest.raises(KeyError):
        joins.complete(refs, have, ["occ_key"])
    assert joins.complete(refs, have, ["occ_key"], 0.3).count() == 1
    assert not workflows.kept_enough(3, 8, 0.4) and workflows.kept_enough(4, 8, 0.4)
    circle = spark.createDataFrame([(1, 2), (2, 1)], "k long, up long")
    with pytest.raises(ValueError):
        joins.chain_depths(circle, "k", "up", 5)
    pairs = spark.createDataFrame([(0, 1, 1, 0.1), (0, 1, 2, 0.2), (0, 2, 1, 0.15), (0, 2, 2, 0.3)], "g int, a int, b int, distance double")
    assert rows(joins.greedy_matches(pairs, "g").select("a", "b")) == [(1, 1), (2, 2)]


def data(spark, n=60, p=4):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, p))
    y = x @ np.arange(1, p + 1) + rng.normal(scale=0.1, size=n)
    w = rng.uniform(0.5, 2, size=n)
    return x, y, w, spark.createDataFrame([(i, a.tolist(), float(b), float(c), str(i % 3)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "id long, x array<double>, y double, w double, g string")


def test_solvers(spark):
    x, y, w, df = data(spark)
    assert training.fit(df, "x", "y") == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    s = np.sqrt(w)[:, None] * x
    assert training.fit(df, "x", "y", "w", kind="ridge", alpha=2.0) == pytest.approx(np.linalg.solve(s.T @ s + 2 * np.eye(4), s.T @ (np.sqrt(w) * y)))
    b = training.fit(df, "x", "y", kind="elasticnet", alpha=0.1, l1_ratio=0.5)
    gradient = -x.T @ (y - x @ b) / len(y) + 0.05 * b + 0.05 * np.sign(b)
    assert np.abs(gradient[b != 0]).max() < 1e-8
    with pytest.raises(ValueError):
        training.fit(df, "x", "y", kind="nosuch")


def test_weights_and_statistics(spark):
    d = spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "g string")
    w = {r.g: (r.n, r.weight) for r in training.balance_weights(d, ["g"], 1.0).collect()}
    assert w["a"] == (1, 2.0) and w["b"][1] == pytest.approx(2 / 3)
    e = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 5.0)], "y double, p double")
    s = training.error_stats(e, F.col("y"), F.col("p")).first()
    assert (s.n, s.mae, s.max_abs) == (3, 1.0, 2.0) and s.rmse == pytest.approx((5 / 3) ** 0.5)
    assert training.balance_applies({"alpha": 1}) and training.balance_applies({"scheme": "balance"})
    assert not training.balance_applies({"scheme": "other"}) and not training.balance_applies(None)


def test_cross_validation_is_out_of_fold(spark):
    x, y, _, df = data(spark)
    out = training.cross_validated(df.withColumn("fold", (F.col("id") % 5).cast("int")), "x", "y", kind="ridge", alpha=1.0)
    got = {r.id: r.predicted for r in out.collect()}
    for f in range(5):
        rest = np.arange(len(y)) % 5 != f
        b = np.linalg.solve(x[rest].T @ x[rest] + np.eye(4), x[rest].T @ y[rest])
        for i in np.flatnonzero(~rest):
            assert got[int(i)] == pytest.approx(float(x[i] @ b))
    assert sorted(np.bincount(training.sklearn_folds(7, 0))) == [1, 1, 1, 2, 2]


def test_design_metrics(spark):
    x, _, w, df = data(spark)
    m = design.design_metrics(df, "x", "w")
    s = np.sqrt(w)[:, None] * x
    z = (s - s.mean(axis=0)) / s.std(axis=0)
    u, sv, _ = np.linalg.svd(z, full_matrices=False)
    h = (u**2).sum(axis=1)
    assert m.rank == 4 and m.condition_number == pytest.approx(sv[0] / sv[-1])
    assert (m.logdet_xtx, m.leverage_max, m.leverage_p95) == pytest.approx((2 * np.log(sv).sum(), h.max(), np.percentile(h, 95)))
    assert m.leverage_mean * m.n_samples == pytest.approx(m.rank)


def test_d_optimal(spark):
    assert min([-5, -10, 3, None], key=lambda b: design.tie_key(b, "h")) == -5
    x = np.array([[1.0, 0], [0, 1], [1, 0], [0, 1]])
    ties = [design.tie_key(b, "h") for b in (-10, -10, -5, 3)]
    chosen = design.d_optimal(x, np.zeros(4, bool), ["g"] * 4, ties, 2)
    assert chosen == [2, 1]
    for budget, seeds in ((0, [0] * 4), (1, [1, 1, 0, 0])):
        with pytest.raises(ValueError):
            design.d_optimal(x, np.array(seeds, bool), ["g"] * 4, ties, budget)
    with pytest.raises(ValueError):
        design.d_optimal(np.zeros((0, 2)), np.zeros(0, bool), [], [], 1)
    assert sorted(design.d_optimal(x, np.zeros(4, bool), list("abab"), ties, 99)) == [0, 1, 2, 3]


def test_d_optimal_pools_are_chosen_as_by_the_local_rule(spark):
    random = np.random.default_rng(3)
    rows = [(i % 3, i, i < 6, "ab"[i % 7 > 2], None if i % 5 == 0 else i % 4 - 2, f"{i % 70:04d}", random.normal(size=4).round(1).tolist() if i % 9 else [1.0, 0.0, 0.0, 0.0]) for i in range(210)]
    rows.append((7, 999, False, "a", 1, "h", [0.0, 1.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "pool long, id long, is_seed boolean, grp string, bin long, occ_hash string, x array<double>").repartition(5)
    got = {}
    for r in design.select_d_optimal(df, 12).orderBy("pool", "place").collect():
        got.setdefault(r["pool"], []).append((r["id"], r["is_seed"]))
    for pool in (0, 1, 2, 7):
        own = list({r[5]: r for r in reversed([r for r in rows if r[0] == pool])}.values())[::-1]
        order = design.d_optimal(np.array([r[6] for r in own]), np.array([r[2] for r in own]), [r[3] for r in own], [design.tie_key(r[4], r[5]) for r in own], 12)
        assert got[pool] == [(own[i][1], own[i][2]) for i in order]
    with pytest.raises(ValueError):
        design.select_d_optimal(df, 1)
    assert design.select_d_optimal(df.limit(0), 3).count() == 0


def test_dopt_select_takes_any_number_of_rows_and_every_feature(spark, tmp_path):
    from sparlattice.plans.queries_training import dopt_select

    random = np.random.default_rng(5)
    rows = [(i, 1 + (i >= 5_000), [1.0] * 16 + random.normal(size=48).astype(np.float32).tolist()) for i in range(6_000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = dopt_select(spark, str(tmp_path))
    assert got.where("pool = 1 AND is_seed").count() == 20 and got.where("pool = 1").count() == 20
    x = np.array([r[2] for r in rows[5_000:]])
    order = design.d_optimal(x, np.zeros(1_000, bool), ["2"] * 1_000, [("", "")] * 1_000, 20)
    assert [r["id"] for r in got.where("pool = 2").orderBy("place").collect()] == [5_000 + i for i in order]


def test_snapshots_fill_exactly_and_ignore_the_seed(spark):
    a = geometry.snapshot("set", 3, {"Es": (list(range(8)), {"Fe": 3, "Mg": 5})})
    assert sorted(a.values()) == ["Fe"] * 3 + ["Mg"] * 5 and a == geometry.snapshot("set", 3, {"Es": (list(range(8)), {"Mg": 5, "Fe": 3})})
    for bad in ({"Fe": 0, "Mg": 8}, {"Fe": 3}):
        with pytest.raises(ValueError):
            geometry.snapshot("set", 0, {"Es": (list(range(8)), bad)})
    occ = spark.createDataFrame([("s", 0, 1.0), ("s", 1, -1.0), ("s", 2, -1.0)], "structure_id string, site int, value double")
    orbits = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (2, 2, 1), (2, 3, 1), (2, 3, 2)], "orbit_id int, cluster_id int, site int")
    assert {r.orbit_id: r.phi for r in geometry.orbit_features(occ, orbits).collect()} == {1: 1.0, 2: 0.0}


def test_moments_fail_on_nonmagnetic_sites(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(geometry.moment(F.lit("Fe"), F.lit(0))).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(geometry.spin_sign(F.lit("zero_init"), F.lit(0), F.lit(0), F.lit(0), F.lit(0))).collect()


SPEC = sampling.SamplerSpec(bin_width=0.5, steps=500, check_period=100, samples_per_bin=2, collect_cation_stats=True)
RING = sampling.Lattice.ring(12)
COUNTS = ((3, 3), (4, 2))


def test_chain_resumes_where_it_ended():
    one = sampling.run_block("k", sampling.SamplerSpec(bin_width=0.5, steps=1000, check_period=100), RING, COUNTS, None, None)
    half = sampling.SamplerSpec(bin_width=0.5, steps=500, check_period=100)
    a = sampling.run_block("k", half, RING, COUNTS, None, None)
    b = sampling.run_block("k", half, RING, COUNTS, a[1], a[7])
    assert b[7] == one[7] and b[2] == a[1] and a[2] == sampling.GENESIS and b[3] == 1000
    with pytest.raises(ValueError):
        sampling.Chain.restored(sampling.SamplerSpec(bin_width=0.25, steps=1), RING, a[7])


def test_chain_keeps_composition_energy_and_features():
    c = sampling.Chain(SPEC, RING, sampling.initial_occupancy(COUNTS, RING, 0), np.random.default_rng(0)).run(2000)
    sub = np.array(RING.sublattice)
    assert [np.bincount(c.occ[sub == s], minlength=2).tolist() for s in (0, 1)] == [[3, 3], [4, 2]]
    assert c.features == pytest.approx(RING.features(c.occ)) and c.energy == pytest.approx(float(c.features @ RING.parameters))
    assert c.m < 1 and c.updates[0] == (0, 1.0) and all(len(s) <= 2 for s in c.samples.values())
    assert sum(c.occurrences.values()) == 2000


def test_production_freezes_the_density_of_states():
    a = sampling.run_block("k", SPEC, RING, COUNTS, None, None)
    before = sampling.Chain.restored(SPEC, RING, a[7])
    spec = sampling.SamplerSpec(bin_width=0.5, steps=300, production_mode=True)
    after = sampling.Chain.restored(spec, RING, a[7]).run(300)
    assert after.entropy == before.entropy and after.m == before.m
    assert sum(after.occurrences.values()) == sum(before.occurrences.values()) + 300


def test_u64_codec():
    assert sampling.encode_u64({"s": [2**63]}) == {"s": [{"__u64__": "0x8000000000000000"}]}
    assert sampling.decode_u64(sampling.encode_u64({"s": [2**64 - 1, 5, True]})) == {"s": [2**64 - 1, 5, True]}
    for bad in ({"bin_width": 0}, {"steps": 0}, {"check_period": 0}, {"update_period": 0}, {"samples_per_bin": -1}):
        with pytest.raises(ValueError):
            sampling.SamplerSpec(**({"bin_width": 0.1, "steps": 1} | bad))


def test_convergence_and_extension(spark):
    chains = spark.createDataFrame([("a", 0, None, None), ("b", 1, None, None)], "wl_key string, seed long, parent string, state string")
    tips = sampling.until_converged(chains, SPEC, RING, COUNTS, target=0.3, max_blocks=20)
    assert all(r.mod_factor <= 0.3 for r in tips.collect())
    with pytest.raises(RuntimeError):
        sampling.until_converged(chains, SPEC, RING, COUNTS, target=0.0, max_blocks=1)
    with pytest.raises(ValueError):
        sampling.extend(chains, SPEC, RING, COUNTS, 0)


def test_catalogue(spark, tmp_path):
    with pytest.raises(ValueError):
        catalogue.Catalogue(str(tmp_path), "mongo")
    store_ = catalogue.Catalogue(f"file://{tmp_path}/store")
    schema = "k string, v int"
    store_.append_new(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema), "t", ["k"], schema)
    store_.append_new(spark.createDataFrame([("b", 9), ("c", 3)], schema), "t", ["k"], schema)
    assert rows(store_.read(spark, "t", schema)) == [("a", 1), ("b", 2), ("c", 3)]
    (tmp_path / "map.json").write_text('{"x": "1", "y": "2"}')
    (tmp_path / "list.json").write_text('[{"formula": "x", "id": "1"}, {"formula": "z", "id": "3"}]')
    a = catalogue.json_lookup(spark, f"file://{tmp_path}/map.json")
    b = catalogue.json_lookup(spark, f"file://{tmp_path}/list.json", "formula", "id")
    assert rows(catalogue.merged_lookup(a, b)) == [("x", "1"), ("y", "2"), ("z", "3")]
    with pytest.raises(ValueError):
        catalogue.merged_lookup(a, a.withColumn("value", F.lit("7")))


def test_model_workflow(spark, tmp_path):
    spec = EnsureModel(PrototypeSpec("spinel_Q0O", {"a": 8.1}), (1, 1, 1), (Mixture({"Es": {"Al": 1, "Mg": 1}, "Fm": {"Al": 3, "Mg": 1}}, 6), Mixture({"Es": {"Mg": 2}, "Fm": {"Al": 4}}, 2)), CalcSpec("vasp-gga", "full", "nonmagnetic", 0.02), {2: 5.0}, {"type": "ridge", "alpha": 1e-6})
    store_ = catalogue.Catalogue(f"file://{tmp_path}/store")
    configs = workflows.configurations(spark, spec)
    assert configs.count() == 8
    value = F.aggregate("occupation", F.lit(0.0), lambda s, o: s + F.when(o["element"] == "Al", o["site"] * 1.0).otherwise(0.0))
    energies = configs.select("occ_key", (2.0 * value).alias("energy")).distinct()
    assert workflows.to_compute(configs, energies.limit(0)).count() == energies.count()
    featurise = lambda c: c.select("set_id", "idx", F.array(value).alias("x"))
    with pytest.raises(KeyError):
        workflows.ensure_model(spark, store_, spec, energies.limit(0), featurise)
    model = workflows.ensure_model(spark, store_, spec, energies, featurise)
    assert model.coefficients == pytest.approx([2.0], rel=1e-5)
    assert workflows.ensure_model(spark, store_, spec, energies.limit(0), featurise).ce_key == spec.key


# ---- prefixes over groups of any size


def test_prefixes_are_those_of_one_window(spark):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 10 else None, int(o), None if i % 3 else float(i)) for i, o in enumerate(rng.permutation(500))]
    d = spark.createDataFrame(data, "g string, o long, v double")
    seen, last, n = {}, {}, {}
    wanted = []
    for g, o, v in sorted(data, key=lambda r: r[1]):
        if v is not None:
            seen[g], n[g], last[g] = seen.get(g, 0) + v, n.get(g, 0) + 1, v
        wanted.append((o, seen[g] / n[g] if g in n else None, last.get(g)))
    mean = {r.o: r.running_mean for r in thermo.running_mean(d, ["g"], "o", "v").collect()}
    fill = {r.o: r.v for r in thermo.filled_forward(d, ["g"], "o", "v").collect()}
    assert mean == pytest.approx({o: m for o, m, _ in wanted}) and fill == {o: f for o, _, f in wanted}
    for f in (thermo.running_mean, thermo.filled_forward):
        assert f(d.limit(0), ["g"], "o", "v").count() == 0
        one = f(spark.createDataFrame([("a", None, 1.0), ("a", 2, 3.0)], "g string, o long, v double"), ["g"], "o", "v")
        assert one.count() == 2


# ---- what chains leave behind


_RING, _ATOMS = sampling.Lattice.ring(12), ((3, 3), (4, 2))


def _blocks(spark, **more):
    spec = sampling.SamplerSpec(bin_width=0.5, steps=600, check_period=100, samples_per_bin=2, collect_cation_stats=True, **more)
    chains = spark.createDataFrame([("a", 1, None, None), ("b", 2, None, None)], "wl_key string, seed long, parent string, state string")
    return catalogue.checkpointed(sampling.run_blocks(chains, spec, _RING, _ATOMS))


def test_counts_and_samples_agree_with_the_states(spark):
    blocks = _blocks(spark)
    bins = sampling.state_bins(blocks)
    visits = {(r.wl_key, r.bin): r.occurrences for r in bins.collect()}
    assert {r.wl_key: r.visits for r in blocks.collect()} == {k: sum(v for (w, _), v in visits.items() if w == k) for k in "ab"}
    counts = sampling.occupancy_counts(blocks)
    short = set()
    for r in counts.groupBy("wl_key", "bin", "sublattice", "element").agg(F.sum("count").alias("n")).collect():
        assert r.n <= visits[r.wl_key, r.bin]
        short |= {(r.wl_key, r.bin)} if r.n < visits[r.wl_key, r.bin] else set()
    # Counting starts at the first accepted swap, so that only a chain's first bin may have fewer.
    assert len({k for k, _ in short}) == len(short)
    # Chains keep what each sublattice holds.
    assert {(r.sublattice, r.element, r.n_sites) for r in counts.collect()} == {(0, 0, 3), (0, 1, 3), (1, 0, 4), (1, 1, 2)}
    samples = sampling.sampled_occupancies(blocks).collect()
    assert {(r.wl_key, r.bin) for r in samples} <= set(visits)
    for r in samples:
        assert sorted(o for o, s in zip(r.occ, _RING.sublattice, strict=True) if s == 0) == [0] * 3 + [1] * 3
    per_bin = {}
    for r in samples:
        per_bin.setdefault((r.wl_key, r.bin), []).append(r.occ_hash)
    assert all(len(v) == len(set(v)) <= 2 for v in per_bin.values())


def test_short_lists_of_a_state_are_padded(spark):
    b = spark.createDataFrame([("a", "k", '{"bin_indices":[-1,2],"entropy":[1.0,2.0],"histogram":[3],"occurrences":[],"bin_size":0.5}')], "wl_key string, wl_block_key string, state string")
    assert rows(sampling.state_bins(b)) == [("a", "k", -1, -0.5, 1.0, 3, 0), ("a", "k", 2, 1.0, 2.0, 0, 0)]


def test_only_production_tips_are_analysed(spark):
    blocks = _blocks(spark)
    with pytest.raises(PySparkException):
        sampling.production_tips(blocks).collect()
    later = blocks.withColumn("step_end", F.col("step_end") + 1).withColumn("production_mode", F.lit(True))
    assert sampling.production_tips(blocks.unionByName(later)).count() == 2
    report = sampling.chain_report(blocks.unionByName(later)).collect()
    assert all((r.blocks, r.steps) == (2, 601) for r in report)


def test_kicks_move_movable_sites_alone(spark):
    d = spark.createDataFrame([("s", i, float(i), 0.0, 0.0, i != 1) for i in range(3)], "structure_id string, site_idx int, x double, y double, z double, movable boolean")
    step = np.random.default_rng(12345).normal(0.0, 0.01, (3, 3))
    for r in geometry.kicked(d).collect():
        wanted = [float(r.site_idx), 0.0, 0.0] + step[r.site_idx] * (r.site_idx != 1)
        assert [r.x, r.y, r.z] == pytest.approx(list(wanted))


def test_formulas_and_disordered_sites():
    assert geometry.reduced_formula({"O": 8, "Mg": 2, "Al": 4, "X": 0}) == "Al2MgO4"
    assert geometry.disordered_site(["Mg", "Al"], ["X", "Al"]) == {"Al": 1 / 3, "Mg": 1 / 3, "X": 1 / 3}
    with pytest.raises(ValueError):
        geometry.disordered_site([], [])


def test_streamed_states_are_those_of_one_pass(spark, sf):
    """Of every chain the steps, bins and factor after all events in order of their ids."""
    from sparlattice import registry

    wanted = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        c = wanted.setdefault(r.event_type, {"seen": {}, "h": {}, "n": 0, "m": 1.0})
        b = int(r.value // 50.0)
        c["seen"][b] = True
        c["h"][b] = c["h"].get(b, 0) + 1
        c["n"] += 1
        if c["n"] % 100 == 0:
            h = [c["h"].get(k, 0) for k in c["seen"]]
            if len(h) > 1 and min(h) * len(h) > 0.8 * sum(h):
                c["h"], c["m"] = {}, c["m"] / 2
    got = {r.chain: (r.steps, r.bins, r.mod_factor) for r in registry.queries()["streaming_chain_state"](spark, sf).collect()}
    assert got == {k: (c["n"], len(c["seen"]), c["m"]) for k, c in wanted.items()}
