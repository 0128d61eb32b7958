"""Selection, streams, stores and matching whose work must not gather in one task, beside plain versions."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparlattice.functions import columns as col
from sparlattice.operators import blocks, design, geometry, joins, sampling, store, thermo
from sparlattice.plans import specs
from sparlattice.sources.catalogue import Catalogue
from sparlattice.streaming import chains

# ---- D-optimal selection


def plain_d_optimal(x, seeds, groups, ties, budget, ridge=1e-10, tolerance=1e-15):
    """All gains anew for each pick."""
    inverse, chosen, left = np.eye(x.shape[1]) / ridge, [], set(range(len(x)))

    def take(i):
        nonlocal inverse
        v = inverse @ x[i]
        inverse = inverse - np.outer(v, v) / (1 + x[i] @ v)
        chosen.append(i)
        left.discard(i)

    for i in np.flatnonzero(seeds).tolist():
        take(i)
    while len(chosen) < budget and left:
        for g in sorted(set(groups)):
            own = [i for i in sorted(left) if groups[i] == g]
            if own and len(chosen) < budget:
                gains = [float(np.log1p(x[i] @ (inverse @ x[i]))) for i in own]
                take(min((i for i, h in zip(own, gains, strict=True) if abs(h - max(gains)) <= tolerance), key=lambda i: ties[i]))
    return chosen


@pytest.mark.parametrize("kind", ["signs", "normal", "equal"])
def test_stale_gains_give_the_same_picks(spark, kind):
    """Also where most gains are equal, and where few candidates fit into memory."""
    rng = np.random.default_rng(1)
    n, p, budget = 300, 6, 60
    x = {"signs": rng.choice([-1.0, 1.0], (n, p)), "normal": rng.normal(size=(n, p)), "equal": np.ones((n, p))}[kind]
    groups, seeds = ["abc"[i % 3] for i in range(n)], np.arange(n) < 4
    bins = [None if i % 5 == 0 else i % 7 - 3 for i in range(n)]
    hashes = [f"{i * 7919 % n:05d}" for i in range(n)]
    want = plain_d_optimal(x, seeds, groups, [design.tie_key(b, h) for b, h in zip(bins, hashes, strict=True)], budget)
    assert design.d_optimal(x, seeds, groups, [design.tie_key(b, h) for b, h in zip(bins, hashes, strict=True)], budget) == want
    rows = [(1, i, bool(seeds[i]), groups[i], bins[i], hashes[i], x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "pool long, id long, is_seed boolean, grp string, bin long, occ_hash string, x array<double>").repartition(3)
    for held_bytes in (design.HELD_BYTES, 1):
        passes = []
        got = [r["id"] for r in design.select_d_optimal(df, budget, held_bytes=held_bytes, passes=passes).orderBy("place").collect()]
        assert got == want and (len(passes) == 1 if held_bytes > 1 else len(passes) <= budget)


# ---- chain states over a stream


def plain_states(energies, width, period):
    s = {"entropy": {}, "h": {}, "n": 0, "m": 1.0}
    for e in energies:
        b = math.floor(e / width)
        s["entropy"][b] = s["entropy"].get(b, 0.0) + s["m"]
        s["h"][b] = s["h"].get(b, 0) + 1
        s["n"] += 1
        if s["n"] % period == 0:
            h = [s["h"].get(k, 0) for k in s["entropy"]]
            if len(h) >= 2 and min(h) > 0.8 * sum(h) / len(h):
                s["h"], s["m"] = {}, s["m"] / 2
    return s


def test_chain_states_go_on_after_a_restart(spark, tmp_path):
    """Three runs of the streams, each with new files; periods go on from one to the next."""
    rng, said = np.random.default_rng(2), {"a": [], "b": []}
    schema = "chain string, energy double, step long"
    for run in range(3):
        rows = []
        for chain, n in (("a", 70), ("b", 33)):
            new = rng.uniform(0, 3, n).tolist()
            said[chain] += new
            rows += [(chain, e, 1_000 * run + k) for k, e in enumerate(new)]
        rows += [("a", float("inf"), 5), ("b", None, 6)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = {r["chain"]: r for r in chains.final_states(spark, events, 1.0, 20, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()}
        for chain, energies in said.items():
            want, r = plain_states(energies, 1.0, 20), got[chain]
            assert (r["steps"], r["bins"], r["mod_factor"]) == (want["n"], len(want["entropy"]), want["m"])
            state = {s["bin"]: (s["entropy"], s["histogram"]) for s in json.loads(r["state"])}
            assert state == {b: (e, want["h"].get(b, 0)) for b, e in want["entropy"].items()}
    assert got["a"]["mod_factor"] < 1


def test_streams_without_rows(spark, tmp_path):
    schema = "chain string, energy double, step long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert chains.final_states(spark, events, 1.0, 20, f"{tmp_path}/out", f"{tmp_path}/checkpoint").count() == 0


# ---- large fields in child tables


def test_large_fields_are_read_without_a_shuffle(spark, tmp_path):
    at = Catalogue(f"file://{tmp_path}/store")
    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), (F.col("id") % 7).alias("n"), F.repeat(F.lit("x"), 50).alias("Big"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("samples"))
    at.write_split(rows, "blocks", "key", ["Big", "samples"], 3)
    whole = at.read_split(spark, "blocks", ["Big", "samples"])
    assert sorted(map(tuple, whole.select(rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 3 out of 3") >= 2
    bare = at.read_split(spark, "blocks")
    assert bare.columns == ["key", "n"] and "Big" not in bare._jdf.queryExecution().executedPlan().toString()
    # The latest version counts, in a session that knows no table too.
    at.write_split(rows.where("n = 1"), "blocks", "key", ["Big"], 2)
    other = spark.newSession()
    assert at.read_split(other, "blocks", ["Big"]).count() == rows.where("n = 1").count()
    with pytest.raises(LookupError):
        at.read_split(spark, "blocks", ["samples"])
    with pytest.raises(LookupError):
        at.read_split(spark, "nosuch")
    for bad in (rows.unionByName(rows.limit(1)), rows.withColumn("key", F.when(F.col("n") > 1, F.col("key")))):
        with pytest.raises(ValueError):
            at.write_split(bad, "bad", "key", ["Big"])


# ---- sites on a grid


@pytest.mark.parametrize("cell_rows", [10, 20_000])
@pytest.mark.parametrize("shape", ["cloud", "line", "heap"])
def test_near_points_equal_brute_force(spark, shape, cell_rows):
    rng = np.random.default_rng(4)
    a, b = (rng.uniform(-1, 1, (150, 3)) * {"cloud": 1.0, "line": [0, 0, 1.0], "heap": 0.01}[shape] for _ in range(2))
    a[:3] = b[:3] = 0.25
    frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(999, None, 0.0, 0.0)], "id long, x double, y double, z double") for points in (a, b)]
    want = sorted(zip(*map(np.ndarray.tolist, np.nonzero((np.abs(a[:, None] - b[None]) <= 0.02).all(axis=2))), strict=True))
    pairs = joins.near_points(*frames, "xyz", 0.02, cell_rows)
    assert sorted(map(tuple, pairs.collect())) == want
    lefts, rights = ([p[i] for p in want] for i in (0, 1))
    flags = {(r["l_id"], r["r_id"]): r["ambiguous"] for r in joins.with_ambiguity(pairs).collect()}
    assert flags == {(i, j): lefts.count(i) > 1 or rights.count(j) > 1 for i, j in want}


def test_points_on_a_line_lie_in_many_cells(spark):
    """100,000 points that share two coordinates are split along the third one."""
    points = spark.range(100_000).select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), (F.col("id") / 1e5).alias("z"))
    pairs = joins.near_points(points, points, "xyz", 2e-6)
    assert pairs.where("l_id = r_id").count() == pairs.count() == 100_000
    cells = points.groupBy(*(joins.cells(F.col(c), 8 * 4e-6) for c in "xyz")).count()
    assert cells.agg(F.max("count")).first()[0] < 10


# ---- bins of all widths from one sketch


def plain_width(e, width, least=50, most=200, rounds=40):
    seen = set()
    for _ in range(rounds):
        if width in seen:
            break
        seen.add(width)
        n = len(np.unique(np.floor(e / width)))
        if n < least:
            width /= 2
        elif n > most:
            width *= 2
        else:
            return width
    return None


@pytest.mark.parametrize("scale, start", [(1.0, 64.0), (1e-6, 1.0), (1e6, 0.01), (1.0, 0.37)])
def test_adapted_width_is_that_of_the_loop(spark, scale, start):
    e = np.concatenate([np.random.default_rng(5).normal(size=3_000), [0.0, -0.0, 7.5]]) * scale
    df = spark.createDataFrame([(float(v),) for v in e] + [(None,), (float("inf"),), (float("nan"),)], "e double").repartition(5)
    assert thermo.adapted_width(df, "e", start) == plain_width(e, start)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=80), st.integers(1, 5), st.integers(4, 30))
def test_sketches_merge(values, parts, cap):
    e = np.array(values)
    whole, merged = thermo.Occupancy(-20, cap), thermo.Occupancy(-20, cap)
    whole.add(-20, np.unique(np.floor(e / 2.0**-20)))
    for k in range(parts):
        one = thermo.Occupancy(-20, cap)
        one.add(-20, np.unique(np.floor(e[k::parts] / 2.0**-20)))
        merged.add(one.level, one.bins)
    for level in range(-20, 25):
        n = len(np.unique(np.floor(e / 2.0**level)))
        assert whole.count(level) == merged.count(level) == (n if level >= whole.level else float("inf"))
        assert n > cap or level >= whole.level or whole.level > level


# ---- gates, annotations, block keys


def test_a_gate_reports_all_failing_rows(spark):
    rows = [("a", -1.0, 0.01, True), ("b", None, 0.01, True), ("c", -1.0, 0.02, False), ("d", float("nan"), None, None), ("e", -1.0, 0.0, None)]
    df = spark.createDataFrame(rows, "key string, energy double, max_force double, is_force_converged boolean")
    strict = {r["key"]: r["failed"] for r in store.gate(df, store.convergence_checks(specs.CalcSpec("MACE-MPA-0;m", "full", "nonmagnetic", 0.02)), ["key"]).collect()}
    assert strict == {"b": ["energy"], "c": ["force below the limit", "converged"], "d": ["energy", "force", "force below the limit", "converged"], "e": ["converged"]}
    assert "e" not in {r["key"] for r in store.gate(df, store.convergence_checks(specs.CalcSpec("vasp-gga", "full", "nonmagnetic", 0.02)), ["key"]).collect()}


def test_annotations_carry_null_for_unknown_symbols(spark):
    sites = spark.createDataFrame([(0, "Fe"), (1, "Qq"), (2, None)], "site_idx int, species string")
    facts = spark.createDataFrame([("Fe", 55.8, "d"), ("Mg", 24.3, "s")], "species string, mass double, block string")
    assert sorted(map(tuple, geometry.annotated(sites, facts).collect())) == [(0, "Fe", 55.8, "d"), (1, "Qq", None, None), (2, None, None, None)]
    with pytest.raises(PySparkException):
        geometry.annotated(sites, facts.unionByName(facts.where("species = 'Fe'"))).collect()


def test_doubles_as_json(spark):
    rng = np.random.default_rng(0)
    xs = [0.0, -0.0, 1.0, 1e-4, 9.999e-5, 1e15, 123456789.0, 2e-3, 2.0**-44, 0.1 + 0.2, -1.5e-7, float("nan"), float("inf"), -float("inf"), 1e7, 12345678.9, 1e-300]
    xs += (rng.normal(size=3_000) * 10.0 ** rng.integers(-14, 15, 3_000)).tolist() + (2.0 ** rng.integers(-60, 53, 200)).tolist()
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double").select("x", col.json_double(F.col("x")).alias("s"))
    assert all(r["s"] == json.dumps(r["x"]) for r in df.collect())


def test_block_keys_are_the_same_in_spark_and_python(spark):
    state = {"version": 1, "bin_indices": [-3, 2], "entropy": [0.5, 1.25e-7], "mod_factor": 0.1 + 0.2, "bin_size": 0.02}
    text = json.dumps(state, sort_keys=True, separators=(",", ":"))
    payload = {"wl_key": "ab12", "parent_wl_block_key": "GENESIS", "state": state, "occupancy": [0, 1, 1, 2]}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert sampling.block_key("ab12", "GENESIS", text, [0, 1, 1, 2]) == want
    df = spark.createDataFrame([("ab12", "GENESIS", [0, 1, 1, 2], [-3, 2], [0.5, 1.25e-7], 0.1 + 0.2, 0.02)], "k string, p string, occ array<int>, b array<long>, e array<double>, m double, w double")
    built = col.json_object({"version": F.lit("1"), "bin_indices": col.json_list(F.col("b")), "entropy": col.json_list(F.col("e"), col.json_double), "mod_factor": col.json_double(F.col("m")), "bin_size": col.json_double(F.col("w"))})
    r = df.select(built.alias("s"), col.block_key(F.col("k"), F.col("p"), built, F.col("occ")).alias("key")).first()
    assert (r["s"], r["key"]) == (text, want)
    with pytest.raises(PySparkException):
        df.select(col.block_key(F.lit('a"b'), F.col("p"), built, F.col("occ"))).collect()


# ---- blocks of recorded steps


def test_blocks_of_recorded_steps(spark):
    rng = np.random.default_rng(6)
    steps = [(k, i, int(rng.integers(-2, 3)), rng.integers(0, 2, 3).tolist()) for k, n in (("a", 25), ("b", 7)) for i in range(n)]
    df = spark.createDataFrame(steps, "wl_key string, step long, bin long, occ array<int>").repartition(4)
    made = {(r["wl_key"], r["step_end"]): r for r in blocks.recorded_blocks(df, 10, 0.5, 1).collect()}
    assert set(made) == {("a", 10), ("a", 20), ("a", 25), ("b", 7)}
    for (chain, end), r in made.items():
        so_far = [s for s in steps if s[0] == chain and s[1] < end]
        own = [s for s in so_far if s[1] >= (end - 1) // 10 * 10]
        state = json.loads(r["state"])
        bins = sorted({s[2] for s in so_far})
        assert state["bin_indices"] == bins and state["occurrences"] == [sum(s[2] == b for s in so_far) for b in bins] and state["histogram"] == [sum(s[2] == b for s in own) for b in bins]
        assert state["entropy"] == pytest.approx([math.log(n) for n in state["occurrences"]]) and (r["bins"], r["visits"]) == (len(bins), end)
        assert sorted(b for b, _ in json.loads(r["samples"])) == sorted({s[2] for s in own})
        assert dict((b, o) for b, o in json.loads(r["samples"])) == {b: next(s[3] for s in own if s[2] == b) for b in {s[2] for s in own}}
        assert sum(n for *_, n in json.loads(r["cation_counts"])) == sum(len(set(s[3])) for s in own)
    keys = {r["wl_block_key"]: r["parent_wl_block_key"] for r in made.values()}
    assert sorted(p in keys or p == sampling.GENESIS for p in keys.values()) == [True] * 4 and re.fullmatch("[0-9a-f]{64}", next(iter(keys)))


def test_references_that_are_none_fail(spark):
    docs = spark.createDataFrame([(1, '{"composition_map":{"Es":{"Mg":2}},"occ_key":"k","calc_spec":{"calculator":"c"}}')], "id int, document string")
    r = store.parsed_references(docs).first()
    assert (r["id"], r["composition_map"], r["occ_key"], r["calc_spec"]["calculator"]) == (1, {"Es": {"Mg": 2}}, "k", "c")
    for bad in (None, "no json", '{"occ_key":"k"}'):
        with pytest.raises(PySparkException):
            store.parsed_references(spark.createDataFrame([(1, bad)], "id int, document string")).collect()


# ---- structures dealt to tasks


def test_orbit_features_are_dealt_by_structure(spark):
    """Tasks follow the number of rows, not the number of sites, and each holds whole structures."""
    rng = np.random.default_rng(8)
    values = rng.choice([-1.0, 1.0], (300, 3)).tolist()
    sites = spark.createDataFrame([(k, s, v) for k, vs in enumerate(values) for s, v in enumerate(vs)], "structure_id long, site int, value double")
    orbits = spark.createDataFrame([(1, s, s) for s in range(3)] + [(2, 1, 0), (2, 1, 1), (2, 2, 1), (2, 2, 2)], "orbit_id int, cluster_id int, site int")
    got = geometry.orbit_features(sites, orbits, task_rows=100).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["structure_id"], r["orbit_id"]): r["phi"] for r in got} == {(k, o): f for k, (a, b, c) in enumerate(values) for o, f in ((1, pytest.approx((a + b + c) / 3)), (2, (a * b + b * c) / 2))}
    tasks = [{r["structure_id"] for r in got if r["task"] == t} for t in {r["task"] for r in got}]
    assert len(tasks) > 15 and sum(map(len, tasks)) == 300 and max(map(len, tasks)) < 60
    plan = geometry.orbit_features(sites, orbits)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(site" not in plan


def test_predictions_meet_models_where_structures_lie(spark):
    """Nothing is exchanged by site, cluster or model, of which there are few."""
    rng = np.random.default_rng(9)
    values = rng.choice([-1.0, 1.0], (200, 3)).tolist()
    sites = spark.createDataFrame([(k, s, v) for k, vs in enumerate(values) for s, v in enumerate(vs)], "structure_id long, site int, value double")
    orbits = spark.createDataFrame([("m", 1, 1, 0), ("m", 1, 2, 1), ("n", 2, 1, 1), ("n", 2, 1, 2)], "model string, orbit_id int, cluster_id int, site int")
    coefficients = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 2.0), ("n", 2, 4.0)], "model string, orbit_id int, coefficient double")
    want = {("m", k): 1.0 + a + b for k, (a, b, _) in enumerate(values)} | {("n", k): 4.0 * b * c for k, (_, b, c) in enumerate(values)}
    for out in (geometry.predicted(sites, orbits, coefficients, 100), geometry.predicted(geometry.dealt(sites, orbits, task_rows=50), orbits, coefficients, None)):
        got = out.withColumn("task", F.spark_partition_id()).collect()
        assert {(r["model"], r["structure_id"]): r["predicted"] for r in got} == want
        assert len({r["task"] for r in got}) > 6
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(structure_id") == 1


@pytest.mark.parametrize("cell_rows", [10, 20_000])
def test_ambiguous_pairs_are_not_shuffled(spark, cell_rows):
    rng = np.random.default_rng(10)
    a, b = (np.concatenate([rng.uniform(-1, 1, (150, 3)), rng.uniform(0, 0.05, (40, 3))]) for _ in range(2))
    b[:60] = a[:60]
    frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(900, None, 0.0, 0.0), (5, *map(float, points[7]))], "id long, x double, y double, z double") for points in (a, b)]
    want = joins.with_ambiguity(joins.near_points(*frames, "xyz", 0.03, cell_rows))
    got = joins.near_points_with_ambiguity(*frames, "xyz", 0.03, cell_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["ambiguous"] for r in got.collect()} == {True, False}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_id" not in plan and "hashpartitioning(r_id" not in plan
