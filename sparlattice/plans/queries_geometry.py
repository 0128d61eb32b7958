"""Geometry and sampling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import geometry as geo
from ..operators import blocks, joins, sampling, store
from ..sources.catalogue import Catalogue, checkpoint_dir, write_results
from ..streaming import chains
from ..tables import table
from . import specs, workflows
from .registered import query

#: Vectors as sites at their first three components, of a species by their label.
_SPECIES = ("Fe", "X", "Cu", "Mg")
_CELL = f"""sites AS (SELECT vec_id AS site_idx, [{', '.join(map(repr, _SPECIES))}][label % 4 + 1] AS species, CAST(embedding[1] AS DOUBLE) AS fx, CAST(embedding[2] AS DOUBLE) AS fy, CAST(embedding[3] AS DOUBLE) AS fz FROM embeddings),
n AS (SELECT CAST(unnest(generate_series(0, 1)) AS INTEGER) AS v),
big AS (SELECT site_idx, species, (fx + a.v) / 2 AS fx, (fy + b.v) / 2 AS fy, (fz + c.v) / 2 AS fz, a.v AS i, b.v AS j, c.v AS k FROM sites, n a, n b, n c)"""


def _supercell(spark, sf_dir):
    species = F.element_at(F.array(*map(F.lit, _SPECIES)), (F.col("label") % 4 + 1).cast("int"))
    where = [F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(("fx", "fy", "fz"))]
    return geo.supercell(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("site_idx"), species.alias("species"), *where), (2, 2, 2))


@query(f"WITH {_CELL} SELECT * FROM big")
def supercell_expand(spark, sf_dir):
    return _supercell(spark, sf_dir)


@query(f"WITH {_CELL} SELECT site_idx, i, j, k, CASE WHEN (i + j + k) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM big")
def spin_parity(spark, sf_dir):
    sign = geo.spin_sign(F.lit("afm"), F.col("site_idx"), F.col("i"), F.col("j"), F.col("k"))
    return _supercell(spark, sf_dir).select("site_idx", "i", "j", "k", sign.alias("sign"))


@query(f"WITH {_CELL} SELECT site_idx, i, j, k, CASE species WHEN 'Fe' THEN 5.0::DOUBLE WHEN 'Cu' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * CASE WHEN (i + j + k) % 2 = 0 THEN 1 ELSE -1 END + 0.0 AS moment FROM big WHERE species <> 'X'")
def moment_transfer(spark, sf_dir):
    cell = geo.without_placeholders(_supercell(spark, sf_dir))
    sign = geo.spin_sign(F.lit("afm"), F.col("site_idx"), F.col("i"), F.col("j"), F.col("k"))
    return cell.select("site_idx", "i", "j", "k", (geo.moment(F.col("species"), sign) + 0.0).alias("moment"))


@query("SELECT l_suppkey, l_returnflag AS sublattice, count(*) FILTER (WHERE l_linestatus = 'O') * 8 AS active_sites FROM lineitem GROUP BY 1, 2")
def active_site_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("sublattice"))
    return rows.agg((F.count_if(F.col("l_linestatus") == "O") * 8).alias("active_sites"))


@query("SELECT l_suppkey AS structure_id, l_returnflag AS sublattice, l_linestatus AS species, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2, 3")
def composition_from_sites(spark, sf_dir):
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("structure_id"), F.col("l_returnflag").alias("sublattice"), F.col("l_linestatus").alias("species"), F.col("l_linenumber").cast("string").alias("role"))
    return geo.composition_of(sites, "1")


@query("SELECT n_regionkey AS structure_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Es' ELSE 'Fm' END AS sublattice, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS site_list FROM nation GROUP BY 1, 2")
def sublattice_index(spark, sf_dir):
    label = geo.relabelled(F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B"), {"A": "Es", "B": "Fm"})
    sites = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("structure_id"), label.alias("sublattice"), F.col("n_nationkey").alias("site_idx"))
    return geo.sublattice_index(sites).select("structure_id", "sublattice", F.array_join("site_list", ",").alias("site_list"))


@query("SELECT s.s_suppkey AS site_idx, coalesce(r.r_name, s.s_name) AS species FROM supplier s LEFT JOIN region r ON r.r_regionkey = s.s_nationkey")
def placeholder_replacement(spark, sf_dir):
    sites = table(spark, sf_dir, "supplier").select(F.lit(0).alias("structure_id"), F.col("s_suppkey").alias("site_idx"), F.col("s_nationkey").cast("string").alias("species"), "s_name")
    elements = table(spark, sf_dir, "region").select(F.lit(0).alias("structure_id"), F.col("r_regionkey").cast("string").alias("species"), F.col("r_name").alias("element"))
    known = elements.select("species")
    named = sites.join(known, "species", "left_semi").unionByName(sites.join(known, "species", "left_anti").withColumn("species", F.col("s_name")))
    return geo.replaced(named.drop("s_name"), elements).select("site_idx", "species")


@query("SELECT vec_id AS site_idx, label AS sublattice FROM embeddings")
def property_propagation(spark, sf_dir):
    e = F.col("embedding")
    where = [(e[i].cast("double") + shift).alias(x) for i, (x, shift) in enumerate((("fx", 0.0), ("fy", 0.0), ("fz", 0.0)))]
    target = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure_id"), F.col("vec_id").alias("site_idx"), *where)
    source = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure_id"), *[(e[i].cast("double") + 1.0).alias(x) for i, x in enumerate(("fx", "fy", "fz"))], F.col("label").alias("sublattice"))
    return geo.propagated(target, source, "sublattice").select("site_idx", "sublattice")


@query()
def snapshots(spark, sf_dir):
    part = F.array(F.struct(F.lit("Es").alias("sublattice"), F.lit("Fe").alias("element"), F.lit(3).cast("long").alias("n")), F.struct(F.lit("Es").alias("sublattice"), F.lit("Mg").alias("element"), F.lit(5).cast("long").alias("n")))
    requests = table(spark, sf_dir, "nation").select(F.lit("Es:{Fe:3,Mg:5}").alias("set_id"), F.col("n_nationkey").cast("long").alias("idx"), part.alias("composition"))
    return geo.snapshots(requests, [(i, "Es") for i in range(8)])


_WIDTH, _PERIOD = 50.0, 100


@query(f"""WITH RECURSIVE placed AS (SELECT event_type AS chain, CAST(floor(value / {_WIDTH}) AS BIGINT) AS bin, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // {_PERIOD} AS period FROM events),
bins AS (SELECT DISTINCT chain, bin FROM placed), periods AS (SELECT DISTINCT chain, period FROM placed),
counts AS (SELECT p.chain, p.period, list(coalesce(c.n, 0) ORDER BY b.bin) AS n FROM periods p JOIN bins b USING (chain)
 LEFT JOIN (SELECT chain, period, bin, count(*) AS n FROM placed GROUP BY ALL) c ON c.chain = p.chain AND c.period = p.period AND c.bin = b.bin GROUP BY ALL),
steps AS (SELECT chain, CAST(-1 AS BIGINT) AS period, list_transform(n, lambda v: 0::BIGINT) AS histogram, list_transform(n, lambda v: FALSE) AS seen, 1.0::DOUBLE AS m, 0::BIGINT AS steps FROM counts WHERE period = 0
UNION ALL SELECT chain, period, CASE WHEN flat THEN list_transform(histogram, lambda v: 0::BIGINT) ELSE histogram END, seen, CASE WHEN flat THEN m / 2 ELSE m END, steps FROM
(SELECT *, steps % {_PERIOD} = 0 AND len(known) >= 2 AND list_min(known) > 0.8 * list_avg(known) AS flat FROM
 (SELECT *, list_transform(list_filter(list_zip(histogram, seen), lambda p: p[2]), lambda p: p[1]) AS known FROM
  (SELECT s.chain, c.period, list_transform(list_zip(s.histogram, c.n), lambda p: p[1] + p[2]) AS histogram, list_transform(list_zip(s.seen, c.n), lambda p: p[1] OR p[2] > 0) AS seen, s.m, CAST(s.steps + list_sum(c.n) AS BIGINT) AS steps
   FROM steps s JOIN counts c ON c.chain = s.chain AND c.period = s.period + 1))))
SELECT chain, steps, CAST(len(histogram) AS BIGINT) AS bins, m AS mod_factor FROM steps s WHERE period = (SELECT max(period) FROM periods p WHERE p.chain = s.chain)""")
def streaming_chain_state(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A file source reads folders and globs; the glob also fits a table of one file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    rows = events.select(F.col("event_type").alias("chain"), F.col("value").alias("energy"), F.col("event_id").alias("step"))
    return chains.final_states(spark, rows, _WIDTH, _PERIOD, f"{base}/out", f"{base}/checkpoint").select("chain", "steps", "bins", "mod_factor")


@query("SELECT event_type AS chain, CAST(floor(value / 50.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_visits(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return chains.counted_visits(spark, f"{path}*", spark.read.parquet(path).schema, 50.0, f"{base}/out", f"{base}/checkpoint")


#: Points and nearest neighbours on seven sites: (orbit, cluster, site).
_ORBITS = [(1, i, i) for i in range(1, 8)] + [(2, i, s) for i in range(1, 7) for s in (i, i + 1)]


@query(f"""WITH orbits AS (SELECT * FROM (VALUES {', '.join(map(str, _ORBITS))}) t(orbit_id, cluster_id, site)),
c AS (SELECT l_orderkey AS structure_id, orbit_id, cluster_id, product(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END) AS phi FROM lineitem JOIN orbits ON site = l_linenumber GROUP BY ALL)
SELECT structure_id, orbit_id, round(avg(phi), 9) AS phi FROM c GROUP BY ALL""")
def orbit_features(spark, sf_dir):
    value = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("site"), value.alias("value"))
    orbits = spark.createDataFrame(_ORBITS, "orbit_id int, cluster_id int, site int")
    return geo.orbit_features(sites, orbits).withColumn("phi", F.round("phi", 9))


_MODEL_ORBITS = [("a", *o) for o in _ORBITS] + [("b", 1, i, i) for i in range(1, 5)]
_MODEL_COEFFICIENTS = [("a", 0, 1.5), ("a", 1, -0.25), ("a", 2, 0.125), ("b", 1, 2.0), ("b", 9, -1.0)]


@query(f"""WITH orbits AS (SELECT * FROM (VALUES {', '.join(map(str, _MODEL_ORBITS))}) t(model, orbit_id, cluster_id, site)),
coefficients AS (SELECT * FROM (VALUES {', '.join(map(str, _MODEL_COEFFICIENTS))}) t(model, orbit_id, coefficient)),
sizes AS (SELECT model, orbit_id, cluster_id, count(*) AS full_size FROM orbits GROUP BY ALL),
clusters AS (SELECT l_orderkey AS structure_id, model, orbit_id, cluster_id, product(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END) AS phi, count(*) AS have
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, first(l_linestatus ORDER BY l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) JOIN orbits ON site = l_linenumber GROUP BY ALL),
means AS (SELECT structure_id, model, orbit_id, avg(phi) AS phi FROM clusters JOIN sizes USING (model, orbit_id, cluster_id) WHERE have = full_size GROUP BY ALL)
SELECT m.model, structure_id, round(sum(phi * coefficient) + (SELECT coalesce(sum(c.coefficient), 0) FROM coefficients c WHERE c.model = m.model AND c.orbit_id NOT IN (SELECT orbit_id FROM orbits o WHERE o.model = m.model)), 9) AS predicted
FROM means m JOIN coefficients USING (model, orbit_id) GROUP BY m.model, structure_id""")
def predicted_structures(spark, sf_dir):
    """Orders as structures, scored under two stored models that have different orbits."""
    orbits = spark.createDataFrame(_MODEL_ORBITS, "model string, orbit_id int, cluster_id int, site int")
    coefficients = spark.createDataFrame(_MODEL_COEFFICIENTS, "model string, orbit_id int, coefficient double")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("site"), "l_linestatus")
    # Dealt before lines that repeat are reduced to one a site: the table is shuffled once.
    status = geo.dealt(lines, orbits).groupBy("structure_id", "site").agg(F.min("l_linestatus").alias("s"))
    structures = status.select("structure_id", "site", F.when(F.col("s") == "O", 1.0).otherwise(-1.0).alias("value"))
    return geo.predicted(structures, orbits, coefficients, None).withColumn("predicted", F.round("predicted", 9))


@query("SELECT s_suppkey AS site_idx, CAST(s_nationkey AS VARCHAR) AS species, n_name AS name, n_regionkey AS region FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) ON n_nationkey = s_nationkey")
def site_annotation(spark, sf_dir):
    """Suppliers as sites of their nation's species; species from 15 on aren't known."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_idx"), F.col("s_nationkey").cast("string").alias("species"))
    facts = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").cast("string").alias("species"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return geo.annotated(sites, facts)


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN o_totalprice END AS energy, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 100) / 1000.0 END AS force,
 CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus <> 'O' END AS ok FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN energy IS NULL THEN 'energy' END, CASE WHEN force IS NULL THEN 'force' END,
 CASE WHEN force IS NULL OR force >= 0.05 THEN 'force below the limit' END, CASE WHEN NOT ok THEN 'converged' END) AS failed
FROM t WHERE energy IS NULL OR force IS NULL OR force >= 0.05 OR NOT ok""")
def convergence_gate(spark, sf_dir):
    """Orders as relaxations: which fail what a calculator asks of them."""
    o = table(spark, sf_dir, "orders")
    energy, force = F.when(F.col("o_custkey") % 10 > 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 100) / 1000.0)
    rows = o.select("o_orderkey", energy.alias("energy"), force.alias("max_force"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus") != "O").alias("is_force_converged"))
    failing = store.gate(rows, store.convergence_checks(specs.CalcSpec("vasp-gga", "full", "nonmagnetic", 0.05)), ["o_orderkey"])
    return failing.withColumn("failed", F.array_join("failed", ","))


@query("""SELECT user_id, sha256('{"occupancy":[' || string_agg(event_id, ',' ORDER BY event_id) || '],"parent_wl_block_key":"' || sha256(CAST(user_id - 1 AS VARCHAR)) || '","state":{"bin_indices":['
 || string_agg(CAST(floor(value) AS BIGINT), ',' ORDER BY event_id) || '],"entropy":[' || string_agg(CAST(CAST(value / 3 AS DOUBLE) AS VARCHAR), ',' ORDER BY event_id) || '],"mod_factor":' || CAST(1.0::DOUBLE / (1 + user_id) AS VARCHAR)
 || ',"version":1},"wl_key":"' || sha256(CAST(user_id AS VARCHAR)) || '"}') AS wl_block_key FROM events GROUP BY user_id""")
def block_keys(spark, sf_dir):
    """Users as blocks: events as occupancy, values as a state's bins and entropies."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r"))
    values = F.transform("r", lambda r: r["value"])
    state = {"bin_indices": col.json_list(F.transform(values, lambda v: F.floor(v).cast("long"))), "entropy": col.json_list(values, lambda v: col.json_double(v / 3)), "mod_factor": col.json_double(F.lit(1.0) / (1 + F.col("user_id"))), "version": F.lit("1")}
    keys = [F.sha2((F.col("user_id") + d).cast("string"), 256) for d in (0, -1)]
    return users.select("user_id", col.block_key(keys[0], keys[1], col.json_object(state), F.transform("r", lambda r: r["event_id"])).alias("wl_block_key"))


@query("SELECT event_id, user_id, CASE WHEN user_id % 4 > 0 THEN props END AS props FROM events")
def large_fields_read(spark, sf_dir):
    """Events with their properties in a child table, written and read back bucket by bucket."""
    at = Catalogue(f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("user_id") % 4 > 0, F.col("props")).alias("props"))
    at.write_split(rows, "blocks", "event_id", ["props"])
    return at.read_split(spark, "blocks", ["props"])


_SIDE = "SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber % 2 = {}"


@query(f"""WITH RECURSIVE pairs AS (SELECT a.l_orderkey AS structure_id, a.l_linenumber AS a, b.l_linenumber AS b, CAST(abs(a.l_quantity - b.l_quantity) AS DOUBLE) AS distance
FROM ({_SIDE.format(1)}) a JOIN ({_SIDE.format(0)}) b ON a.l_orderkey = b.l_orderkey WHERE abs(a.l_quantity - b.l_quantity) <= 15),
ranked AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY distance, a, b) AS place FROM pairs),
walk AS (SELECT structure_id, place, a, b, distance, TRUE AS kept, [a] AS left_taken, [b] AS right_taken FROM ranked WHERE place = 1
UNION ALL SELECT r.structure_id, r.place, r.a, r.b, r.distance, NOT list_contains(left_taken, r.a) AND NOT list_contains(right_taken, r.b),
CASE WHEN list_contains(left_taken, r.a) OR list_contains(right_taken, r.b) THEN left_taken ELSE list_append(left_taken, r.a) END,
CASE WHEN list_contains(left_taken, r.a) OR list_contains(right_taken, r.b) THEN right_taken ELSE list_append(right_taken, r.b) END
FROM walk w JOIN ranked r ON r.structure_id = w.structure_id AND r.place = w.place + 1)
SELECT structure_id, a, b, distance FROM walk WHERE kept""")
def nearest_pairs(spark, sf_dir):
    """Lines of an order as sites at their quantities: odd ones matched with even ones, nearest first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure_id"), "l_linenumber", "l_quantity").distinct()
    left = rows.where("l_linenumber % 2 = 1").select("structure_id", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa"))
    right = rows.where("l_linenumber % 2 = 0").select("structure_id", F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb"))
    distance = F.abs(F.col("qa") - F.col("qb")).cast("double")
    pairs = left.join(right, "structure_id").select("structure_id", "a", "b", distance.alias("distance")).where("distance <= 15")
    return joins.greedy_matches(pairs, "structure_id")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def append_without_repeats(spark, sf_dir):
    """Keys of orders appended twice, of even customers first: what is stored already isn't written again."""
    store = Catalogue(f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    schema = "o_custkey long, o_orderstatus string"
    for some in (rows.where("o_custkey % 2 = 0"), rows):
        store.append_new(some, "keys", ["o_custkey", "o_orderstatus"], schema)
    return store.read(spark, "keys", schema)


@query("SELECT event_id, user_id, event_type FROM events")
def results_by_folder(spark, sf_dir):
    """Events written as JSON in a folder for each type, and read back."""
    path = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    write_results(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path, "event_type")
    return spark.read.schema("event_id long, user_id long, event_type string").json(path)


# ---- chains as a store keeps them: events as recorded steps of their type's chain

_STEPS, _QUOTA = 150, 2
_PLACED = f"""placed AS (SELECT *, (place - 1) // {_STEPS} AS number FROM (SELECT event_type AS wl_key, CAST(floor(value / {_WIDTH}) AS BIGINT) AS bin,
 [CAST((user_id >> i) & 1 AS INTEGER) FOR i IN [0, 1, 2, 3]] AS occ, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events)),
ends AS (SELECT wl_key, number, max(place) AS step_end, sha256(wl_key || ':' || number) AS wl_block_key FROM placed GROUP BY ALL),
own AS (SELECT wl_key, number, bin, count(*) AS n FROM placed GROUP BY ALL),
states AS (SELECT e.wl_key, e.number, e.wl_block_key, o.bin, coalesce(sum(o.n) FILTER (WHERE o.number = e.number), 0) AS histogram, sum(o.n) AS occurrences FROM ends e JOIN own o ON o.wl_key = e.wl_key AND o.number <= e.number GROUP BY ALL)"""


def _steps(spark, sf_dir):
    occ = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.call_function("shiftright", F.col("user_id"), i).bitwiseAND(F.lit(1)).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("wl_key"), F.col("event_id").alias("step"), F.floor(F.col("value") / _WIDTH).cast("long").alias("bin"), occ.alias("occ"))


def _stored_blocks(spark, sf_dir):
    """Blocks of recorded steps, written to a catalogue and read back as other programs find them."""
    at = Catalogue(f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    at.append_new(blocks.recorded_blocks(_steps(spark, sf_dir), _STEPS, _WIDTH, _QUOTA), "wl_blocks", ["wl_block_key"], sampling.BLOCK_SCHEMA)
    return at.read(spark, "wl_blocks", sampling.BLOCK_SCHEMA)


@query(f"""WITH {_PLACED} SELECT e.wl_key, e.wl_block_key, CASE WHEN e.number = 0 THEN '{sampling.GENESIS}' ELSE sha256(e.wl_key || ':' || (e.number - 1)) END AS parent_wl_block_key,
 e.step_end, pow(0.5, e.number) AS mod_factor, (SELECT count(*) FROM states s WHERE s.wl_block_key = e.wl_block_key) AS bins, e.step_end AS visits FROM ends e""")
def wl_block_run(spark, sf_dir):
    return _stored_blocks(spark, sf_dir).select("wl_key", "wl_block_key", "parent_wl_block_key", "step_end", "mod_factor", "bins", "visits")


@query("SELECT event_type AS wl_key, CAST(floor(value / 50.0) AS BIGINT) AS bin, count(*) AS occurrences FROM events GROUP BY 1, 2")
def wl_chain_resume(spark, sf_dir):
    """Chains stored up to half of their steps, and gone on with from their tips' states."""
    steps = blocks.ranked(_steps(spark, sf_dir), ["wl_key"], ["step", "bin"])
    half = steps.groupBy("wl_key").agg(F.floor(F.count("*") / 2).alias("half"))
    steps = steps.join(half, "wl_key")
    stored = blocks.recorded_blocks(steps.where("rank <= half").drop("rank", "half"), _STEPS, _WIDTH, _QUOTA)
    return blocks.resumed(store.tips(stored, "wl_key", "step_end"), steps.where("rank > half"))


@query(f"""WITH {_PLACED}, species AS (SELECT wl_key, number, bin, unnest(list_distinct(occ)) AS element, occ FROM placed)
SELECT wl_key, bin, CAST(0 AS BIGINT) AS sublattice, CAST(element AS BIGINT) AS element, CAST(len(list_filter(occ, lambda o: o = element)) AS BIGINT) AS n_sites, count(*) AS count FROM species GROUP BY wl_key, number, bin, element, n_sites""")
def wl_cation_counts(spark, sf_dir):
    return sampling.occupancy_counts(_stored_blocks(spark, sf_dir))


@query(f"""WITH {_PLACED}, firsts AS (SELECT wl_key, number, bin, occ, min(place) AS place FROM placed GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY wl_key, number, bin ORDER BY place) AS k FROM firsts)
SELECT wl_key, sha256(wl_key || ':' || number) AS wl_block_key, bin, array_to_string(occ, ',') AS occ, sha256(unhex(array_to_string([printf('%02X', o) FOR o IN occ], ''))) AS occ_hash,
 CAST(row_number() OVER (PARTITION BY wl_key, number ORDER BY bin, sha256(unhex(array_to_string([printf('%02X', o) FOR o IN occ], '')))) AS INTEGER) AS place FROM kept WHERE k <= {_QUOTA}""")
def wl_samples(spark, sf_dir):
    return sampling.sampled_occupancies(_stored_blocks(spark, sf_dir)).withColumn("occ", F.array_join("occ", ","))


@query(f"WITH {_PLACED} SELECT wl_key, wl_block_key, bin, CAST(bin * {_WIDTH} AS DOUBLE) AS energy, round(ln(occurrences), 9) AS entropy, CAST(histogram AS BIGINT) AS histogram, CAST(occurrences AS BIGINT) AS occurrences FROM states")
def wl_state_bins(spark, sf_dir):
    return sampling.state_bins(_stored_blocks(spark, sf_dir)).withColumn("entropy", F.round("entropy", 9))


@query(f"""WITH {_PLACED} SELECT wl_key, count(*) AS blocks, max(step_end) AS steps, count(*) AS updates, pow(0.5, max(number)) AS mod_factor,
 (SELECT count(DISTINCT bin) FROM own o WHERE o.wl_key = e.wl_key) AS bins, max(step_end) AS visits FROM ends e GROUP BY wl_key""")
def wl_report(spark, sf_dir):
    return sampling.chain_report(_stored_blocks(spark, sf_dir))


@query()
def refined_selection(spark, sf_dir):
    """D-optimal choices among the occupancies that stored blocks sampled, two of each chain as endpoints."""
    samples = sampling.sampled_occupancies(_stored_blocks(spark, sf_dir))
    number = F.row_number().over(Window.partitionBy("wl_key").orderBy("occ_hash"))
    rows = samples.groupBy("wl_key", "occ_hash", "occ").agg(F.min("bin").alias("bin")).withColumn("id", number.cast("long"))
    rows = rows.select(F.pmod(F.xxhash64("wl_key"), F.lit(1_000_000)).alias("pool"), "id", F.col("wl_key").alias("grp"), "bin", "occ_hash", "occ")
    ends, rest = rows.where("id <= 2").withColumn("bin", F.lit(None).cast("long")), rows.where("id > 2")
    signs = F.transform("occ", lambda o: o.cast("double") * 2 - 1)
    return workflows.select_refined(ends, rest, lambda d: d.withColumn("x", signs), 6)
