"""Store, join, set and parsing queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import joins, store
from ..tables import table
from .registered import query


@query("""SELECT o_custkey, o_orderstatus, min(o_totalprice) AS force, count(*) FILTER (WHERE o_totalprice = low) AS ties,
CASE WHEN count(*) FILTER (WHERE o_totalprice = low) = 1 THEN min(o_orderkey) FILTER (WHERE o_totalprice = low) END AS energy
FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS low FROM orders) GROUP BY 1, 2""")
def energy_lookup_argmin(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("force"), F.col("o_orderkey").alias("energy"))
    return store.least_force(docs, ["o_custkey", "o_orderstatus"], "force", "energy")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def lookup_unique_violations(spark, sf_dir):
    return store.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def projected_lookup(spark, sf_dir):
    criteria = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000)
    return store.projected(table(spark, sf_dir, "orders"), criteria, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def wl_tip(spark, sf_dir):
    return store.tips(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE value >= 100 AND event_id >= 500) WHERE rn = 1")
def first_matching_block(spark, sf_dir):
    criteria = (F.col("value") >= 100) & (F.col("event_id") >= 500)
    return store.first_matching(table(spark, sf_dir, "events"), "user_id", "event_id", criteria).select("user_id", "event_id", "value")


@query("""WITH RECURSIVE links AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events),
walk AS (SELECT event_id, event_id AS root, CAST(0 AS BIGINT) AS depth FROM links WHERE parent IS NULL
UNION ALL SELECT l.event_id, w.root, w.depth + 1 FROM links l JOIN walk w ON l.parent = w.event_id) SELECT * FROM walk""")
def chain_walk(spark, sf_dir):
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    links = table(spark, sf_dir, "events").select("event_id", parent.alias("parent"))
    return joins.chain_depths(links, "event_id", "parent")


_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_one(spark, sf_dir):
    kept = store.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT n, count(*) AS keys FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY n")
def duplicate_counts(spark, sf_dir):
    found = store.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return found.groupBy("n").agg(F.count("*").alias("keys"))


def _criteria():
    return [("status", F.col("o_orderstatus") == "F"), ("price", F.col("o_totalprice") > 200000), ("priority", F.col("o_orderpriority").startswith("1"))]


@query("""SELECT 'status' AS criterion, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders UNION ALL
SELECT 'price', count(*) FILTER (WHERE o_totalprice > 200000) FROM orders UNION ALL
SELECT 'priority', count(*) FILTER (WHERE starts_with(o_orderpriority, '1')) FROM orders""")
def delete_preview(spark, sf_dir):
    return store.delete_preview(table(spark, sf_dir, "orders"), dict(_criteria()))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_totalprice > 200000) GROUP BY 1")
def delete_rewrite(spark, sf_dir):
    return store.deleted(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT 'status' AS criterion, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders UNION ALL
SELECT 'price', count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000) FROM orders UNION ALL
SELECT 'priority', count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND starts_with(o_orderpriority, '1')) FROM orders""")
def debug_lookup(spark, sf_dir):
    return store.progressive_counts(table(spark, sf_dir, "orders"), _criteria())


@query("SELECT event_type, count(DISTINCT (user_id, props)) AS distinct_values, count(DISTINCT (user_id, props)) = 1 AS homogeneous FROM events GROUP BY 1")
def homogeneity_assert(spark, sf_dir):
    return store.homogeneity(table(spark, sf_dir, "events"), ["user_id", "props"], ["event_type"])


@query("SELECT page_id, CASE WHEN strpos(url, '/en/') > 0 THEN substring(url, strpos(url, '/en/')) END AS path FROM pages")
def path_anchor_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", store.after_anchor(F.col("url"), "/en/").alias("path"))


# ---- parsing ----


@query("SELECT p_partkey, unnest([2, 3]) AS order_, unnest([CAST(p_size + 1 AS DOUBLE), p_size / 2]) AS radius FROM part")
def parse_cutoffs(spark, sf_dir):
    text = F.format_string("2:99, 3:%s,,2:%d", (F.col("p_size") / 2).cast("string"), F.col("p_size") + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(col.parsed_cutoffs(text)).alias("c"))
    return rows.select("p_partkey", "c.order_", "c.radius")


@query("SELECT p_partkey, unnest(['Fe', 'Mn']) AS element, unnest([CAST(p_size AS BIGINT), 100 - p_size]) AS n FROM part")
def parse_counts(spark, sf_dir):
    text = F.format_string("Mn:%d, Fe: %d", 100 - F.col("p_size"), F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(col.parsed_counts(text)).alias("c"))
    return rows.select("p_partkey", "c.element", "c.n")


@query("SELECT p_partkey, unnest(['Es', 'Fm', 'Fm']) AS sublattice, unnest(['Mg', 'Al', 'Mg']) AS element, unnest([CAST(p_size AS BIGINT), p_size + 1, 60 - p_size]) AS n FROM part")
def parse_comp_map(spark, sf_dir):
    text = F.format_string("Fm:{Mg:%d,Al:%d},Es:{Mg:%d}", 60 - F.col("p_size"), F.col("p_size") + 1, F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(col.parsed_comp_map(text)).alias("s")).select("p_partkey", "s.sublattice", F.explode("s.counts").alias("c"))
    return rows.select("p_partkey", "sublattice", "c.element", "c.n")


@query("""SELECT p_partkey, t AS token, regexp_extract(t, '^([A-Z][0-9]+)([A-Z][a-z]{0,2})$', 1) AS tag, regexp_extract(t, '^([A-Z][0-9]+)([A-Z][a-z]{0,2})$', 2) AS element
FROM (SELECT p_partkey, unnest(string_split('J' || (p_size % 3) || 'Sr_Q0O_' || p_brand, '_')) AS t FROM part)""")
def parse_prototype_tokens(spark, sf_dir):
    text = F.concat(F.lit("J"), F.col("p_size") % 3, F.lit("Sr_Q0O_"), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(text, "_")).alias("token"))
    tag, element = col.token_parts(F.col("token"))
    return rows.select("p_partkey", "token", tag.alias("tag"), element.alias("element"))


@query("SELECT p_partkey, trim(p_brand) AS name, CASE WHEN p_size % 2 = 0 THEN p_name || ';x' END AS model FROM part")
def calculator_split(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" ; "), "p_name", F.lit(";x"))).otherwise(F.concat("p_brand", F.lit(";")))
    return table(spark, sf_dir, "part").select("p_partkey", col.calculator_name(text).alias("name"), col.calculator_model(text).alias("model"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true ELSE false END AS valid FROM part")
def frozen_csv_valid(spark, sf_dir):
    text = F.element_at(F.array(F.lit("Es,Fm"), F.lit("Fm,Es"), F.lit("Es, Fm")), F.col("p_size") % 3 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", col.frozen_valid(text).alias("valid"))


@query("SELECT event_id, printf('%.3f', value * 1000.0) AS milli FROM events")
def milli_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", col.in_milli(F.col("value")).alias("milli"))


# ---- canonical forms ----


def _element_counts(spark, sf_dir):
    """Composition of each supplier: sublattices from flags, elements from status."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_suppkey", F.col("l_returnflag").alias("sublattice"), F.col("l_linestatus").alias("element")).agg(F.count("*").alias("n"))


_ELEMENTS = "c AS (SELECT l_suppkey, l_returnflag AS sublattice, l_linestatus AS element, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"


def _sigs(spark, sf_dir):
    per = _element_counts(spark, sf_dir).groupBy("l_suppkey", "sublattice").agg(col.counts_sig(F.collect_list(F.struct("element", "n"))).alias("sig"))
    return per


@query(f"WITH {_ELEMENTS} SELECT l_suppkey, sublattice, string_agg(element || ':' || n, ',' ORDER BY element) AS sig FROM c GROUP BY 1, 2")
def counts_sig(spark, sf_dir):
    return _sigs(spark, sf_dir)


_MAP_SIG = f"""{_ELEMENTS}, s AS (SELECT l_suppkey, sublattice, string_agg(element || ':' || n, ',' ORDER BY element) AS sig FROM c GROUP BY 1, 2),
m AS (SELECT l_suppkey, string_agg(sublattice || ':{{' || sig || '}}', ',' ORDER BY sublattice) AS sig FROM s GROUP BY 1)"""


def _map_sigs(spark, sf_dir):
    return _sigs(spark, sf_dir).groupBy("l_suppkey").agg(col.comp_map_sig(F.collect_list(F.struct("sublattice", "sig"))).alias("sig"))


@query(f"WITH {_MAP_SIG} SELECT l_suppkey, sig FROM m")
def comp_map_sig(spark, sf_dir):
    return _map_sigs(spark, sf_dir)


@query(f"WITH {_ELEMENTS} SELECT l_suppkey, element, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2")
def comp_totals(spark, sf_dir):
    return _element_counts(spark, sf_dir).groupBy("l_suppkey", "element").agg(F.sum("n").alias("n"))


@query("SELECT l_returnflag AS sublattice, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS elements FROM lineitem GROUP BY 1")
def sublattice_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("sublattice"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("elements"))


@query(f"WITH {_MAP_SIG} SELECT l_suppkey, sig, CAST(row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY sig, l_suppkey) AS INTEGER) AS place FROM m")
def sorted_compositions(spark, sf_dir):
    w = Window.partitionBy(F.col("l_suppkey") % 16).orderBy("sig", "l_suppkey")
    return _map_sigs(spark, sf_dir).withColumn("place", F.row_number().over(w))


@query("SELECT DISTINCT l_discount AS x, (CAST(round_even(l_discount * 3.7 * 1e10, 0) AS BIGINT) % 10000000000 + 10000000000) % 10000000000 AS q FROM lineitem")
def quantise_wrap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x"), col.quantised(F.col("l_discount") * 3.7).alias("q")).distinct()


@query("SELECT event_id, round_even(value / 7 - floor(value / 7), 8) + 0.0 AS frac FROM events")
def frac_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (joins.frac_key(F.col("value") / 7) + 0.0).alias("frac"))


@query("""SELECT n AS es, m AS fm, k, 'Es:{A:' || (n - k) || ',B:' || k || '},Fm:{A:' || k || ',B:' || (m - k) || '}' AS sig
FROM (SELECT DISTINCT s_nationkey + 2 AS n, 2 * s_nationkey + 5 AS m FROM supplier) t, LATERAL (SELECT CAST(unnest(generate_series(1, n - 1)) AS INTEGER) AS k)""")
def swap_mixture_grid(spark, sf_dir):
    """Sizes of two sublattices by nation; all mixtures in which k atoms trade places."""
    sizes = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 2).alias("es"), (2 * F.col("s_nationkey") + 5).alias("fm")).distinct()
    grid = sizes.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("es") - 1).cast("int"))))
    sig = F.format_string("Es:{A:%d,B:%d},Fm:{A:%d,B:%d}", F.col("es") - F.col("k"), F.col("k"), F.col("k"), F.col("fm") - F.col("k"))
    return grid.select("es", "fm", "k", sig.alias("sig"))


@query("SELECT l_suppkey, l_returnflag AS sublattice, l_linestatus AS element, count(*) AS n, sha256(CAST(l_suppkey AS VARCHAR)) AS occ_key, l_suppkey / 8.0 AS max_force FROM lineitem GROUP BY ALL")
def reference_records(spark, sf_dir):
    """Training references, one a supplier, written as documents and read back as records."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    of_sublattice = counts.groupBy("l_suppkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("c"))
    maps = of_sublattice.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "c"))).alias("composition_map"))
    calc = F.struct(F.lit("vasp-gga").alias("calculator"), F.lit("full").alias("relax_type"), F.lit("afm").alias("spin_type"), (F.col("l_suppkey") / 8.0).alias("max_force_eV_per_A"), F.lit("").alias("frozen_sublattices"))
    refs = maps.select("l_suppkey", "composition_map", F.sha2(F.col("l_suppkey").cast("string"), 256).alias("occ_key"), calc.alias("calc_spec"))
    back = store.parsed_references(store.reference_documents(refs))
    rows = back.select("l_suppkey", F.explode("composition_map").alias("sublattice", "c"), "occ_key", F.col("calc_spec.max_force_eV_per_A").alias("max_force"))
    return rows.select("l_suppkey", "sublattice", F.explode("c").alias("element", "n"), "occ_key", "max_force")


def _grid(spark, sf_dir, on):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra"))
    m = n.select(F.col("a").alias("b"), F.col("ra").alias("rb"))
    return n.join(m, on(n, m))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = 0 AND b.n_regionkey = 1")
def element_grid_product(spark, sf_dir):
    return _grid(spark, sf_dir, lambda x, y: (x.ra == 0) & (y.rb == 1)).select("a", "b")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def element_grid_combination(spark, sf_dir):
    return _grid(spark, sf_dir, lambda x, y: (x.ra == y.rb) & (x.a < y.b)).select("a", "b")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name AND NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = 2 AND a.n_regionkey = r.r_regionkey)")
def element_grid_permutation(spark, sf_dir):
    skip = table(spark, sf_dir, "region").where("r_regionkey = 2").select(F.col("r_regionkey").alias("ra"))
    return _grid(spark, sf_dir, lambda x, y: (x.ra == y.rb) & (x.a != y.b)).join(skip, "ra", "left_anti").select("a", "b")


@query("""SELECT vec_id, sha256(unhex(string_agg(printf('%02X', q & 255), '' ORDER BY i))) AS occ_hash FROM
(SELECT vec_id, i, CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS INTEGER) AS q FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i)) GROUP BY 1""")
def occ_hash(spark, sf_dir):
    codes = F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", col.occ_hash(codes).alias("occ_hash"))


@query("SELECT user_id, sha256('[' || string_agg('[\"' || event_type || '\",' || event_id || ']', ',' ORDER BY event_type, event_id) || ']') AS dataset_key FROM events GROUP BY 1")
def dataset_key(spark, sf_dir):
    refs = F.array_sort(F.collect_list(F.struct("event_type", "event_id")))
    blob = F.array_join(F.transform(refs, lambda r: F.concat(F.lit('["'), r["event_type"], F.lit('",'), r["event_id"].cast("string"), F.lit("]"))), ",")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sha2(F.concat(F.lit("["), blob, F.lit("]")), 256).alias("dataset_key"))


# ---- joins and sets ----


@query("SELECT o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal <= 5000")
def train_join_energies(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("occ_key"))
    energies = table(spark, sf_dir, "customer").where("c_acctbal <= 5000").select(F.col("c_custkey").alias("occ_key"), "c_acctbal")
    return joins.with_energies(refs, energies, ["occ_key"]).select("o_orderkey", "o_totalprice", "c_acctbal")


@query("SELECT DISTINCT o_custkey AS occ_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal <= 5000)")
def missing_energies_anti(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("occ_key"))
    return joins.missing(refs, table(spark, sf_dir, "customer").where("c_acctbal <= 5000").select(F.col("c_custkey").alias("occ_key")), ["occ_key"])


@query(f"WITH {_MAP_SIG} SELECT l_suppkey, sig FROM m WHERE sig NOT IN (SELECT sig FROM m WHERE l_suppkey % 7 = 0)")
def non_endpoint_anti(spark, sf_dir):
    sigs = _map_sigs(spark, sf_dir)
    return sigs.join(sigs.where("l_suppkey % 7 = 0").select("sig").distinct(), "sig", "left_anti").select("l_suppkey", "sig")


@query("SELECT a.n_name AS refined, b.n_name AS base FROM nation a JOIN nation b ON a.n_nationkey - 5 = b.n_nationkey")
def base_refined_self_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    refined = n.select(F.col("n_name").alias("refined"), (F.col("n_nationkey") - 5).alias("key"))
    return refined.join(n.select(F.col("n_name").alias("base"), F.col("n_nationkey").alias("key")), "key").select("refined", "base")


_UNION = """u AS (SELECT 0 AS priority, event_id AS seen, user_id AS occ FROM events WHERE event_type = 'purchase' UNION ALL
SELECT 1, event_id, user_id * 2 FROM events WHERE event_type <> 'purchase'),
c AS (SELECT occ, priority, seen FROM (SELECT *, row_number() OVER (PARTITION BY occ ORDER BY priority, seen) AS rn FROM u) WHERE rn = 1)"""


def _candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ends = e.where("event_type = 'purchase'").select(F.col("user_id").alias("occ"), F.col("event_id").alias("seen"))
    rest = e.where("event_type <> 'purchase'").select((F.col("user_id") * 2).alias("occ"), F.col("event_id").alias("seen"))
    return joins.union_first([ends, rest], "occ", "seen")


@query(f"WITH {_UNION} SELECT occ, priority, seen FROM c")
def candidates_union_dedupe(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"WITH {_UNION} SELECT occ FROM c EXCEPT SELECT occ FROM c WHERE seen % 3 = 0")
def remaining_candidates(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("occ").exceptAll(c.where("seen % 3 = 0").select("occ"))


def _points(spark, sf_dir, shift):
    e = F.col("embedding")
    axes = [(e[i].cast("double") + (shift if i == 0 else 0.0)).alias(x) for i, x in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *axes)


@query("""SELECT a.vec_id AS l_id, b.vec_id AS r_id FROM embeddings a, embeddings b
WHERE abs(CAST(a.embedding[1] AS DOUBLE) - (CAST(b.embedding[1] AS DOUBLE) + 0.01)) <= 0.02 AND abs(CAST(a.embedding[2] AS DOUBLE) - CAST(b.embedding[2] AS DOUBLE)) <= 0.02
AND abs(CAST(a.embedding[3] AS DOUBLE) - CAST(b.embedding[3] AS DOUBLE)) <= 0.02""")
def coord_range_match(spark, sf_dir):
    return joins.near_points(_points(spark, sf_dir, 0.0), _points(spark, sf_dir, 0.01), "xyz", 0.02)


@query("""WITH pairs AS (SELECT a.vec_id AS l_id, b.vec_id AS r_id FROM embeddings a, embeddings b
WHERE abs(CAST(a.embedding[1] AS DOUBLE) - (CAST(b.embedding[1] AS DOUBLE) + 0.01)) <= 0.04 AND abs(CAST(a.embedding[2] AS DOUBLE) - CAST(b.embedding[2] AS DOUBLE)) <= 0.04
AND abs(CAST(a.embedding[3] AS DOUBLE) - CAST(b.embedding[3] AS DOUBLE)) <= 0.04)
SELECT l_id, r_id, count(*) OVER (PARTITION BY l_id) > 1 OR count(*) OVER (PARTITION BY r_id) > 1 AS ambiguous FROM pairs""")
def site_matches(spark, sf_dir):
    return joins.near_points_with_ambiguity(_points(spark, sf_dir, 0.0), _points(spark, sf_dir, 0.01), "xyz", 0.04)


@query("""SELECT a.vec_id AS id FROM embeddings a WHERE EXISTS (SELECT 1 FROM embeddings b WHERE b.label = 3 AND abs(CAST(a.embedding[1] AS DOUBLE) - CAST(b.embedding[1] AS DOUBLE)) <= 0.05
AND abs(CAST(a.embedding[2] AS DOUBLE) - CAST(b.embedding[2] AS DOUBLE)) <= 0.05 AND abs(CAST(a.embedding[3] AS DOUBLE) - CAST(b.embedding[3] AS DOUBLE)) <= 0.05)""")
def frozen_semi_join(spark, sf_dir):
    frozen = _points(spark, sf_dir, 0.0).join(table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return joins.near_points(_points(spark, sf_dir, 0.0), frozen, "xyz", 0.05).select(F.col("l_id").alias("id")).distinct()


@query("""SELECT key, count(DISTINCT value) AS n_values FROM (SELECT p_brand AS key, p_type AS value FROM part UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR) FROM supplier)
GROUP BY 1 HAVING count(DISTINCT value) > 1""")
def task_lookup_conflicts(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("string").alias("value"))
    return joins.conflicts(a.unionByName(b), "key", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 5")
def json_field_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.where("k >= 5")
