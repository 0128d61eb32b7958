"""Thermodynamic queries over the stand-in tables: ``events.value`` is the energy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import thermo as th
from ..tables import table
from .registered import query

WIDTH = 10.0
GRID = (300.0, 600.0, 900.0, 1200.0, 1500.0)
#: The stand-in energies span some 500 units; the scale keeps all bins in play.
SCALE = 1000.0

_DOS = f"""dos AS (SELECT bin, n, bin * {WIDTH} AS energy, ln(n) AS entropy FROM
 (SELECT CAST(floor(value / {WIDTH}) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1))"""
_GRID = "grid AS (SELECT CAST(unnest([" + ", ".join(map(str, GRID)) + "]) AS DOUBLE) AS temperature)"


def _dos(spark, sf_dir):
    return th.density_of_states(table(spark, sf_dir, "events"), "value", WIDTH)


def _counts(spark, sf_dir):
    """Cation counts: bins of quantity, sublattices and elements from flags and status."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.floor(F.col("l_quantity") / WIDTH).cast("long").alias("bin"), F.col("l_returnflag").alias("sublattice"), F.col("l_linestatus").alias("element"), F.col("l_linenumber").alias("n_sites")).agg(F.count("*").alias("count"))


_COUNTS = f"""counts AS (SELECT CAST(floor(l_quantity / {WIDTH}) AS BIGINT) AS bin, l_returnflag AS sublattice, l_linestatus AS element,
 l_linenumber AS n_sites, count(*) AS "count" FROM lineitem GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_DOS}, {_GRID},
prop AS (SELECT CAST(floor(value / {WIDTH}) AS BIGINT) AS bin, avg(value) AS v FROM events GROUP BY 1),
x AS (SELECT temperature, v, entropy - energy / ({th.KB_MIX * SCALE!r} * temperature) AS x FROM dos JOIN prop USING (bin) CROSS JOIN grid),
top AS (SELECT *, max(x) OVER (PARTITION BY temperature) AS m FROM x)
SELECT temperature, round(sum(exp(x - m) * v) / sum(exp(x - m)), 6) AS mean FROM top GROUP BY temperature""")
def canonical_mean_by_t(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    prop = events.groupBy(th.bin_id(F.col("value"), WIDTH).alias("bin")).agg(F.avg("value").alias("value"))
    out = th.canonical_average(_dos(spark, sf_dir), prop, GRID, th.KB_MIX * SCALE)
    return out.select("temperature", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_DOS}, {_GRID},
w AS (SELECT temperature, energy, exp((entropy - (SELECT max(entropy) FROM dos)) - (energy - (SELECT min(energy) FROM dos)) / ({th.KB_CV * SCALE!r} * temperature)) AS w FROM dos CROSS JOIN grid),
m AS (SELECT temperature, sum(w) AS z, sum(w * energy) / sum(w) AS u, sum(w * energy * energy) / sum(w) AS u2 FROM w GROUP BY temperature)
SELECT temperature, round(z, 6) AS z, round(u, 6) AS u, round(u2, 5) AS u2, round((u2 - u * u) / ({th.KB_CV * SCALE!r} * temperature * temperature), 6) AS cv FROM m""")
def heat_capacity(spark, sf_dir):
    out = th.heat_capacity(_dos(spark, sf_dir), GRID, th.KB_CV * SCALE)
    return out.select("temperature", F.round("z", 6).alias("z"), F.round("u", 6).alias("u"), F.round("u2", 5).alias("u2"), F.round("cv", 6).alias("cv"))


@query(f"""WITH {_DOS} SELECT bin, round(exp(entropy - (SELECT min(entropy) FROM dos)), 6) AS g_min,
round(exp(entropy - (SELECT max(entropy) FROM dos)) / (SELECT sum(exp(entropy - (SELECT max(entropy) FROM dos))) FROM dos), 9) AS g_max FROM dos""")
def dos_normalised(spark, sf_dir):
    return th.normalised(_dos(spark, sf_dir)).select("bin", F.round("g_min", 6).alias("g_min"), F.round("g_max", 9).alias("g_max"))


@query(f"SELECT CAST(floor(value / {WIDTH}) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def bin_occurrences(spark, sf_dir):
    return th.occurrences(table(spark, sf_dir, "events"), "value", WIDTH)


@query(f"SELECT DISTINCT CAST(floor(value / {WIDTH}) AS BIGINT) AS bin, floor(value / {WIDTH}) * {WIDTH} AS level FROM events")
def bin_levels(spark, sf_dir):
    bins = table(spark, sf_dir, "events").select(th.bin_id(F.col("value"), WIDTH).alias("bin")).distinct()
    return bins.select("bin", th.bin_level(F.col("bin"), WIDTH).alias("level"))


_FIRSTS = f"""firsts AS (SELECT CAST(floor(value / {WIDTH}) AS BIGINT) AS bin, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2),
samples AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY event_id, user_id) AS "rank" FROM firsts) WHERE "rank" <= 3)"""


def _samples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(th.bin_id(F.col("value"), WIDTH).alias("bin"), "user_id", "event_id")
    return th.first_unique(rows, ["bin"], "user_id", "event_id", 3)


@query(f'WITH {_FIRSTS} SELECT bin, user_id, event_id, CAST("rank" AS INTEGER) AS "rank" FROM samples')
def first_k_unique_per_bin(spark, sf_dir):
    return _samples(spark, sf_dir)


@query(f"""WITH {_FIRSTS}, per AS (SELECT bin % 4 AS chain, bin, count(*) AS n FROM samples GROUP BY 1, 2)
SELECT chain, count(*) AS bins, count(*) FILTER (WHERE n >= 3) AS full_bins, CAST(sum(n) AS BIGINT) AS samples, round(avg(n), 6) AS mean FROM per GROUP BY chain""")
def sample_coverage(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("chain", F.col("bin") % 4)
    return th.coverage(rows, ["chain"], 3).withColumn("mean", F.round("mean", 6))


@query("""WITH h AS (SELECT event_type, CAST(floor(value / 50.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS bins, count(*) >= 2 AND min(n) > 0.8 * avg(n) AS flat FROM h GROUP BY event_type""")
def flatness_check(spark, sf_dir):
    return th.flatness(th.occurrences(table(spark, sf_dir, "events"), "value", 50.0, ["event_type"]), ["event_type"])


_UPDATES = """blocks AS (SELECT event_type AS chain, event_id + 1 AS step_end, user_id / 8.0 AS mod_factor FROM events),
updates AS (SELECT event_type AS chain, event_id + 1 AS step_end, CAST(user_id AS BIGINT) AS pos, CAST(floor(value) AS BIGINT) AS step, value / 16 AS m FROM events)"""
_SCHEDULE = f"""{_UPDATES},
kept AS (SELECT chain, step, m FROM (SELECT *, row_number() OVER (PARTITION BY chain, step ORDER BY step_end DESC, pos DESC) AS rn FROM updates) WHERE rn = 1),
schedule AS (SELECT chain, CAST(0 AS BIGINT) AS step, min_by(mod_factor, step_end) AS m FROM blocks GROUP BY chain UNION ALL SELECT * FROM kept)"""


def _schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    end = F.col("event_id") + 1
    blocks = e.select(F.col("event_type").alias("chain"), end.alias("step_end"), (F.col("user_id") / 8.0).alias("mod_factor"))
    updates = e.select(F.col("event_type").alias("chain"), end.alias("step_end"), F.col("user_id").alias("pos"), F.floor("value").cast("long").alias("step"), (F.col("value") / 16).alias("m"))
    return th.mod_schedule(updates, blocks)


@query(f"WITH {_SCHEDULE} SELECT * FROM schedule")
def mod_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir)


@query(f"""WITH {_SCHEDULE}, last AS (SELECT chain, max(step) AS step FROM schedule GROUP BY chain)
SELECT * FROM schedule UNION ALL SELECT l.chain, CAST(1000 AS BIGINT), s.m FROM last l JOIN (SELECT chain, step, max(m) AS m FROM schedule GROUP BY 1, 2) s ON s.chain = l.chain AND s.step = l.step WHERE l.step < 1000""")
def mod_schedule_extended(spark, sf_dir):
    schedule = _schedule(spark, sf_dir)
    ends = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.lit(1000).cast("long").alias("right")).distinct()
    return th.extended(schedule, ends)


@query("SELECT w AS width, count(DISTINCT floor(value / w)) AS bins FROM events CROSS JOIN (SELECT CAST(unnest([1.25, 2.5, 5, 10, 20]) AS DOUBLE) AS w) GROUP BY w")
def adaptive_bin_counts(spark, sf_dir):
    return th.bins_per_width(table(spark, sf_dir, "events"), "value", [1.25, 2.5, 5, 10, 20])


@query("""WITH RECURSIVE levels AS (SELECT k, count(DISTINCT floor(value / (64.0 * pow(2.0, k)))) AS bins FROM events CROSS JOIN (SELECT CAST(unnest(generate_series(-40, 40)) AS INTEGER) AS k) GROUP BY k),
walk AS (SELECT 0 AS k, bins FROM levels WHERE k = 0
UNION ALL SELECT l.k, l.bins FROM walk w JOIN levels l ON l.k = CASE WHEN w.bins < 50 THEN w.k - 1 ELSE w.k + 1 END WHERE w.bins < 50 OR w.bins > 200)
SELECT 64.0::DOUBLE * pow(2.0, k) AS width, bins FROM walk WHERE bins BETWEEN 50 AND 200""")
def adapted_bin_width(spark, sf_dir):
    """The width that halving from 64 finds for 50 to 200 bins, and its bins."""
    events = table(spark, sf_dir, "events")
    width = th.adapted_width(events, "value", 64.0)
    return th.bins_per_width(events, "value", [width])


@query(f'WITH {_COUNTS} SELECT bin, sublattice, element, n_sites, CAST(sum("count") AS BIGINT) AS "count" FROM counts GROUP BY ALL')
def cation_agg(spark, sf_dir):
    return th.cation_totals(_counts(spark, sf_dir))


_X = f"""{_COUNTS},
num AS (SELECT bin, sublattice, element, sum(n_sites * "count") AS num FROM counts GROUP BY ALL),
x AS (SELECT bin, sublattice, element, num / sum(num) OVER (PARTITION BY bin, sublattice) AS x FROM num)"""
_PURITY = f"""{_COUNTS},
sized AS (SELECT *, max(n_sites) OVER (PARTITION BY sublattice) AS size FROM counts),
purity AS (SELECT bin, sublattice, element, sum("count" * greatest(n_sites, size - n_sites) / size) / sum("count") AS purity FROM sized GROUP BY ALL)"""


@query(f"WITH {_X} SELECT bin, sublattice, element, round(x, 6) AS x FROM x")
def x_of_e(spark, sf_dir):
    return th.composition_by_bin(_counts(spark, sf_dir)).withColumn("x", F.round("x", 6))


@query(f"WITH {_PURITY} SELECT bin, sublattice, element, round(purity, 6) AS purity FROM purity")
def purity_of_e(spark, sf_dir):
    return th.purity_by_bin(_counts(spark, sf_dir)).withColumn("purity", F.round("purity", 6))


def _mixed_sql(cte: str, value: str) -> str:
    return f"""WITH {cte}, {_DOS}, {_GRID},
e AS (SELECT temperature, sublattice, element, {value} AS v, entropy - energy / ({th.KB_MIX * SCALE!r} * temperature) AS s FROM {value} JOIN dos USING (bin) CROSS JOIN grid),
top AS (SELECT *, max(s) OVER (PARTITION BY temperature, sublattice, element) AS m FROM e)
SELECT sublattice, element, temperature, round(sum(exp(s - m) * v) / sum(exp(s - m)), 6) AS mean FROM top GROUP BY ALL"""


@query(_mixed_sql(_X, "x").replace("x AS v", "x.x AS v"))
def x_of_t(spark, sf_dir):
    prop = th.composition_by_bin(_counts(spark, sf_dir)).withColumnRenamed("x", "value")
    return th.canonical_average(_dos(spark, sf_dir), prop, GRID, th.KB_MIX * SCALE, ["sublattice", "element"]).withColumn("mean", F.round("mean", 6))


@query(_mixed_sql(_PURITY, "purity").replace("purity AS v", "purity.purity AS v"))
def purity_of_t(spark, sf_dir):
    prop = th.purity_by_bin(_counts(spark, sf_dir)).withColumnRenamed("purity", "value")
    return th.canonical_average(_dos(spark, sf_dir), prop, GRID, th.KB_MIX * SCALE, ["sublattice", "element"]).withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT u.user_id, t.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type""")
def densified_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return th.densified(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "event_type", e)


@query("SELECT n AS n_sites, count(*) AS visits FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def count_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_sites"))
    return n.groupBy("n_sites").agg(F.count("*").alias("visits"))


@query("""SELECT event_id, CAST(floor(value / 10.0) AS BIGINT) AS bin, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY CAST(floor(value / 10.0) AS BIGINT) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running_mean FROM events""")
def running_mean_by_bin(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", th.bin_id(F.col("value"), WIDTH).alias("bin"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return th.running_mean(rows, ["bin"], "event_id", "cents").select("event_id", "bin", "running_mean")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentile_95(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("""SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS m
FROM (SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN value END AS v FROM events)""")
def forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 5 == 0, F.col("value")).alias("v"))
    return th.filled_forward(e, ["event_type"], "event_id", "v").select("event_id", F.coalesce("v", F.lit(0.0)).alias("m"))
